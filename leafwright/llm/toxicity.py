"""Toxicity: two class-conditional Kneser-Ney models and the difference of their log-likelihoods.

The models give each character of a word from the characters before it inside the word (``ORDER`` at most, with
marks at both ends), so that new forms of a known stem are scored too. The highest order is counted
per class and discounted; all it gives up goes to one Kneser-Ney model of lower orders that
both classes share, counted over kinds of context. So an expression that is rare in both classes has a
ratio near 0, and one that only toxic texts use has a high one.

A text's features are the log ratio per character over the whole text and over its strongest words;
a logistic function, fitted on the same labelled rows, turns them into a score from 0 to 1.

The fit uses ``fit_rows`` labelled rows and ``fit_bytes`` of text at most, documented bounds, and is done by one task
of an executor; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import exchange as X
from . import textcode as T

ORDER = 6
FIT_ROWS, FIT_BYTES = 8_000, 48 << 20
_SEEN_WORDS = 1 << 20  # words that a Python worker remembers
DISCOUNT = 0.75
_FEATURES = 5


def _letters(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words' lower-cased bytes with ``ORDER`` marks before each and one behind; the place where each word ends."""
    size = lengths + ORDER + 1
    end = np.cumsum(size)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    at = np.repeat(end - size + ORDER, lengths) + (np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    src = np.repeat(starts, lengths) + (np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    out[at] = T._LOWER[raw[src]]
    return out, end


def _grams(letters: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each scored character (letters and the end mark) the number of its word and its place."""
    word = np.repeat(np.arange(len(lengths)), lengths + 1)
    first = end - lengths - 1
    place = np.repeat(first, lengths + 1) + (np.arange(len(word)) - np.repeat(np.cumsum(lengths + 1) - lengths - 1, lengths + 1))
    return word, place, letters


class _Hashes:
    """Hashes of the ``n`` letters that end ``back`` before each place (its own letter included if ``back`` is 0)."""

    def __init__(self, letters: np.ndarray) -> None:
        self.sums, (_, self.inverse) = T.prefix(letters), T.powers(len(letters) + 1)

    def __call__(self, place: np.ndarray, n: int, back: int = 0) -> np.ndarray:
        to = place + 1 - back
        return T.mix((self.sums[to] - self.sums[to - n]) * self.inverse[to - n] + np.uint64(n + 1) * T._M1)


class Model:
    """Log ratio of the next letter, toxic over ordinary, by hash of its gram; where the gram is new, by hash of its context."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, toxic: np.ndarray, plain: np.ndarray) -> None:
        letters, end = _letters(raw, starts, lengths)
        word, place, _ = _grams(letters, end, lengths)
        at = _Hashes(letters)
        gram, first, code = np.unique(at(place, ORDER + 1), return_index=True, return_inverse=True)
        count = np.stack([np.bincount(code, c[word], len(gram)) for c in (toxic, plain)])
        place = place[first]
        del code, word, first
        below = self._shared(at, place)
        context, home = np.unique(at(place, ORDER, 1), return_inverse=True)
        total = np.stack([np.bincount(home, count[k], len(context)) for k in (0, 1)])
        kinds = np.stack([np.bincount(home, count[k] > 0, len(context)) for k in (0, 1)])
        with np.errstate(divide="ignore", invalid="ignore"):
            left = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
            own = np.where(total[:, home] > 0, np.maximum(count - DISCOUNT, 0) / total[:, home], 0.0)
        p = own + left[:, home] * below
        self.gram, self.ratio = gram, (np.log(p[0]) - np.log(p[1])).astype(np.float32)
        self.context, self.left = context, (np.log(left[0]) - np.log(left[1])).astype(np.float32)

    def packed(self) -> list[bytes]:
        return [self.gram.tobytes(), self.ratio.tobytes(), self.context.tobytes(), self.left.tobytes()]

    @classmethod
    def unpacked(cls, parts: list[bytes]) -> Model:
        out = cls.__new__(cls)
        out.gram, out.ratio, out.context, out.left = (np.frombuffer(x, kind) for x, kind in zip(parts, (np.uint64, np.float32, np.uint64, np.float32), strict=True))
        return out

    @staticmethod
    def _shared(at: _Hashes, place: np.ndarray) -> np.ndarray:
        """Probability of each letter by the shared model, of orders 0 to ORDER - 1, counted over distinct longer grams.

        ``place`` has one place of each gram of the highest order, and so at least one of each shorter gram.
        """
        p = np.full(len(place), 1 / 256)
        longer = np.unique(at(place, 1), return_index=True, return_inverse=True)
        for n in range(ORDER):
            _, some, code = longer
            longer = np.unique(at(place, n + 2), return_index=True, return_inverse=True)
            kinds = np.bincount(code[longer[1]], minlength=len(some)).astype(np.float64)
            context, home = np.unique(at(place[some], n, 1), return_inverse=True)
            total = np.bincount(home, kinds, len(context))
            distinct = np.bincount(home, kinds > 0, len(context))
            h = home[code]
            p = np.maximum(kinds[code] - DISCOUNT, 0) / total[h] + DISCOUNT * distinct[h] / total[h] * p
        return p

    def known(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Summed log ratio of each word, by its hash; words met before in this process are looked up."""
        have, value = getattr(self, "_seen", (np.zeros(0, np.uint64), np.zeros(0)))
        out = np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(have, hashes), max(len(have) - 1, 0))
        met = have[at] == hashes if len(have) else np.zeros(len(hashes), bool)
        out[met] = value[at[met]]
        new = np.flatnonzero(~met)
        for lo in range(0, len(new), 1 << 16):
            some = new[lo : lo + (1 << 16)]
            letters, end = _letters(raw, starts[some], lengths[some])
            out[some] = self.words(letters, end, lengths[some])
        if len(new):
            if len(have) > _SEEN_WORDS:
                have, value = have[:0], value[:0]
            keys = np.concatenate([have, hashes[new]])
            order = np.argsort(keys, kind="stable")
            self._seen = keys[order], np.concatenate([value, out[new]])[order]
        return out

    def words(self, letters: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Summed log ratio of each word."""
        word, place, _ = _grams(letters, end, lengths)
        if not len(word) or not len(self.gram):
            return np.zeros(len(lengths))
        hashes = _Hashes(letters)
        g, c = hashes(place, ORDER + 1), hashes(place, ORDER, 1)
        at = np.minimum(np.searchsorted(self.gram, g), len(self.gram) - 1)
        to = np.minimum(np.searchsorted(self.context, c), len(self.context) - 1)
        value = np.where(self.gram[at] == g, self.ratio[at], np.where(self.context[to] == c, self.left[to], 0))
        return np.bincount(word, value, len(lengths))


def features(column: pa.Array, model: Model | None) -> np.ndarray:
    """Features of the texts of a batch, worked off in runs of a few megabytes."""
    parts = [_features_of(column.slice(i, j - i), model) for i, j in T.runs(column)]
    return np.concatenate([np.zeros((0, _FEATURES)), *parts])


def _features_of(column: pa.Array, model: Model | None) -> np.ndarray:
    """Per text: mean log ratio per character, the three highest words' ratios per character, and the log of the count of words."""
    raw, offsets = T.buffers(column)
    n = len(offsets) - 1
    with np.errstate(over="ignore"):
        hashes, starts, lengths, code, owner = T.vocabulary(raw, offsets, lower=True)
        value = model.known(hashes, raw, starts, lengths) if model is not None else np.zeros(len(hashes))
    out = np.zeros((n, _FEATURES))
    if not len(code):
        return out
    chars = np.bincount(owner, lengths[code] + 1, n)
    out[:, 0] = np.bincount(owner, value[code], n) / np.maximum(chars, 1)
    each = np.maximum(value / (lengths + 1), 0)
    order = np.lexsort((-each[code], owner))
    per = np.bincount(owner, minlength=n)
    first = np.cumsum(per) - per
    for k in range(3):
        has = per > k
        out[has, 1 + k] = each[code[order[first[has] + k]]]
    out[:, 4] = np.log1p(per)
    return out


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, with the mean and spread of the features folded in."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[0] - (w[1:] * mean / spread).sum(), w[1:] / spread)


def _curve(x: np.ndarray) -> np.ndarray:
    """Features as the logistic function takes them: also capped and squared strengths of the highest words."""
    top = x[:, 1:4]
    return np.column_stack([x, np.minimum(top, 1.0), top**2])


def _count_words(text: pa.Array, toxic: np.ndarray, part: np.ndarray) -> pa.Table:
    """Distinct words with their counts by half and label: ``word, p0, t0, p1, t1``."""
    raw, offsets = T.buffers(text)
    with np.errstate(over="ignore"):
        _, starts, lengths, code, owner = T.vocabulary(raw, offsets, lower=True)
    cell = 2 * part[owner] + toxic[owner]
    counts = [np.bincount(code[cell == k], minlength=len(starts)) for k in range(4)]
    words = [T._LOWER[raw[s : s + n]].tobytes() for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
    return pa.table([pa.array(words, pa.binary()), *(pa.array(c.astype(np.int64)) for c in counts)], names=["word", "p0", "t0", "p1", "t1"])


def labelled(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_bytes: int = FIT_BYTES, fold: int = 2, of: int = 4) -> DataFrame:
    """Labelled rows that may be learned from: ``part`` (0 or 1), ``toxic``, ``text``.

    One text for each document, ``fit_rows`` and ``fit_bytes`` at most, the smallest hashes first.
    """
    own = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.where(F.crc32(F.col("doc_id").cast("string")) % of != fold).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # sizes first, so that no more texts than will be used come together
    size = own.join(text.select("doc_id", F.octet_length("text").alias("n"), F.xxhash64("text").alias("h")), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("n", "h")).alias("one"))
    upto = F.sum("one.n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # over ``fit_rows`` rows of a few bytes
    size = size.withColumn("upto", upto).where(F.coalesce("upto", F.lit(0)) <= fit_bytes)
    rows = size.join(text, "doc_id").where(F.xxhash64("text") == F.col("one.h")).dropDuplicates(["doc_id"])
    return rows.select((F.crc32(F.col("doc_id").cast("string").cast("binary")).bitwiseAND(1024) > 0).cast("int").alias("part"), "toxic", "text")


_FITTED = "gram binary, ratio binary, context binary, left binary, weights array<double>"


def _train(table: pa.Table) -> pa.Table:
    """The model of all words, and the logistic weights.

    Both halves' models score the other half to fit the weights, so that these don't rest on words that a
    model has seen in the very text; the final model has the counts of both halves.
    """
    table = table.combine_chunks()
    text, toxic, part = (table.column(c) for c in ("text", "toxic", "part"))
    toxic, part = toxic.to_numpy().astype(np.int64), part.to_numpy().astype(np.int64)
    found = pa.concat_tables([_count_words(text.slice(i, j - i), toxic[i:j], part[i:j]) for i, j in T.runs(text)])
    found = found.group_by("word").aggregate([(c, "sum") for c in ("p0", "t0", "p1", "t1")]).sort_by("word")
    raw, offsets = T.buffers(found.column("word"))
    starts, lengths = offsets[:-1], np.diff(offsets)
    p0, t0, p1, t1 = (found.column(f"{c}_sum").to_numpy().astype(np.float64) for c in ("p0", "t0", "p1", "t1"))

    def model(ones: np.ndarray, plain: np.ndarray) -> Model:
        keep = np.flatnonzero(ones + plain > 0)
        with np.errstate(over="ignore"):
            return Model(raw, starts[keep], lengths[keep], ones[keep], plain[keep])

    x = np.zeros((len(part), _FEATURES))
    for k, half in ((0, (t1, p1)), (1, (t0, p0))):
        at = np.flatnonzero(part == k)
        x[at] = features(text.take(pa.array(at)).combine_chunks(), model(*half))
    weights = np.zeros(_curve(x[:1]).shape[1] + 1)
    if toxic.min() == toxic.max():
        weights[0] = -5.0 if toxic.max() < 1 else 5.0
    else:
        weights = _logistic(_curve(x), toxic.astype(np.float64))
    whole = model(t0 + t1, p0 + p1)
    return pa.table({n: pa.array([v], pa.binary()) for n, v in zip(("gram", "ratio", "context", "left"), whole.packed(), strict=True)} | {"weights": pa.array([weights.tolist()], pa.list_(pa.float64()))})


_models: dict[int, Model] = {}


def _loaded(parts: list[bytes]) -> Model:
    """The model of a broadcast, made once in each worker."""
    key = hash(tuple(parts))
    if key not in _models:
        _models.clear()
        _models[key] = Model.unpacked(parts)
    return _models[key]


def fit(rows: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The model's arrays and the logistic weights, fitted in one task on ``labelled`` rows."""
    made = rows.groupBy(F.lit(0).alias("all")).applyInArrow(_train, _FITTED).first()
    if made is None:
        weights = np.zeros(_curve(np.zeros((1, _FEATURES))).shape[1] + 1)
        weights[0] = -5.0
        return [b""] * 4, weights
    return [bytes(made[n]) for n in ("gram", "ratio", "context", "left")], np.array(made["weights"])


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``held_out, score, predicted`` added (columns so named are replaced).

    Labels are read of rows whose crc32(doc_id as text) mod 4 is not 2, a label 1 outweighs a 0 for the same
    document, and null or other labels are ignored; of a document with several texts one is learned from. A null or
    empty text gets the score of a text without words. A null ``doc_id`` is scored and not held out; repeated rows come
    back as often as they came, with one score, and a text of any length is worked off whole. Without labels
    of both kinds the score is constant. No rows give no rows.
    """
    parts, weights = fit(labelled(docs, labels, fit_rows))
    X.release(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(parts)  # as large as the grams of ``fit_bytes`` of text
    del parts
    docs = docs.drop("held_out", "score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = _curve(features(batch["_lw_text"], _loaded(cast.value))) @ weights[1:] + weights[0]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            rest = [c for i, c in enumerate(batch.columns) if batch.schema.field(i).name != "_lw_text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(p)], [*(n for n in batch.schema.names if n != "_lw_text"), "score"])

    out = docs.withColumn("_lw_text", F.col("text").cast("string")).mapInArrow(run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})
