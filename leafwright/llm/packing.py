"""Lexical retrieval packing: training sequences of documents that share rare words.

Documents are dealt into shards. Each shard has an inverted index with BM25 weights. A seed document opens a
window; the index gives its best unused neighbours, which go in whole while they fit; the best one
left is cut to fill what remains, and its rest is the next seed. So all windows of a shard but the last are full;
that one is cut into powers of two, which need no padding.

Each distinct piece of a shard's texts is tokenised once: white space parts tokens, and so does a letter next to a sign,
or a digit, for tokenizers with such a pre-tokeniser; so a text's ids are its pieces' ids in order. Workers remember pieces
between shards.
"""

from __future__ import annotations

import json
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textcode as T

LENGTH, END_ID = 2048, 1
K1, B, COMMON = 1.2, 0.75, 16
SHARD_BYTES = 2 << 20
REMEMBERED = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Ids of pieces of text, by hash, for a tokenizer given as its JSON."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, own = Tokenizer.from_str(spec), json.loads(spec)
        self.folds = any(n.get("type") == "Lowercase" for n in (own.get("normalizer") or {}).get("normalizers", [own.get("normalizer") or {}]))
        self.special = [t["content"].encode() for t in own.get("added_tokens", ())]
        suffix = own["model"].get("end_of_word_suffix")
        #: does an id end a word? None where the vocabulary has no mark for it
        self.last = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab(True)
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self._old = self._new = _Known()
        # pieces that are lower-cased and whole words of the pre-tokeniser need no more than white space to part them
        self.bare = None
        steps = (own.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if suffix and self.folds and [t.get("type") for t in steps] == ["Split", "ByteLevel"] and not steps[1].get("use_regex", True) and not steps[1].get("add_prefix_space"):
            from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

            self.bare = Tokenizer(self.tokenizer.model)  # the same model, not a second one
            self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])

    def _encode(self, words: list[str], simple: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, count of each word's)."""
        if simple and self.bare is not None:
            # some hundred words as one text: an id that ends a word parts them
            lines = [" ".join(words[i : i + 256]) for i in range(0, len(words), 256)]
            flat = np.concatenate([np.array(e.ids, np.uint32) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)])
            end = np.flatnonzero(self.last[flat])
            if len(end) == len(words) and end[-1] == len(flat) - 1:
                return flat, np.diff(end, prepend=-1)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)

    def of(self, hashes: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, parted: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, count, flat): the ids of word i are ``flat[first[i] : first[i] + count[i]]``; ``hashes`` are sorted.

        ``parted`` tells that the words are ``textcode.pieces``.
        """
        first, count, parts, base = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64), [], 0
        left = np.ones(len(hashes), bool)
        for known in (self._new, self._old):
            at = known.find(hashes)
            hit = left & (at >= 0)
            if known is self._old and known is not self._new and hit.any():
                self._new = self._new.with_(hashes[hit], *known.take(at[hit]))  # what is still in use stays
            flat, n = known.take(at[hit])
            count[hit], first[hit] = n, base + np.cumsum(n) - n
            parts.append(flat)
            base += len(flat)
            left &= ~hit
        new = np.flatnonzero(left)
        simple = np.zeros(len(new), bool)
        words = []
        for k, (a, n) in enumerate(zip(starts[new].tolist(), lengths[new].tolist(), strict=True)):
            word = raw[a : a + n].tobytes().decode("utf-8", "replace")
            if not parted:
                pass
            elif word.isascii():
                simple[k] = "'" not in word
                word = word.lower() if simple[k] else word
            else:
                simple[k] = word.isalpha() and word.islower() and word.lower() == word and unicodedata.is_normalized("NFC", word)
            words.append(word)
        for kind in (True, False):
            some = np.flatnonzero(simple == kind)
            for lo in range(0, len(some), 1 << 13):
                own = some[lo : lo + (1 << 13)]
                flat, n = self._encode([words[k] for k in own.tolist()], kind)
                count[new[own]], first[new[own]] = n, base + np.cumsum(n) - n
                parts.append(flat)
                base += len(flat)
        whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        if len(new):
            if len(self._new.hashes) > REMEMBERED:
                self._old, self._new = self._new, _Known()
            self._new = self._new.with_(hashes[new], whole[_runs(first[new], count[new])], count[new])
        return first, count, whole


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions of some runs, one after another."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class _Known:
    """Words met before: sorted hashes, and where each one's ids are."""

    def __init__(self, hashes=np.zeros(0, np.uint64), first=np.zeros(0, np.int64), count=np.zeros(0, np.int64), flat=np.zeros(0, np.uint32)) -> None:
        self.hashes, self.first, self.count, self.flat = hashes, first, count, flat

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.flat[_runs(self.first[at], self.count[at])], self.count[at]

    def with_(self, hashes: np.ndarray, flat: np.ndarray, count: np.ndarray) -> _Known:
        """With more words; ``hashes`` are sorted."""
        at = np.searchsorted(self.hashes, hashes)
        put = lambda old, new: np.insert(old, at, new)
        return _Known(put(self.hashes, hashes), put(self.first, len(self.flat) + np.cumsum(count) - count), put(self.count, count), np.concatenate([self.flat, flat]))


class Bm25:
    """Inverted index of a shard, as arrays: for each term the documents that hold it and their weights."""

    def __init__(self, terms: np.ndarray, owner: np.ndarray, n_terms: int, n_docs: int) -> None:
        every = np.sort(terms * np.int64(n_docs) + owner)
        heads = np.flatnonzero(np.diff(every, prepend=-1))
        pair, tf = every[heads], np.diff(heads, append=len(every))
        term, self.doc = pair // n_docs, pair % n_docs
        df = np.bincount(term, minlength=n_terms)
        size = np.bincount(owner, minlength=n_docs)
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * size / max(size.mean(), 1e-9))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.bound = np.concatenate([[0], np.cumsum(df)])
        # terms that many documents hold are rows of a matrix, which add up faster than postings
        common = np.flatnonzero(COMMON * df > n_docs)
        self.row = np.full(n_terms, -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), n_docs), np.float32)
        many = self.row[term]
        self.dense[many[many >= 0], self.doc[many >= 0]] = self.weight[many >= 0]
        # a query is all terms of a document that another one holds too
        useful = np.flatnonzero(df[term] > 1)
        order = useful[np.argsort(self.doc[useful], kind="stable")]
        self.query, self.ask = term[order], np.searchsorted(self.doc[order], np.arange(n_docs + 1))
        self.n = n_docs

    def scores(self, doc: int) -> np.ndarray:
        """Every document's score for ``doc``: 0 where it shares no term with it."""
        terms = self.query[self.ask[doc] : self.ask[doc + 1]]
        rows = self.row[terms]
        rare = terms[rows < 0]
        at = _runs(self.bound[rare], self.bound[rare + 1] - self.bound[rare])
        return np.bincount(self.doc[at], self.weight[at], self.n) + self.dense[rows[rows >= 0]].sum(0)


def fill(sizes: np.ndarray, scores, length: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that lay all documents into windows of ``length``.

    ``scores`` gives all documents' scores for one; the best unused one that fits goes in next, ties in order.
    """
    used = np.zeros(len(sizes), bool)
    out: list[tuple[int, int, int, int, int]] = []
    seq, room, ahead = 0, length, 0
    held: tuple[int, int] | None = None  # a cut document and where its rest begins

    def put(doc: int, start: int, n: int) -> None:
        nonlocal seq, room
        out.append((doc, start, n, seq, length - room))
        room -= n
        if not room:
            seq, room = seq + 1, length

    while True:
        if held is None:
            while ahead < len(sizes) and used[ahead]:
                ahead += 1
            if ahead == len(sizes):
                break
            held = ahead, 0
            used[ahead] = True
        doc, start = held
        held = None
        while (left := int(sizes[doc]) - start) >= room:
            n = room
            put(doc, start, n)
            start += n
            if left == n:
                break
        if start == sizes[doc]:
            continue
        put(doc, start, int(sizes[doc]) - start)
        near = scores(doc)
        near[used] = 0
        while room < length:
            best = int(np.argmax(np.where(sizes <= room, near, 0)))
            if not near[best] or sizes[best] > room:
                break
            used[best], near[best] = True, 0
            put(best, 0, int(sizes[best]))
        if room < length and near.any():
            held = int(np.argmax(near)), 0
            used[held[0]] = True
    if room < length:  # the last window: powers of two
        first = next(i for i in range(len(out) - 1, -2, -1) if i < 0 or out[i][3] < seq) + 1
        tail, total = out[first:], length - room
        del out[first:]
        sizes_ = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        at = 0
        for doc, start, n, _, _ in tail:
            while n:
                m = min(n, sizes_[0] - at)
                out.append((doc, start, m, seq, at))
                start, n, at = start + m, n - m, at + m
                if at == sizes_[0]:
                    sizes_.pop(0)
                    seq, at = seq + 1, 0
    return out


_words: dict[int, WordTokens] = {}


def _shard(spec, length: int, end_id: int):
    def run(table: pa.Table) -> pa.Table:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        key = hash(spec.value)
        if key not in _words:
            _words.clear()
            _words[key] = WordTokens(spec.value)
        blob = table.column("blob")[0].as_py()
        import pyarrow.compute as pc

        table = table.take(pc.sort_indices(table.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
        raw, offsets = T.buffers(table.column("text"))
        n_docs = len(table)
        with np.errstate(over="ignore"):
            own = _words[key]
            # signs and digits are parted from words, unless a special token could be cut through
            plain = raw.tobytes()
            cut = T.spans if any(t in plain for t in own.special) else T.pieces
            del plain
            hashes, starts, lengths, code, owner = T.vocabulary(raw, offsets, lower=own.folds and cut is T.pieces, cut=cut)
            first, count, flat = own.of(hashes, raw, starts, lengths, cut is T.pieces)
        index = Bm25(code.astype(np.int64), owner, len(hashes), n_docs)
        per = np.bincount(owner, count[code], n_docs).astype(np.int64) + 1
        pieces = fill(per, index.scores, length)
        begin = np.searchsorted(owner, np.arange(n_docs + 1))
        ids: dict[int, bytes] = {}
        ids_of = table.column("doc_id").to_pylist()
        crc = []
        for d, s, n, _, _ in pieces:
            if s == 0 or d not in ids:
                c = code[begin[d] : begin[d + 1]]
                ids[d] = np.append(flat[_runs(first[c], count[c])], np.uint32(end_id)).astype("<u4").tobytes()
            crc.append(zlib.crc32(memoryview(ids[d])[4 * s : 4 * (s + n)]))
            if s + n == per[d]:
                del ids[d]
        col = list(zip(*pieces, strict=True)) if pieces else [[]] * 5
        out = {"doc_id": [ids_of[d] for d in col[0]], "start": col[1], "length": col[2], "ids_crc32": crc, "doc_tokens": per[np.array(col[0], np.int64)], "sequence_id": (np.int64(blob) << 32) + np.array(col[3], np.int64), "offset": col[4]}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})

    return run


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``tokenizer`` is the path of a tokenizers JSON whose pre-tokeniser parts words at white space, at each digit and
    where ASCII letters meet signs other than the apostrophe; the driver reads it. A seed's query is all its terms that
    another document of its shard holds, and no neighbour is left out of the ranking. Each document is its ids and ``end_id``; a null text is empty. Each id lies in one piece,
    and a sequence's pieces have no gaps. Sequences are ``length`` long, or a shorter power of two.
    Null ids and repeated rows are documents like others; other columns are ignored; no rows give no rows.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return X.with_blob(rows, "doc_id", "text", count=X.blob_count(rows, SHARD_BYTES)).groupBy("blob").applyInArrow(_shard(spec, length, end_id), PIECES)
