"""Column-at-a-time hashing of words and byte strings with numpy.

Texts arrive as one buffer of UTF-8 bytes with offsets. A prefix sum of ``value(byte) * P**i`` modulo
2**64 gives the polynomial hash of any slice with two look-ups, so words, shingles and k-grams are
hashed without building a Python object for any of them. Work goes on in slabs of whole texts, so
that scratch arrays stay small whatever the size of the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLAB_BYTES = 1 << 19
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_U = np.uint64

with np.errstate(over="ignore"):
    _VALUE = (np.arange(256, dtype=np.uint64) + _U(1)) * _U(0xD6E8FEB86659FD93)
    _VALUE ^= _VALUE >> _U(29)
    _VALUE *= _M1
    _VALUE ^= _VALUE >> _U(32)
    _VALUE |= _U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE_LOWER = _VALUE[_LOWER]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All of ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n; kept between calls, grown when a longer text comes."""
    if len(_powers[0]) < n:
        size = max(n, SLAB_BYTES + 1)
        for k, base in enumerate((_P, _P_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    h = h ^ (h >> _U(30))
    h *= _M1
    h ^= h >> _U(27)
    h *= _M2
    h ^= h >> _U(31)
    return h


def unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the first place of each, and each value's number: ``np.unique`` by a hash table."""
    coded = pa.array(values).dictionary_encode()
    code, kinds = coded.indices.to_numpy(), coded.dictionary.to_numpy()
    first = np.empty(len(kinds), np.int64)
    first[code[::-1]] = np.arange(len(values) - 1, -1, -1)
    order = np.argsort(kinds, kind="stable")
    rank = np.empty(len(kinds), np.int64)
    rank[order] = np.arange(len(kinds))
    return kinds[order], first[order], rank[code]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(column: pa.Array, size: int = 4 << 20):
    """Ranges (first, last) of rows whose texts make up about ``size`` bytes each: a batch is worked off in these."""
    yield from slabs(buffers(column)[1], size)


def slabs(offsets: np.ndarray, size: int = SLAB_BYTES):
    """Ranges (first, last) of texts that make up about ``size`` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def prefix(raw: np.ndarray, lower: bool = False) -> np.ndarray:
    """Prefix sums of value(byte) * P**i, one longer than ``raw``."""
    p, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[raw] * p[: len(raw)], out=out[1:])
    return out


def spans(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each text, and the count of words in each.

    Other bytes part words if they are set in ``space``.
    """
    solid = ~space[raw]
    before = np.empty(len(raw), bool)
    if len(raw):
        before[0] = False
        before[1:] = solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(raw)]
    before[cuts] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(raw), bool)
    if len(raw):
        after[-1] = False
        after[:-1] = solid[1:]
    inner = offsets[1:-1]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    per = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, per


def _kinds() -> np.ndarray:
    """Per byte: 0 white space, 1 ASCII letter, 2 digit, 3 apostrophe, 4 other ASCII, 5 not ASCII."""
    kind = np.full(256, 4, np.uint8)
    kind[[i for i in range(128) if chr(i).isalpha()]] = 1
    kind[48:58] = 2
    kind[39] = 3
    kind[128:] = 5
    kind[_SPACE] = 0
    return kind


_KIND = _kinds()
# [kind before, kind]: does a token of a word pre-tokeniser always end between the two?
_PARTS = np.zeros((6, 6), bool)
_PARTS[1:, 2] = True
_PARTS[2, [1, 3, 4]] = True
_PARTS[1, 4] = _PARTS[4, 1] = True
_BEGINS = _PARTS | (np.arange(6)[:, None] == 0) & (np.arange(6) > 0)
_BEGINS[:, 0] = False
_BEGINS = _BEGINS.ravel()


def pieces(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``spans``, with words cut where letters meet signs and at each digit; apostrophes stay with what they touch."""
    kind = _KIND[raw]
    before = np.zeros(len(raw), np.uint8)
    before[1:] = kind[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(raw)]
    before[cuts] = 0
    begins = _BEGINS[before * np.uint8(6) + kind]
    # a piece ends where the next begins, or at the first white space or text end behind it
    edge = begins.copy()
    edge[1:] |= (kind[1:] == 0) & (kind[:-1] > 0)
    edge[cuts] = True
    at = np.flatnonzero(edge)
    own = np.flatnonzero(begins[at])
    starts, ends = at[own], np.append(at, len(raw))[own + 1]
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word with A-Z lower-cased, in order, and the count of words of each text."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, j in slabs(offsets):
        part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, per = spans(part, off, space)
        h, (_, inv) = prefix(part, lower=True), powers(len(part) + 1)
        hashes.append(mix((h[e] - h[s]) * inv[s] + (e - s).astype(np.uint64) * _M2))
        counts.append(per)
    return np.concatenate(hashes), np.concatenate(counts)


def vocabulary(raw: np.ndarray, offsets: np.ndarray, lower: bool, cut=spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts: hash, start, length (in the bytes); for all words their number among these, and their text.

    ``cut`` finds the words: ``spans`` or ``pieces``.
    """
    hashes, starts, lengths, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in slabs(offsets):
        part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s, e, per = cut(part, off)
        h, (_, inv) = prefix(part, lower), powers(len(part) + 1)
        hashes.append(mix((h[e] - h[s]) * inv[s] + (e - s).astype(np.uint64) * _M2))
        starts.append(s + offsets[i])
        lengths.append(e - s)
        owner.append(np.repeat(np.arange(i, j), per))
    h, s, n, o = (np.concatenate(x) for x in (hashes, starts, lengths, owner))
    uniq, first, code = unique(h)
    return uniq, s[first], n[first], code, o


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``k`` words.

    With fewer words the whole sequence counts as one shingle; without words the set is empty.
    """
    words, per = word_hashes(raw, offsets)
    ends = np.cumsum(per)
    out = []
    if len(words) >= k:
        full = words[: len(words) - k + 1].copy()
        for d in range(1, k):
            full *= _P
            full += words[d : len(words) - k + 1 + d]
        full = mix(full)
    for n, e in zip(per.tolist(), ends.tolist(), strict=True):
        if n >= k:
            got = np.sort(full[e - n : e - k + 1])
            keep = np.empty(len(got), bool)
            keep[0] = True
            np.not_equal(got[1:], got[:-1], out=keep[1:])
            out.append(got[keep])
        elif n:
            h = _U(n) * _M1
            for w in words[e - n : e]:
                h = h * _P + w
            out.append(mix(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest64(values: np.ndarray) -> np.uint64:
    """One order-dependent hash of an array of hashes."""
    p, _ = powers(len(values) + 1)
    return mix(np.array([np.sum(mix(values + _U(len(values))) * p[: len(values)], dtype=np.uint64) + _U(len(values))], np.uint64))[0]
