"""Words, word windows and byte n-grams of whole Arrow batches as numpy arrays, without a Python loop over words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising permutation of splitmix64, in a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(salt)) | np.uint64(1)


_BYTES = constants(256, 11)
_POWERS = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if n > 4 * CHUNK_BYTES:  # for one very long text; not worth keeping
            return tuple(both)
        _POWERS = tuple(both)
    return _POWERS[0][:n], _POWERS[1][:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of the texts end to end, and their n + 1 offsets; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of pieces of about CHUNK_BYTES."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, offs = buffers(texts)
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, "right")) - 1)
        yield slice(at, end), data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words, and per text the number of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    edge = np.empty(len(data) + 1, bool)  # whether a word can begin there
    edge[0], edge[1:] = True, space
    edge[offs] = True
    starts = np.flatnonzero(~space & edge[:-1])
    space_after = np.empty(len(data), bool)
    space_after[-1], space_after[:-1] = True, space[1:]
    inner = offs[(offs > 0) & (offs < len(data))]
    space_after[inner - 1] = True
    ends = np.flatnonzero(~space & space_after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words; with ``lower``, A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTES[_LOWER] if lower else _BYTES)[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))


def windows(hashes: np.ndarray, first: np.ndarray, size: int, salt: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """(values, begins): hashes of ``size`` words in a row inside one text, and where in the words they begin."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factors = constants(size, salt)
    total = hashes[:n] * factors[0]
    for i in range(1, size):
        total += hashes[i : i + n] * factors[i]
    last = np.repeat(first[1:], np.diff(first))[:n]  # end of the text of each word
    begins = np.flatnonzero(np.arange(n) + size <= last)
    return mix(total[begins]), begins


def gram_buckets(codes: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Buckets of ``size`` byte codes (uint32) in a row, begun at each place; the last ``size - 1`` places are missing."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    total = codes[:n] * np.uint32(2654435761)
    for i in range(1, size):
        total = (total ^ (total >> np.uint32(15))) * np.uint32(2246822519) + codes[i : i + n]
    total = (total ^ (total >> np.uint32(13))) * np.uint32(3266489917)
    return (total ^ (total >> np.uint32(16))) & np.uint32((1 << bits) - 1)


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): a number for each UTF-8 character, 32 for white space, and the texts' offsets in characters."""
    if not len(data) or data.max() < 128:
        codes, places = data.astype(np.uint32), offs
    else:
        inner = (data & 0xC0) == 0x80
        at = np.flatnonzero(~inner)
        codes, going = data[at].astype(np.uint32), np.ones(len(at), bool)
        for k in (1, 2, 3):
            place = np.minimum(at + k, len(data) - 1)
            going &= inner[place] & (at + k < len(data))
            codes = np.where(going, codes << np.uint32(8) | data[place], codes)
        places = np.searchsorted(at, offs)
    codes[(codes >= 9) & (codes <= 13)] = 32
    return codes, places


def within(offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the first and the end place where ``size`` bytes in a row can begin."""
    return offs[:-1], np.maximum(offs[1:] - size + 1, offs[:-1])


def span_sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the spans, in doubles."""
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:], dtype=np.float64)
    return sums[np.minimum(ends, len(values))] - sums[np.minimum(begins, len(values))]


def kept_spans(valid: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans' begins and ends once the places that are not valid have been taken out."""
    before = np.concatenate([[0], np.cumsum(valid)])
    return before[np.minimum(begins, len(valid))], before[np.minimum(ends, len(valid))]


BAG_SQL = "label string, buckets binary, counts binary"
BAG_SCHEMA = pa.schema([("label", pa.string()), ("buckets", pa.binary()), ("counts", pa.binary())])


def bagged(parts):
    """For ``mapInArrow`` over (label, text): the distinct buckets of each text and how often they occur, see ``BAG_SQL``.

    ``parts(data, offs)``: (buckets, begins, ends) of the texts of a chunk, any number of times. However long a text is,
    its bag has at most as many entries as there are buckets.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owns, counts = [], []
            for _, data, offs in chunks(batch.column(1)):
                found = parts(data, offs)
                for i in range(len(offs) - 1):
                    own, n = np.unique(np.concatenate([b[s[i] : max(s[i], e[i])] for b, s, e in found]), return_counts=True)
                    owns.append(own.astype("<i4").tobytes())
                    counts.append(np.minimum(n, 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(owns, pa.binary()), pa.array(counts, pa.binary())], schema=BAG_SCHEMA)
        returned_memory()

    return scan


class Bags:
    """Bags of a table of ``BAG_SQL``, in its own few large buffers that memory returns from at once."""

    def __init__(self, table: pa.Table):
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        for buckets, counts in zip(table["buckets"].chunks, table["counts"].chunks, strict=True):
            self.rows += [(np.frombuffer(b.as_buffer(), "<i4"), np.frombuffer(c.as_buffer(), "<u2")) for b, c in zip(buckets, counts, strict=True)]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, shares): the shares add up to 1 in a text that has any."""
        own, counts = self.rows[i]
        n = counts.astype(np.float32)
        return own, n / max(1.0, float(n.sum()))


def returned_memory() -> None:
    """Gives freed memory back to the system, after work in a process that stays and has to stay small."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(scan):
    """``scan`` for ``mapInArrow``, giving back what it held once a partition is done: workers live on, and keep it else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        returned_memory()

    return run
