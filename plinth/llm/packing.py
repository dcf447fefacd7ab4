"""Bounded-space online packing of token pieces into windows.

Each partition tokenises its documents in order and keeps a fixed number of open windows. A piece goes where it fits
best; when it fits nowhere, the fullest window takes what still fits of it and is emitted. What is open at the end of
a partition is written with the rest, and a second, small pass merges the leftovers of a few neighbouring partitions:
whole windows first, then cut ones, and the last tail in sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import settle
from plinth.llm.wordhash import tidied

#: Fixed value: how byte-level BPE of this kind splits text before it merges bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a partition holds before it hands them on: at most a window of ids each, so 4 MB.
FLUSHED = 512
#: White space in a row that tiktoken's pattern, which looks back over all of it, still takes within its stack, ten times over.
LONG_SPACE = re.compile(r"(?<!\s)\s{100000}")
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("open_in", pa.int64())])
PIECE_SQL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open_in long"


def _byte_of() -> dict[str, int]:
    """Byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer file as it is; most workers never need it beside tiktoken, and it is as large again."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def encoder(path: str):
    """Function from text to ids, equal to those of the tokenizer file with add_special_tokens=False.

    The vocabulary of a plain byte-level BPE file is run by tiktoken, which is several times faster; texts with an
    added token's string or a very long run of white space, and files of any other make, go through tokenizers itself.
    """
    slow = lambda text: _tokenizer(path).encode(text, add_special_tokens=False).ids
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer")
    if model.get("type") != "BPE" or not plain or model.get("dropout") or model.get("ignore_merges"):
        return slow
    import tiktoken

    added = [t["content"] for t in spec.get("added_tokens", [])]
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in added and all(c in byte_of for c in piece)}
    merged = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    places = [model["vocab"]["".join(m)] for m in merged]
    if places != sorted(places) or len(set(ranks)) < 256:  # ranks would not be the order of the merges
        return slow
    fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str):
        if any(a in text for a in added) or LONG_SPACE.search(text):
            return slow(text)
        try:
            return fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # a panic of the library is no Exception; a text that it cannot take has the same ids from tokenizers
            return slow(text)

    return encode


class Packer:
    """Open windows of one partition; pieces are (doc_id, start, ids, doc_tokens) and leave with a sequence and an offset."""

    def __init__(self, window: int, most_open: int, least_cut: int, first_sequence: int):
        self.window, self.most_open, self.least_cut, self.next = window, most_open, least_cut, first_sequence
        self.gaps: list[tuple[int, int]] = []  # (gap, sequence), sorted
        self.held: dict[int, list] = {}
        self.done: list[tuple] = []

    def _emit(self, sequence: int) -> None:
        at = 0
        for doc, start, ids, total in self.held.pop(sequence):
            self.done.append((doc, start, ids, total, sequence, at))
            at += len(ids)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids) >= self.window:
            self.done.append((doc, start, ids[: self.window], total, self.next, 0))
            self.next += 1
            start, ids = start + self.window, ids[self.window :]
        if not len(ids):
            return
        i = bisect.bisect_left(self.gaps, (len(ids), -1))
        if i == len(self.gaps) and len(self.gaps) == self.most_open:
            gap, sequence = self.gaps.pop(0)
            if gap >= self.least_cut:
                self.held[sequence].append((doc, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self._emit(sequence)
            i = bisect.bisect_left(self.gaps, (len(ids), -1))
        if i < len(self.gaps):
            gap, sequence = self.gaps.pop(i)
        else:
            gap, sequence, self.next = self.window, self.next, self.next + 1
            self.held[sequence] = []
        self.held[sequence].append((doc, start, ids, total))
        if gap == len(ids):
            self._emit(sequence)
        else:
            bisect.insort(self.gaps, (gap - len(ids), sequence))


def _batch(rows: list[tuple], open_in: list) -> pa.RecordBatch:
    doc, start, ids, total, sequence, offset = zip(*rows, strict=True)
    arrays = [doc, start, [len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids], total, sequence, offset, open_in]
    return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(arrays, PIECE, strict=True)], schema=PIECE)


def _flush(packer: Packer, open_in: int | None = None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(packer.done), FLUSHED):
        part = packer.done[i : i + FLUSHED]
        yield _batch(part, [open_in] * len(part))
    packer.done = []


def _merge(rows: list[tuple], window: int, least_cut: int, sequence: int) -> list[tuple]:
    """Leftover windows, as rows (sequence, offset, doc_id, start, ids, doc_tokens), into new sequences."""
    held: dict[int, list] = {}
    for old, _, *piece in sorted(rows, key=lambda r: r[:2]):
        held.setdefault(old, []).append(tuple(piece))
    size = lambda pieces: sum(len(p[2]) for p in pieces)
    bins: list[list] = []
    gaps: list[tuple[int, int]] = []
    for _, pieces in sorted(held.items(), key=lambda x: (-size(x[1]), x[0])):
        i = bisect.bisect_left(gaps, (size(pieces), -1))
        if i < len(gaps):
            gap, k = gaps.pop(i)
            bins[k] += pieces
        else:
            gap, k = window, len(bins)
            bins.append(list(pieces))
        bisect.insort(gaps, (gap - size(pieces), k))
    out, loose = [], []
    for pieces in bins:
        if window - size(pieces) < least_cut:
            out.append(pieces)
        else:
            loose += pieces
    left = size(loose)
    lengths = [window] * (left // window)
    lengths += [1 << b for b in range(window.bit_length(), -1, -1) if left % window >> b & 1]
    for length in lengths:
        pieces = []
        while length:
            doc, start, ids, total = loose.pop(0)
            pieces.append((doc, start, ids[:length], total))
            if len(ids) > length:
                loose.insert(0, (doc, start + length, ids[length:], total))
            length -= min(length, len(ids))
        out.append(pieces)
    done = []
    for pieces in out:
        at = 0
        for doc, start, ids, total in pieces:
            done.append((doc, start, ids, total, sequence, at))
            at += len(ids)
        sequence += 1
    return done


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    most_open: int = 16,
    least_cut: int = 16,
    end_id: int = 1,
    merged_partitions: int = 32,
) -> DataFrame:
    """Pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of the vocabulary file, which every worker must be able to read. Each document is its
    ids followed by ``end_id``. Null and empty texts are the end id alone; texts longer than a window fill windows of
    their own first; repeated rows are packed each; ids are 64-bit integers, and what is no such number counts as null; a
    null id stays null; an empty table gives an empty result; other columns are ignored. A sequence is padded by less than ``least_cut`` tokens, or not at all where its length is a
    power of two. Documents are not moved: memory is a batch of texts and ``most_open`` windows a partition.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer), TaskContext.get().partitionId()
        packer = Packer(window, most_open, least_cut, task << 36)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], np.uint32)
                packer.add(doc, 0, ids, len(ids))
                if len(packer.done) >= FLUSHED:
                    yield from _flush(packer)
        yield from _flush(packer)
        for sequence in sorted(packer.held):
            packer._emit(sequence)
        yield from _flush(packer, task // merged_partitions)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        columns = (table[c].to_pylist() for c in ("sequence_id", "offset", "doc_id", "start", "ids", "doc_tokens"))
        rows = [(s, o, d, at, np.frombuffer(ids, "<u4"), n) for s, o, d, at, ids, n in zip(*columns, strict=True)]
        done = _merge(rows, window, least_cut, 1 << 62 | key[0].as_py() << 36)
        return pa.Table.from_batches([_batch(done, [None] * len(done))])

    packed = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(pack), PIECE_SQL)
    packed = settle(packed, "packed")
    merged = packed.filter("open_in is not null").groupBy("open_in").applyInArrow(merge, PIECE_SQL)
    return packed.filter("open_in is null").unionByName(merged).drop("open_in")
