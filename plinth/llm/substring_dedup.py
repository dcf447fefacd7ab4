"""Substring deduplication with a count-min prefilter.

Documents are dealt to parts by hash. Each part hashes every window of words of every text and sends one increment a
distinct window to a one-row count-min sketch, which is divided into ranges so that no machine holds it whole and
which travels sparse: two to four bytes a window and one row for each part and range. Parts, ranges and groups grow with
the input as far as their bounds allow, so that a row holds 128 windows and more up to about 2 TB of text, and several at
100 TB; see ``plan``. The merged sketch tells each part, one bit an increment, which of its windows may stand in several
parts; an estimate never falls below the true count, so none is lost. Only those windows are sent again, in full, and
grouped exactly for the smallest document id; the answer is again one bit a window. What repeats inside a part the part
sees itself. The three passes over the texts share one exchange. A passage on a third of all documents costs one row a
part, and repeated rows of different input splits are dealt to different parts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from plinth.llm import wordhash as wh

#: log2 of the least and most counters in one range of the sketch, and of the windows of one group; bounds of a part's
#: bytes of text; windows that a row between a part and a range or group should hold; bytes of text that a window takes.
RANGE_BITS, GROUP_BITS, PART_BYTES, ROW_WINDOWS, WINDOW_BYTES = (24, 27), (21, 24), (2 << 20, 64 << 20), 128, 6
LAST_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Plan:
    """parts: number of parts; sketch_bits, range_bits: log2 of all counters and of those in a range; group_bits: log2 of the groups."""

    parts: int
    sketch_bits: int
    range_bits: int
    group_bits: int

    @property
    def ranges(self) -> int:
        return 1 << (self.sketch_bits - self.range_bits)


def plan(total_bytes: int, counters_per_window: int = 16, part_bytes: int = PART_BYTES[0], most_part_bytes: int = PART_BYTES[1]) -> Plan:
    """Sizes for so many bytes of text. First parts grow, then ranges and groups, until rows between them are long enough."""
    windows = total_bytes // WINDOW_BYTES
    sketch_bits = max(RANGE_BITS[0], int(windows * counters_per_window).bit_length())
    wanted = ROW_WINDOWS * WINDOW_BYTES << (sketch_bits - RANGE_BITS[0]) if sketch_bits > RANGE_BITS[0] else 0
    each = min(max(part_bytes, wanted), max(part_bytes, most_part_bytes))
    row = lambda rows: each // WINDOW_BYTES // max(1, rows)
    most = min(RANGE_BITS[1], sketch_bits)
    range_bits = next((b for b in range(RANGE_BITS[0], most) if row(1 << (sketch_bits - b)) >= ROW_WINDOWS), most)
    group_bits = next((b for b in range(*GROUP_BITS) if row(windows >> b) >= ROW_WINDOWS), GROUP_BITS[1])
    return Plan(max(1, -(-total_bytes // each)), sketch_bits, range_bits, max(0, (windows >> group_bits).bit_length()))


def packed(values: np.ndarray, range_bits: int) -> bytes:
    """Sorted counters of one range: the low 16 bits of each and the number in each block of 2^16, or, if few, 32 bits each."""
    blocks = 1 << (range_bits - 16)
    if len(values) < 4 * blocks:
        return b"\0" + np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    counts = np.bincount((values >> np.uint64(16)).astype(np.int64) & (blocks - 1), minlength=blocks).astype("<u4")
    return b"\1" + counts.tobytes() + values.astype("<u2").tobytes()


def unpacked(raw: bytes, range_bits: int) -> np.ndarray:
    """The counters inside their range."""
    blocks = 1 << (range_bits - 16)
    if raw[0] == 0:
        wide = np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(4, -1).T).view("<u4").ravel()
        return wide.astype(np.int64) & ((1 << range_bits) - 1)
    counts = np.frombuffer(raw, "<u4", blocks, offset=1)
    return np.repeat(np.arange(blocks, dtype=np.int64) << 16, counts) + np.frombuffer(raw, "<u2", offset=1 + 4 * blocks)


def part_windows(table: pa.Table, size: int) -> tuple[np.ndarray, ...]:
    """(hash, row, begin, n_words): of each window its hash, its text's row, its first word there; per row its words."""
    hashes, rows, begins = [], [], []
    n_words = np.zeros(table.num_rows, np.int64)
    for span, data, offs in wh.chunks(table["_pl_text"]):
        starts, ends, first = wh.word_spans(data, offs)
        values, at = wh.windows(wh.word_hashes(data, starts, ends), first, size)
        row = np.searchsorted(first, at, "right") - 1
        n_words[span] = np.diff(first)
        hashes.append(values)
        rows.append((row + span.start).astype(np.int32))
        begins.append((at - first[row]).astype(np.int32))
    join = lambda arrays, kind: np.concatenate(arrays) if arrays else np.zeros(0, kind)
    return join(hashes, np.uint64), join(rows, np.int32), join(begins, np.int32), n_words


def smallest_ids(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct sorted hashes, smallest id of each, place of each window's hash among them)."""
    if not len(hashes):
        return hashes, ids, np.zeros(0, np.int64)
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    begins = np.flatnonzero(new)
    place = np.empty(len(hashes), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[begins], np.minimum.reduceat(ids[order], begins), place


def _rows(schema: pa.Schema, columns: list) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, for the shuffle's compression."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


_SKETCH = pa.schema([("part", pa.int32()), ("range", pa.int32()), ("data", pa.binary())])
_SENT = pa.schema([("part", pa.int32()), ("range", pa.int32()), ("hashes", pa.binary()), ("ids", pa.binary()), ("sent", pa.binary())])
_SKETCH_SQL = "part int, range int, data binary"
_SENT_SQL = "part int, range int, hashes binary, ids binary, sent binary"


def counters(hashes: np.ndarray, sketch_bits: int) -> np.ndarray:
    return wh.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(64 - sketch_bits)


def _cuts(values: np.ndarray, shift: int, n: int) -> np.ndarray:
    """Where, among sorted values, each of ``n`` ranges of the top bits begins, and the end."""
    return np.searchsorted(values >> np.uint64(shift), np.arange(n + 1, dtype=np.uint64))


def _ids(table: pa.Table) -> np.ndarray:
    return table["_pl_id"].fill_null(LAST_ID).to_numpy().astype(np.int64)


def _split(docs: DataFrame) -> list[Column]:
    """What tells rows of files apart, so that repeated ones are dealt apart; a task that runs again finds the same, as it
    reads the same rows in the same order. Nothing where several files meet in a row."""
    split = [F.input_file_name(), F.input_file_block_start(), F.monotonically_increasing_id()]
    try:
        docs.select(*split)
    except AnalysisException:
        return []
    return split


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 13,
    part_bytes: int = PART_BYTES[0],
    most_part_bytes: int = PART_BYTES[1],
    counters_per_window: int = 16,
    text_out: str = "text",
    words_out: str = "n_words",
    removed_out: str = "n_removed",
) -> DataFrame:
    """``docs`` without the words of windows that also begin in a document with a smaller id.

    ``text_out`` has the words that stay, joined by one space; ``words_out`` and ``removed_out`` (long) count words.
    Windows are judged on the input: the document with the smallest id keeps a passage whole. Null and empty texts
    become empty with 0 words; texts shorter than a window keep all; very long texts are worked on whole, in one part;
    repeated rows with one id do not remove each other's words; ids are compared as 64-bit integers, and an id that is
    null or no such number counts as larger than any; an empty table gives an empty result; other columns pass, and
    output names that exist already, but for the text, are an error. ``part_bytes`` and ``most_part_bytes`` bound the text of a part,
    which a worker holds whole.
    """
    others = [c for c in docs.columns if c != text_out]
    if {words_out.lower(), removed_out.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"columns {words_out!r} and {removed_out!r} must be new")
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    sizes = plan(total, counters_per_window, part_bytes, most_part_bytes)
    parts, sketch_bits, range_bits, ranges, group_bits = sizes.parts, sizes.sketch_bits, sizes.range_bits, sizes.ranges, sizes.group_bits
    base = docs.select(
        F.pmod(F.xxhash64(id_col, text_col, *_split(docs)), F.lit(parts)).cast("int").alias("part"),
        F.col(id_col).try_cast("long").alias("_pl_id"),
        F.col(text_col).alias("_pl_text"),
        F.struct(F.lit(0).alias("_pl_none"), *(F.col(c) for c in others)).alias("_pl_row"),
    )

    def sketch(table: pa.Table) -> pa.Table:
        own = np.unique(counters(part_windows(table, window)[0], sketch_bits))
        cuts, part = _cuts(own, range_bits, ranges), table["part"][0].as_py()
        out = [(part, int(r), packed(own[cuts[r] : cuts[r + 1]], range_bits)) for r in np.flatnonzero(np.diff(cuts))]
        return _rows(_SKETCH, list(zip(*out, strict=True)) or [[], [], []])

    def merge(table: pa.Table) -> pa.Table:
        raw = table["data"].to_pylist()
        increments = [unpacked(x, range_bits) for x in raw]
        ordered = np.sort(np.concatenate(increments))
        several = np.zeros(1 << range_bits, bool)
        several[ordered[1:][ordered[1:] == ordered[:-1]]] = True
        flags = [several[x] for x in increments]
        out = [(p, r, np.packbits(f).tobytes()) for p, r, f in zip(table["part"].to_pylist(), table["range"].to_pylist(), flags, strict=True) if f.any()]
        return _rows(_SKETCH, list(zip(*out, strict=True)) or [[], [], []])

    def bits_of(answers: pa.Table, values: np.ndarray, shift: int, n: int) -> np.ndarray:
        """For each of the sorted values its bit in the answers; False where there is no answer."""
        cuts, out = _cuts(values, shift, n), np.zeros(len(values), bool)
        for r, raw in zip(answers["range"].to_pylist(), answers["data"].to_pylist(), strict=True):
            k = cuts[r + 1] - cuts[r]
            out[cuts[r] : cuts[r + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(k)).astype(bool)
        return out

    def groups_cut(values: np.ndarray) -> np.ndarray:
        if group_bits == 0:
            return np.array([0, len(values)])
        return _cuts(values, 64 - group_bits, 1 << group_bits)

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_SENT, [[]] * 5)
        hashes, rows, _, _ = part_windows(table, window)
        distinct, least, _ = smallest_ids(hashes, _ids(table)[rows])
        own, back = np.unique(counters(distinct, sketch_bits), return_inverse=True)
        suspect = bits_of(answers, own, range_bits, ranges)[back]
        cuts, part = groups_cut(distinct), table["part"][0].as_py()
        out = []
        for g in range(len(cuts) - 1):
            inside = slice(cuts[g], cuts[g + 1])
            if suspect[inside].any():
                out.append((part, g, distinct[inside][suspect[inside]].tobytes(), _planes(least[inside][suspect[inside]]), np.packbits(suspect[inside]).tobytes()))
        return _rows(_SENT, list(zip(*out, strict=True)) or [[]] * 5)

    def group(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        ids = [_from_planes(x) for x in table["ids"].to_pylist()]
        own = np.concatenate(ids)
        _, least, place = smallest_ids(np.concatenate(hashes), own)
        gone, at, out = least[place] < own, 0, []
        for part, g, n, sent in zip(table["part"].to_pylist(), table["range"].to_pylist(), map(len, hashes), table["sent"].to_pylist(), strict=True):
            mask = np.unpackbits(np.frombuffer(sent, np.uint8))
            mask[np.flatnonzero(mask)] = gone[at : at + n]
            if gone[at : at + n].any():
                out.append((part, g, np.packbits(mask).tobytes()))
            at += n
        return _rows(_SKETCH, list(zip(*out, strict=True)) or [[], [], []])

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, rows, begins, n_words = part_windows(table, window)
        ids = _ids(table)
        distinct, least, place = smallest_ids(hashes, ids[rows])
        gone = np.zeros(len(distinct), bool)
        cuts = groups_cut(distinct)
        for g, raw in zip(answers["range"].to_pylist(), answers["data"].to_pylist(), strict=True):
            gone[cuts[g] : cuts[g + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=int(cuts[g + 1] - cuts[g])).astype(bool)
        hit = gone[place] | (least[place] < ids[rows])
        base_word = np.concatenate([[0], np.cumsum(n_words)])
        edges = np.zeros(base_word[-1] + 1, np.int64)
        at = base_word[rows[hit]] + begins[hit]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + window, -1)
        keep = np.cumsum(edges)[:-1] == 0
        kept_before = np.concatenate([[0], np.cumsum(keep)])
        removed = n_words - np.diff(kept_before[base_word])
        texts = []
        for i, text in enumerate(table["_pl_text"].to_pylist()):
            found = (text or "").encode().split()
            if removed[i]:
                found = compress(found, keep[base_word[i] : base_word[i + 1]].tolist())
            texts.append(b" ".join(found).decode())
        columns = [table["_pl_row"].combine_chunks(), pa.array(texts, pa.string()), pa.array(n_words), pa.array(removed)]
        return pa.Table.from_arrays(columns, names=["_pl_row", "_pl_text", "_pl_words", "_pl_removed"])

    by_part = lambda df: df.groupBy("part")
    marked = by_part(base).applyInArrow(sketch, _SKETCH_SQL).groupBy("range").applyInArrow(merge, _SKETCH_SQL)
    sent = by_part(base).cogroup(by_part(marked)).applyInArrow(send, _SENT_SQL)
    gone = sent.groupBy("range").applyInArrow(group, _SKETCH_SQL)
    schema = StructType([StructField("_pl_row", base.schema["_pl_row"].dataType), StructField("_pl_text", StringType()), StructField("_pl_words", LongType()), StructField("_pl_removed", LongType())])
    done = by_part(base).cogroup(by_part(gone)).applyInArrow(cut, schema)
    columns = [F.col("_pl_text").alias(c) if c == text_out else F.col("_pl_row")[c].alias(c) for c in docs.columns]
    columns += [] if text_out in docs.columns else [F.col("_pl_text").alias(text_out)]
    return done.select(*columns, F.col("_pl_words").alias(words_out), F.col("_pl_removed").alias(removed_out))
