"""Similarity join on word n-grams with adaptive multi-match prefixes.

A document is the set of its distinct 5-word shingles; equal sets are one class and are handled once. Tokens are ordered
from rare to frequent by a bounded table made from counts over all texts, less the tokens that stand once in a worker's
batch: these counts are too low by that, depend on the partitioning, and decide the costs but no link. Sets of Jaccard
similarity t or more share at least l tokens of their prefixes when a prefix is the first n - ceil(t n) + l tokens; each
set picks its l where the longer index costs less than the candidates it is expected to spare. A pair has to share the
smaller l of the two, and so many that what lies behind the prefixes can still make up the overlap which its two sizes
ask for.

The index is dealt by token in packed blocks. Tokens of few sets give their pairs at once. Tokens of many sets first give
one link to a leader each, the member that shares most with the others. Once links are verified and joined to
components, only sets that still meet others of a different component are compared again: those outside a group's
largest component in blocks against all, so groups of near copies never expand into all their pairs and no link
between components is lost. Groups of so many blocks that a set would be copied more often than it has prefix tokens are
compared token by token of a second prefix, over the tokens still open. Pairs are verified exactly on the whole sets.
Nothing but bounded tables is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from plinth.llm import wordhash as wh
from plinth.llm.common import settle, shuffle_width
from plinth.llm.components import components

#: log2 of the slots of the frequency table; least total that counts as frequent.
SLOT_BITS, FREQUENT = 22, 12
#: Tokens of up to so many sets give all pairs at once; blocks are kept to about so many entries.
SMALL, BLOCK_ENTRIES = 8, 600_000
#: Tokens in a row of the counts.
STATS_ROW = 1 << 16
#: Tokens that a worker holds before it counts them or deals them out; they bound its memory.
HELD_TO_COUNT, HELD_TO_DEAL = 3_000_000, 1_200_000
#: Sets in one block of the late comparison.
LATE_SETS = 8192
#: Partners a set names in the round before the one that names all.
LIKELIEST = 4
#: Index entries that one candidate is worth, and the part of a set that its prefix may at most be lengthened by.
CANDIDATE_COST, MOST_LONGER = 4.0, 8
#: Tokens in sets of this frequency class or above never meet in one block: their entries are spread over the blocks.
SPREAD_CLASS = 14


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words has the whole sequence as its one shingle."""
    for _, data, offs in wh.chunks(texts):
        starts, ends, first = wh.word_spans(data, offs)
        words = wh.word_hashes(data, starts, ends, lower=True)
        values, begins = wh.windows(words, first, size)
        cuts = np.searchsorted(begins, first)
        for i in range(len(offs) - 1):
            if cuts[i + 1] > cuts[i]:
                own = np.sort(values[cuts[i] : cuts[i + 1]])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif first[i + 1] > first[i]:
                yield wh.windows(words[first[i] : first[i + 1]], np.array([0, first[i + 1] - first[i]]), int(first[i + 1] - first[i]))[0]
            else:
                yield np.zeros(0, np.uint64)


def set_key(tokens: np.ndarray) -> int:
    """64-bit name of a set; sets of different content meet in one with chance 2^-64 a pair."""
    folded = wh.mix(tokens).sum(dtype=np.uint64, keepdims=True) + np.array([len(tokens)], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(wh.mix(folded).view(np.int64)[0])


def least_overlap(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with a set it is linked to."""
    return -(-percent * n // 100)


def prefix_plan(frequency: np.ndarray, percent: int) -> tuple[int, int]:
    """(length, l) of the prefix of a set whose tokens, rare first, have these estimated frequencies.

    At most sum(frequency) / l sets share l tokens of a prefix; the plan weighs that against the entries it adds.
    """
    n = len(frequency)
    base, t = n - least_overlap(n, percent), least_overlap(n, percent)
    ls = np.unique(np.minimum([1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256], max(1, min(t, n // MOST_LONGER))))
    sums = np.cumsum(frequency)
    cost = base + ls + CANDIDATE_COST * sums[base + ls - 1] / ls
    best = int(ls[np.argmin(cost)])
    return base + best, best


def needed_matches(n_a, n_b, l_a, l_b, percent: int, least, greatest, up):
    """Prefix tokens that a linked pair shares at least, for columns or arrays.

    Common tokens are in both prefixes, or behind the one that ends first, which leaves ceil(t n) - l tokens there.
    """
    behind = greatest(up(percent * n_a, 100) - l_a, up(percent * n_b, 100) - l_b)
    return greatest(least(l_a, l_b), up(percent * (n_a + n_b), 100 + percent) - behind)


def _enough(percent: int):
    up = lambda x, d: F.call_function("div", x + (d - 1), F.lit(d))
    return needed_matches(*(F.col(c) for c in ("n_a", "n_b", "l_a", "l_b")), percent, F.least, F.greatest, up)


_STATS_SQL = "kind int, doc_id long, n long, key long, tokens array<long>, counts array<int>"
_STATS = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("tokens", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])
_BLOCK_SQL = "block int, spread boolean, tokens binary, owners binary, sets binary"
_BLOCK = pa.schema([("block", pa.int32()), ("spread", pa.bool_()), ("tokens", pa.binary()), ("owners", pa.binary()), ("sets", pa.binary())])
_FOUND_SQL = "kind int, a long, b long, x long, y long"
_FOUND = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])
PAIR, ENTRY, INFO = 0, 1, 2
_SET = np.dtype([("key", "<i8"), ("n", "<i8"), ("l", "<i8")])


def _stats(size: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, n_held = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            tokens, counts = tokens[counts > 1].view(np.int64), counts[counts > 1].astype(np.int32)
            for i in range(0, len(tokens), STATS_ROW):
                row = pa.array([len(tokens[i : i + STATS_ROW])], pa.int32())
                offsets = pa.concat_arrays([pa.array([0], pa.int32()), row])
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x[i : i + STATS_ROW])) for x in (tokens, counts)]
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), *[pa.nulls(1, pa.int64())] * 3, *lists], schema=_STATS)

        for batch in batches:
            ns, keys = [], []
            for tokens in shingle_sets(batch.column(1), size):
                key = set_key(tokens)
                ns.append(len(tokens))
                keys.append(key)
                if key not in seen and len(tokens):
                    held.append(tokens)
                    n_held += len(tokens)
                    seen.add(key)
                if n_held > HELD_TO_COUNT:
                    yield from flush()
                    held, n_held, seen = [], 0, set()
            none = lambda kind: pa.nulls(len(ns), kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ns), np.int32)), batch.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.int64()), none(_STATS.field("tokens").type), none(_STATS.field("counts").type)], schema=_STATS)
        yield from flush()

    return wh.tidied(scan)


def frequency_table(stats: DataFrame) -> np.ndarray:
    """Class of each slot: bit length of the largest total of a frequent token there, 0 for none. Of fixed size.

    Totals are summed by token on the map side first; at most one row a slot comes to the driver.
    """
    counted = stats.filter("kind = 1").select(F.explode(F.arrays_zip("tokens", "counts")).alias("x")).groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("n"))
    slot = F.call_function("shiftrightunsigned", F.col("token"), F.lit(64 - SLOT_BITS)).cast("int")
    often = counted.filter(F.col("n") >= FREQUENT).groupBy(slot.alias("slot")).agg(F.max("n").alias("n"))
    found = often.select("slot", (F.floor(F.log2("n")) + 1).cast("byte").alias("class")).toArrow()
    table = np.zeros(1 << SLOT_BITS, np.uint8)
    table[found["slot"].to_numpy()] = found["class"].to_numpy()
    return table


def _index(size: int, percent: int, blocks: int, classes):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets, tokens, owners, n_held, turn = [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            if not sets:
                return
            token, owner, table = np.concatenate(tokens), np.concatenate(owners), np.array(sets, _SET)
            tokens.clear()
            owners.clear()
            spread = classes.value[(token >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] >= SPREAD_CLASS
            block = ((token >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int32)
            turn += 1
            block[spread] = blocks + (owner[spread] + turn) % blocks
            order = np.argsort(block, kind="stable")
            cuts = np.searchsorted(block[order], np.arange(2 * blocks + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[b] : cuts[b + 1]]
                used, place = np.unique(owner[own], return_inverse=True)
                row = (int(b) % blocks, bool(b >= blocks), token[own].tobytes() if b >= blocks else _low(token[own]), place.astype("<u2" if len(used) < 65536 else "<u4").tobytes(), table[used].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, _BLOCK, strict=True)], schema=_BLOCK)

        for batch in batches:
            for found in shingle_sets(batch.column(0), size):
                if not len(found) or (key := set_key(found)) in seen:
                    continue
                seen.add(key)
                rank = classes.value[(found >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                order = np.argsort((rank.astype(np.uint64) << np.uint64(58)) | (found >> np.uint64(6)))
                length, l = prefix_plan(np.exp2(rank[order].astype(np.float64)), percent)
                tokens.append(found[order[:length]])
                owners.append(np.full(length, len(sets), np.int32))
                sets.append((key, len(found), l))
                n_held += length
                if n_held > HELD_TO_DEAL:
                    yield from flush()
                    seen, sets, tokens, owners, n_held = set(), [], [], [], 0
        yield from flush()

    return wh.tidied(scan)


def _low(tokens: np.ndarray) -> bytes:
    """The low 40 bits; with the block they tell tokens apart well enough to find candidates."""
    return np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_low(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def _found(kind: int, a: np.ndarray, b: np.ndarray | None = None, x: np.ndarray | None = None, y: np.ndarray | None = None) -> pa.Table:
    n = len(a)
    fill = lambda v: pa.nulls(n, pa.int64()) if v is None else pa.array(np.asarray(v, np.int64))
    return pa.Table.from_arrays([pa.array(np.full(n, kind, np.int32)), fill(a), fill(b), fill(x), fill(y)], schema=_FOUND)


def _probe(percent: int):
    def probe(table: pa.Table) -> pa.Table:
        """Pairs of the tokens of few sets, entries of those of many, and what is known of the sets in either."""
        tokens, owners, sets, at = [], [], [], 0
        for spread, t, o, s in zip(table["spread"].to_pylist(), table["tokens"].to_pylist(), table["owners"].to_pylist(), table["sets"].to_pylist(), strict=True):
            own = np.frombuffer(s, _SET)
            tokens.append(np.frombuffer(t, np.uint64) if spread else _from_low(t))
            owners.append(np.frombuffer(o, "<u2" if len(own) < 65536 else "<u4").astype(np.int64) + at)
            sets.append(own)
            at += len(own)
        token, owner, known = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sets)
        keys, where, back = np.unique(known["key"], return_index=True, return_inverse=True)
        known, owner = known[where], back[owner]
        if table["spread"][0].as_py():
            return pa.concat_tables([_found(ENTRY, token.view(np.int64), keys[owner]), _found(INFO, keys, None, known["n"], known["l"])])
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[fresh], owner[fresh]
        begins = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(begins, len(token)))
        firsts, seconds = [], []
        for m in range(2, SMALL + 1):
            groups = begins[sizes == m]
            for i in range(m):
                for j in range(i + 1, m):
                    firsts.append(owner[groups + i])
                    seconds.append(owner[groups + j])
        a, b = np.concatenate(firsts), np.concatenate(seconds)
        n = known["n"]
        fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        code, counts = np.unique(a[fits] * len(keys) + b[fits], return_counts=True)
        a, b = code // max(1, len(keys)), code % max(1, len(keys))
        many = np.repeat(sizes > SMALL, sizes)
        # Tokens of one block differ in the bits that are left, so the block has to be part of their name.
        name = wh.mix(token[many] + np.uint64(table["block"][0].as_py() + 1) * np.uint64(1 << 41)).view(np.int64)
        used = np.unique(np.concatenate([a, b, owner[many]]))
        return pa.concat_tables([_found(PAIR, keys[a], keys[b], counts), _found(ENTRY, name, keys[owner[many]]), _found(INFO, keys[used], None, n[used], known["l"][used])])

    return probe


def _slots(doc_id, bits: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << bits))


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of set keys whose sets are similar enough, compared token by token.

    Only documents that a bitmap of bounded size lets through are hashed again.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    needed = classes.join(ends, "key", "left_semi").select("doc_id", "key").persist(StorageLevel.DISK_ONLY)
    count = needed.count()
    bits = min(26, max(16, (16 * count).bit_length()))
    slot = _slots(F.col("doc_id"), bits)
    words = needed.select(F.call_function("div", slot, F.lit(32)).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int")).alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    needed.unpersist()
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(bitmap)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            slots = batch.column(1).to_numpy()
            batch = batch.filter(pa.array((shared.value[slots >> 5] >> (slots & 31).astype(np.uint32) & 1).astype(bool)))
            keys, sets = [], []
            for tokens in shingle_sets(batch.column(0), size):
                if len(tokens) and (key := set_key(tokens)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    # 48 bits: two different tokens of a pair of sets of a thousand look alike once in 10^8 pairs
                    sets.append(np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], ["key", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tokens(raw) -> np.ndarray:
            out = np.zeros((len(raw) // 6, 8), np.uint8)
            out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
            return out.view(np.uint64).ravel()

        for batch in batches:
            keep, last, a = [], None, None
            for key, x, y in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if key != last:
                    last, a = key, tokens(x.as_buffer())
                b = tokens(y.as_buffer())
                at = np.searchsorted(a, b)
                common = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = docs.select("text", _slots(F.col("doc_id"), bits).alias("slot")).mapInArrow(wh.tidied(load), "key long, tokens binary")
    sets = sets.join(ends, "key", "left_semi").groupBy("key").agg(F.first("tokens").alias("tokens"))
    first = pairs.join(sets.select(F.col("key").alias("a"), F.col("tokens").alias("x")), "a")
    both = first.join(sets.select(F.col("key").alias("b"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(wh.tidied(compare), "a long, b long")


def _open_entries(entries: DataFrame, joined: DataFrame, info: DataFrame) -> DataFrame:
    """(token, key, label, first) of the tokens that sets of several components meet in, without hopeless sets.

    A set that holds k open tokens, fewer than its own l, can only be linked to a set with an l of at most k, and has to
    share that many tokens with it: it needs at least as many tokens in which such sets stand as the least of their l.
    """
    placed = entries.join(joined.withColumnRenamed("node", "key"), "key", "left").join(info.select("key", "l"), "key").select("token", "key", "l", F.coalesce("label", "key").alias("label"))
    met = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("l").alias("least")).filter("low <> high").select("token", "least")
    held = placed.join(met, "token").groupBy("key").agg(F.first("l").alias("l"), F.collect_list("least").alias("leasts"))
    within = F.filter("leasts", lambda x: x <= F.size("leasts"))
    held = held.filter((F.size("leasts") >= F.col("l")) | (F.size(within) >= F.coalesce(F.array_min(within), F.lit(1 << 30)))).select("key")
    placed = placed.join(held, "key", "left_semi")
    split = placed.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("key").alias("first")).filter("low <> high").select("token", "first")
    return settle(placed.drop("l").join(split, "token"), "open-entries")


def _open_sets(open_entries: DataFrame, info: DataFrame) -> DataFrame:
    """(key, tokens, least, g, n, l): sets with their open tokens, rare ones first, and the least l of a set they meet in one.

    Sets that meet over these tokens, even at second hand, form a group g.
    """
    groups = components(open_entries.select(F.col("first").alias("a"), F.col("key").alias("b")).distinct())
    known = open_entries.select("token", "key").join(info.select("key", "l"), "key")
    met = known.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("l").alias("least"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("m", "token"))), lambda x: x["token"])
    tokens = known.join(met, "token").groupBy("key").agg(ordered.alias("tokens"), F.min("least").alias("least"))
    return settle(tokens.join(groups.select(F.col("node").alias("key"), F.col("label").alias("g")), "key").join(info.select("key", "n", "l"), "key"), "open-sets")


def _late_pairs(sets: DataFrame, joined: DataFrame, percent: int, likeliest: int | None = None) -> DataFrame:
    """(a, b): pairs of the open sets that share enough of the open tokens and are in different components.

    Of a group the sets outside its largest component are compared in blocks with each other and with blocks of the
    largest one; two sets of that component never are. A group of more blocks than its sets have prefix tokens is compared
    token by token instead: a pair shares at least the smaller l of the two, so many tokens that the rarest of them is
    among the first h - min(l, least) + 1 of the h open tokens of either set. A set is thus copied about as often as it has
    such tokens at most, and the blocks of a token are the sets that stand at it.
    With ``likeliest``, a set names in each comparison only so many partners, those that it shares most with.
    """
    sets = sets.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    prefix = F.slice("tokens", 1, F.greatest(F.lit(1), F.size("tokens") - F.least("l", "least").cast("int") + 1))
    sets = sets.withColumn("prefix", prefix)
    heavy = sets.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.sum(F.size("prefix")).alias("p")).filter(F.col("m") * F.col("m") > F.col("p") * LATE_SETS).select("g", F.lit(True).alias("by_token"))
    unit = F.when(F.col("by_token"), F.col("prefix")).otherwise(F.array(F.lit(0).cast("long")))
    sets = sets.join(heavy, "g", "left").select("g", F.explode(unit).alias("unit"), "key", "label", "n", "l", "tokens")
    sizes = sets.groupBy("g", "unit", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("g", "unit").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("all"))
    sizes = sizes.select("g", "unit", F.col("top.label").alias("main"), F.ceil(F.col("top.m") / LATE_SETS).alias("mains"), F.ceil((F.col("all") - F.col("top.m")) / LATE_SETS).alias("rests")).filter("rests > 0")
    dealt = sets.join(sizes, ["g", "unit"]).withColumn("is_main", F.col("label") == F.col("main"))
    block = F.pmod(F.xxhash64("key"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests")))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    cell = lambda i, kind, j: F.struct(i.alias("i"), F.lit(kind).alias("kind"), j.alias("j"))
    own = F.col("block")
    against_main = F.transform(upto(F.col("mains")), lambda j: cell(own, "main", j))
    among_rest = F.transform(upto(F.col("rests")), lambda j: cell(F.least(own, j), "rest", F.greatest(own, j)))
    cells = F.when(F.col("is_main"), F.transform(upto(F.col("rests")), lambda i: cell(i, "main", own))).otherwise(F.concat(against_main, among_rest))
    dealt = dealt.withColumn("block", block).select("g", "unit", F.explode(cells).alias("cell"), "key", "label", "n", "l", "tokens", "is_main")

    def compare(table: pa.Table) -> pa.Table:
        keys, labels, n, l = (table[c].to_numpy() for c in ("key", "label", "n", "l"))
        main = table["is_main"].to_numpy()
        tokens = table["tokens"].combine_chunks()
        flat, cuts = tokens.flatten().to_numpy(), np.concatenate([[0], np.cumsum(tokens.value_lengths().to_numpy())])
        order = np.argsort(flat, kind="stable")
        ordered, owner = flat[order], np.repeat(np.arange(len(keys)), np.diff(cuts))[order]
        firsts, seconds = [], []
        held = np.diff(cuts)
        for x in np.flatnonzero(~main):
            need = needed_matches(n, n[x], l, l[x], percent, np.minimum, np.maximum, lambda v, d: -(-v // d))
            fit = (labels != labels[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x])) & (np.minimum(held, held[x]) >= need)
            if not fit.any():
                continue
            own = flat[cuts[x] : cuts[x + 1]]
            lows, highs = np.searchsorted(ordered, own, "left"), np.searchsorted(ordered, own, "right")
            spans = sorted(zip(highs - lows, lows, highs, strict=True))
            # A partner misses all but ``need`` of the tokens at most, so it stands at one of the rarest that remain.
            rare = len(spans) - int(need[fit].min()) + 1
            met = np.concatenate([owner[i:j] for _, i, j in spans[:rare]])
            if not fit[met].any():
                continue
            met = np.concatenate([met, *(owner[i:j] for _, i, j in spans[rare:])])
            counts = np.bincount(met, minlength=len(keys))
            found = np.flatnonzero(fit & (counts >= need))
            if likeliest is not None and len(found) > likeliest:
                found = found[np.argsort(-counts[found], kind="stable")[:likeliest]]
            other = keys[found]
            firsts.append(np.minimum(other, keys[x]))
            seconds.append(np.maximum(other, keys[x]))
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        found = np.unique(np.stack([join(firsts), join(seconds)], axis=1), axis=0)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    # The rows are few and cost much, so they are spread over all tasks, which their size would not make Spark do.
    spread = dealt.repartition(shuffle_width(dealt.sparkSession), "g", "unit", "cell")
    return spread.groupBy("g", "unit", "cell").applyInArrow(compare, "a long, b long").distinct()


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Per document: id, n_shingles, set_key and component_id, the smallest id reachable over links.

    Sets A and B link when 100 |A & B| >= percent |A | B|. Words are cut at ASCII white space and compared with A-Z in
    lower case. Null, empty and blank texts have no shingle and link with nothing: their component is their own
    id. Very long texts are compared whole. Exact copies link through their class; repeated rows are copies; ids are
    64-bit integers, and what is no such number counts as null; null ids never name a component unless it has no other;
    an empty table gives an empty result; extra columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).try_cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    stats = settle(base.mapInArrow(_stats(size), _STATS_SQL), "shingle-sets")
    own = stats.filter("kind = 0").select("doc_id", "n", "key")
    filled = own.filter("n > 0")
    # The class of a set is read from any one of its documents.
    classes = filled.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    total = own.agg(F.sum("n")).first()[0] or 0
    frequent = spark.sparkContext.broadcast(frequency_table(stats))
    blocks = max(1, -(-(total * (100 - percent + 8) // 100) // BLOCK_ENTRIES))
    index = base.select("text").mapInArrow(_index(size, percent, blocks, frequent), _BLOCK_SQL)
    found = settle(index.groupBy("block", "spread").applyInArrow(_probe(percent), _FOUND_SQL), "prefix-matches")

    entries = found.filter(F.col("kind") == ENTRY).select(F.col("a").alias("token"), F.col("b").alias("key")).distinct()
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("g"))
    info = found.filter(F.col("kind") == INFO).groupBy(F.col("a").alias("key")).agg(F.max("x").alias("n"), F.max("y").alias("l"))
    info = settle(info.join(shared, "key", "left").select("key", "n", "l", F.coalesce("g", F.lit(0)).alias("g")), "prefix-sets")
    side = lambda c: info.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.col("l").alias(f"l_{c}"), F.col("g").alias(f"g_{c}"))
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    enough = _enough(percent)
    pairs = found.filter(F.col("kind") == PAIR).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("x").alias("c"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.col("c") + F.least("g_a", "g_b") >= enough).select("a", "b")

    # The leader of a token is its set that shares most: in a group of near copies the one next to their common origin.
    met = entries.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    weight = entries.join(met, "token").groupBy("key").agg(F.sum("m").alias("w"))
    leaders = entries.join(weight, "key").groupBy("token").agg(F.max_by("key", F.struct("w", "key")).alias("a"))
    stars = entries.withColumnRenamed("key", "b").join(leaders, "token").filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    stars = stars.join(side("a"), "a").join(side("b"), "b").filter(fits & (F.col("c") >= enough)).groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a"))
    first = settle(pairs.unionByName(stars.select("a", "b")).distinct(), "candidates")
    links = settle(verified(base, classes, first, size, percent), "verified")
    joined = components(links)

    # What remains: pairs in different components that meet only in tokens of many sets. Likely partners come first,
    # as what they join needs no further pairs; the last round leaves none out.
    open_entries = _open_entries(entries, joined, info)
    if not open_entries.isEmpty():
        sets = _open_sets(open_entries, info)
        for likeliest in (LIKELIEST, None):
            late = settle(_late_pairs(sets, joined, percent, likeliest).join(first, ["a", "b"], "left_anti"), "late-candidates")
            if late.isEmpty():
                continue
            first = first.unionByName(late)
            links = links.unionByName(settle(verified(base, classes, late, size, percent), "late-verified"))
            joined = components(links)

    labelled = filled.join(joined.withColumnRenamed("node", "key"), "key", "left").select("doc_id", "n", "key", F.coalesce("label", "key").alias("label"))
    names = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    full = labelled.join(names, "label").select("doc_id", "n", "key", "component_id")
    bare = own.filter("n = 0").select("doc_id", "n", "key", F.col("doc_id").alias("component_id"))
    return full.unionByName(bare).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("key").alias("set_key"), "component_id")


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all columns; repeated rows stay once.

    Rows with a null id cannot be told apart by it, so they all stay; texts without a word stay. An empty table
    gives an empty result.
    """
    found = similar_classes(docs.select(F.col(id_col), F.col(text_col)), id_col=id_col, text_col=text_col, size=size, percent=percent)
    stay = found.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_pl_id")).distinct()
    named = docs.filter(F.col(id_col).isNotNull())
    kept = named.join(stay, F.col(id_col) == F.col("_pl_id"), "left_semi").withColumn("_pl_text", F.xxhash64(text_col)).dropDuplicates([id_col, "_pl_text"]).drop("_pl_text")
    return kept.unionByName(docs.filter(F.col(id_col).isNull()))
