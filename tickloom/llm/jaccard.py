"""Jaccard self-join of word-shingle sets, size-aware.

Small sets, for which that is cheaper, are joined by enumerating subsets: sets of
n and m shingles are linked if and only if they share a subset of a fixed size,
the least intersection that links these sizes, so each lists its subsets of that
size for every size a partner can have.  Large sets scan inverted lists: the
shingles of a set are put in one order for all sets, rarest first, and a set is
in the lists of its first few, so many that two linked sets meet in one.  How rare
a shingle is comes from counts over all sets, in a table of fixed size; a shingle
of a passage that many texts share comes last, so its list is hardly ever kept.
The boundary between the two is where a set's subsets come to cost more than its
lists: their entries and the candidates that these make, one each at most, as the
mean length of lists measured on the same counts has it.

Equal sets are one node from the start.  In each list all nodes are first held
against the smallest only; pairs within a component found so are not looked at
again, the remaining pairs of a list are.  Sizes, places in the lists and sketches
as wide as the sets drop a pair that cannot link, and every other candidate is
confirmed on the whole texts, so the links are exact.

Components need no more than that.  A count of all links does: a link joins two
sets of one component, so within each component all sets of sizes that can link
are held against each other, tile by tile, and nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, components, forget, lookup, materialize, release, small_batches, thrifty
from .shingles import Words, mix, shingles

#: Words in a shingle, and the least similarity in percent.
WORDS, PERCENT = 5, 80
#: Sizes of a class of sets that long lists are cut by reach from its first size to this many times it, or to its largest partner.
CLASS = 1.5
#: Independent cuts into blocks tried for a set that leaves a block empty.
CUTS = 3
#: Counters of the table that tells rare shingles from frequent ones, and how many of them make a row.
COUNTERS, PER_ROW = 1 << 22, 1 << 18
#: Steps of a level of that table for each doubling of a count.
STEPS = 8
#: Bits of a sketch: as many as shingles, between these.
LEAST_BITS, MOST_BITS = 512, 1 << 17
#: Lists longer than this are cut into parts by further keys, so many times at most, before their pairs are formed.
LONGEST, SEEDS = 4096, 2
#: Nodes of a list on one side of a tile, about: a list's pairs are formed tile by tile.
LIST_TILE = 512
#: What a candidate pair costs in rows of a list: its ids, sizes and narrow sketches against key, node, size and place.
PAIR_COST = (16 + 2 * (8 + LEAST_BITS // 8)) / 24
#: Rounds in which only the likeliest pair of a node and a component is confirmed.
ROUNDS = 2
#: Bits of the filters for the documents that are read again, at most.
FILTER_BITS = 1 << 25
#: Texts and shingles that are confirmed against one centre in one group, about.
GROUP_TEXTS, GROUP_SHINGLES = 512, 1 << 21
#: Sets and shingles on one side of a tile, about; shingles looked at together in it.
TILE_SETS, TILE_SHINGLES, TILE_WIDTH = 1024, 1 << 19, 2048


@dataclass(frozen=True)
class Rule:
    """A link: 100 * intersection >= percent * union, over sets of shingles of so many words."""

    percent: int = PERCENT
    words: int = WORDS

    def most_partner(self, n: int) -> int:
        """Size of the largest set that can link with one of size ``n``."""
        return n * 100 // self.percent

    def least_partner(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def overlap(self, n: int, m: int) -> int:
        """Least intersection that links sets of sizes ``n`` and ``m``."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def prefix(self, n: int) -> int:
        """Rarest shingles of a set of size ``n`` of which a linked set has one among its own."""
        return n - self.least_partner(n) + 1

    def partners(self, n: int) -> list[tuple[int, int]]:
        """Sizes that can link with ``n`` and the size of the subset that then is shared; equal sets are no pair."""
        found = [(m, self.overlap(n, m)) for m in range(self.least_partner(n), self.most_partner(n) + 1)]
        return [(m, c) for m, c in found if c <= min(n, m) and (m != n or c < n)]

    def subsets(self, n: int) -> int:
        return sum(comb(n, c) for _, c in self.partners(n))

    def boundary(self, others: float) -> int:
        """Smallest size whose subsets cost more than its lists, an entry of a list costing itself and ``others`` further rows."""
        n = 1
        while self.subsets(n) <= self.prefix(n) * (1 + others):
            n += 1
        return n

    def blocks(self, largest: int) -> int:
        """Blocks for linked pairs whose smaller set has at most ``largest``: their possible differences and one."""
        return 1 + (largest + self.most_partner(largest)) * (100 - self.percent) // (100 + self.percent)

    @cached_property
    def class_edges(self) -> tuple[int, ...]:
        """First sizes of classes such that linked sets are in one class or in neighbouring ones."""
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(int(edges[-1] * CLASS) + 1, self.most_partner(edges[-1]) + 1))
        return tuple(edges)


def subset_keys(h: np.ndarray, rule: Rule, boundary: int) -> np.ndarray:
    """A key for every subset that a set can share with a linked one of under ``boundary`` shingles.

    Subset and both sizes make the key: sets of these two sizes that have one in common are linked.
    """
    m, n, out = mix(h), len(h), []
    for partner, size in rule.partners(n):
        if partner >= boundary:
            continue
        left_out = list(combinations(range(n), n - size))
        gone = m[np.array(left_out, dtype=np.int64).reshape(len(left_out), n - size)]
        sums = m.sum(dtype=np.uint64) - gone.sum(axis=1, dtype=np.uint64)
        out.append(mix(sums + mix(np.array([(min(n, partner) << 32) + max(n, partner)], dtype=np.uint64))))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def rarest(h: np.ndarray, levels: np.ndarray, k: int) -> np.ndarray:
    """The first ``k`` of a set's sorted hashes by level, then by hash: one order for all sets."""
    rank = levels[(h & np.uint64(len(levels) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
    at = np.flatnonzero(rank <= np.partition(rank, k - 1)[k - 1]) if k < len(h) else np.arange(len(h))
    return h[at[np.argsort(rank[at], kind="stable")][:k]]


def block_keys(h: np.ndarray, rule: Rule, seed: int) -> np.ndarray:
    """Keys of a set, h sorted, of which two linked sets share one at least, under each seed.

    Hashes cut the universe into one block more than the shingles in which two
    linked sets of a class can differ, so these agree on a whole block.
    """
    n, edges = len(h), rule.class_edges
    cls = int(np.searchsorted(edges, n, "right")) - 1
    out = _blocks_of(h, cls, rule.blocks(edges[cls + 1] - 1), seed)
    if cls and n <= rule.most_partner(edges[cls] - 1):
        out += _blocks_of(h, cls - 1, rule.blocks(edges[cls] - 1), seed)
    return np.unique(np.concatenate(out))


def _blocks_of(h: np.ndarray, cls: int, count: int, seed: int) -> list[np.ndarray]:
    """A key for every block that is not empty; another ``seed`` cuts the universe elsewhere.

    Two sets that agree on nothing but empty blocks both have one, so each of
    them is cut a second and third time by other hashes, and at the last cut
    the empty blocks get keys too.
    """
    out, k = [], np.arange(count, dtype=np.uint64)
    for cut in range(CUTS):
        own = np.sort(mix(h + np.uint64(seed * CUTS + cut)))
        edge = np.searchsorted(own, np.append(np.zeros(1, np.uint64), (k[1:] * (np.uint64(2**64 - 1) // np.uint64(count)))))
        edge = np.append(edge, len(own))
        total = np.append(np.zeros(1, np.uint64), np.cumsum(mix(own), dtype=np.uint64))
        sums, held = total[edge[1:]] - total[edge[:-1]], np.diff(edge)
        tag = np.uint64(((seed * 100 + cls) * CUTS + cut + 1) * 0x2545F4914F6CDD1D % 2**64)
        keys = mix(mix(sums + held.astype(np.uint64)) + mix(k + tag))
        full = held > 0
        out.append(keys[full] if cut < CUTS - 1 else keys)
        if full.all():
            break
    return out


def sketch(h: np.ndarray) -> np.ndarray:
    """Bits that are each the parity of the shingles that fall on it: two sets differ in as many bits at most as in shingles.

    The upper half folded onto the lower is the sketch of half the width.
    """
    width = min(max(LEAST_BITS, 1 << max(len(h) - 1, 0).bit_length()), MOST_BITS)
    odd = np.bincount((mix(h) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def narrowed(bits: np.ndarray) -> np.ndarray:
    """The same sketch, folded to the least width."""
    while len(bits) > LEAST_BITS // 64:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


#: Words of a narrow sketch, which every set has; sets of more shingles than its bits have a wide one too.
_NARROW = tuple(f"s{i}" for i in range(LEAST_BITS // 64))
_SIG = pa.schema([*((c, pa.int64()) for c in ("doc_id", "n", "h1", "h2", *_NARROW)), ("sketch", pa.list_(pa.int64())), ("at", pa.int32()), ("counts", pa.binary())])


def _digest(h: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(h.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n, h1, h2, s0.., sketch`` for every row: set size, the set's 128-bit digest, its sketches; and, with the other columns
    null, ``at, counts``: in how many of a task's sets the shingles of each counter are, in rows of ``PER_ROW`` counters."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Words(), np.zeros(COUNTERS, np.uint32)
        for b in batches:
            n, digests, bits, narrow, ends = [], [], [], [], [0]
            for text in b.column(1).to_pylist():
                h = shingles(text, seen, rule.words)
                n.append(len(h))
                digests.append(_digest(h))
                bits.append(sketch(h))
                narrow.append(narrowed(bits[-1]))
                if len(bits[-1]) == len(_NARROW):
                    bits[-1] = bits[-1][:0]
                ends.append(ends[-1] + len(bits[-1]))
                np.add.at(total, (h & np.uint64(COUNTERS - 1)).astype(np.int64), np.uint32(1))
            flat = np.concatenate(bits) if bits else np.empty(0, np.int64)
            pair, narrow = np.array(digests, np.int64).reshape(-1, 2), np.array(narrow, np.int64).reshape(-1, len(_NARROW))
            none = [pa.nulls(b.num_rows, f.type) for f in list(_SIG)[-2:]]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), *[pa.array(x) for x in np.ascontiguousarray(narrow.T)], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), *none], schema=_SIG
            )
        packed = [(i, zstandard.compress(total[i * PER_ROW : (i + 1) * PER_ROW].tobytes(), 1)) for i in range(COUNTERS // PER_ROW) if total[i * PER_ROW : (i + 1) * PER_ROW].any()]
        if packed:
            none = [pa.nulls(len(packed), f.type) for f in list(_SIG)[:-2]]
            yield pa.RecordBatch.from_arrays([*none, pa.array([i for i, _ in packed], pa.int32()), pa.array([x for _, x in packed], pa.binary())], schema=_SIG)

    return _texts(docs).mapInArrow(thrifty(sign), "doc_id bigint, n bigint, h1 bigint, h2 bigint, " + ", ".join(f"{c} bigint" for c in _NARROW) + ", sketch array<bigint>, at int, counts binary")


def levels_of(counts: DataFrame) -> np.ndarray:
    """A byte for each counter that grows with the logarithm of its sum over ``counts(at, counts)``: some MB, whatever the input.

    A task adds up rows as they come, so it holds the counters of its rows only.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = np.frombuffer(zstandard.decompress(x), np.uint32).astype(np.int64)
                total[i] = total[i] + more if i in total else more
        found = [np.minimum(255, np.rint(STEPS * np.log2(1.0 + x))).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array(found, pa.binary())], names=["at", "levels"])

    out = np.zeros(COUNTERS, np.uint8)
    for r in counts.repartition(COUNTERS // PER_ROW, "at").mapInArrow(thrifty(add), "at int, levels binary").collect():
        out[r["at"] * PER_ROW : (r["at"] + 1) * PER_ROW] = np.frombuffer(r["levels"], np.uint8)
    return out


def mean_others(levels: np.ndarray) -> float:
    """Mean number of further sets in the list of a shingle, less those that only share its counter by chance."""
    n = 2.0 ** (levels / STEPS) - 1
    return max(0.0, float((n * n).sum() / n.sum() - 1 - n.mean())) if n.any() else 0.0


def pairs_cost(others: float) -> float:
    """What an entry of a list costs beside its row, in such rows, where lists hold ``others`` further sets on average.

    However long its list, a set makes one candidate there: with the list's
    smallest node.  The share of entries that meet another set is ``others`` at
    most, and 1 at most, so the boundary does not move up with the input.
    """
    return PAIR_COST * min(1.0, others)


def _marks(ids: DataFrame) -> tuple[int, np.ndarray]:
    """Bits set for the hashed ids: a filter of ``FILTER_BITS`` at most that knows all of them, and takes some others for them."""
    size = min(FILTER_BITS, 1 << max(10, (16 * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64("node"), F.lit(size))
    words = ids.select(F.floor(at / 32).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int")).alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(size // 32, np.uint32)
    for r in words.toLocalIterator():
        out[r["w"]] = r["bits"]
    return size, out


def _marked(bits: np.ndarray, at: pa.Array) -> np.ndarray:
    at = at.to_numpy(zero_copy_only=False)
    return (bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)


def keyed(docs: DataFrame, copies: DataFrame, rule: Rule, levels: np.ndarray) -> DataFrame:
    """``node, n, lists, subsets`` of one row of each set: all rows but those of ``copies(node, h1, h2)``.

    ``lists`` has the set's rarest shingles in order.  A filter of bounded size
    tells which rows may be copies; only those are held against the table itself.
    """
    size, marks = _marks(copies.select("node"))
    boundary = rule.boundary(pairs_cost(mean_others(levels)))
    spark = docs.sparkSession.sparkContext
    shared, order = spark.broadcast(marks), spark.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, bits, levels = Words(), shared.value, order.value
        for b in batches:
            n, digests, parts = [], [], ([], [])
            for text in b.column(1).to_pylist():
                h = shingles(text, seen, rule.words)
                n.append(len(h))
                digests.append(_digest(h))
                large = len(h) and rule.most_partner(len(h)) >= boundary
                parts[0].append(rarest(h, levels, rule.prefix(len(h))) if large else h[:0])
                parts[1].append(subset_keys(h, rule, boundary) if len(h) < boundary else h[:0])
            lists = []
            for p in parts:
                ends = np.append(0, np.cumsum([len(x) for x in p])).astype(np.int32)
                lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(p).view(np.int64) if p else np.empty(0, np.int64))))
            pair = np.array(digests, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(_marked(bits, b.column(2))), *lists], names=["node", "n", "h1", "h2", "maybe", "lists", "subsets"])

    rows = _texts(docs).where("doc_id is not null").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(size)))
    every = rows.mapInArrow(thrifty(run), "node bigint, n bigint, h1 bigint, h2 bigint, maybe boolean, lists array<bigint>, subsets array<bigint>")
    every = materialize(every.where(F.size("lists") + F.size("subsets") > 0), "keyed")
    columns = ["node", "n", "lists", "subsets"]
    sure = every.where("not maybe").select(*columns)
    return sure.unionByName(every.where("maybe").join(copies, ["node", "h1", "h2"], "left_anti").select(*columns)), every


def _read_again(docs: DataFrame, ids: DataFrame, schema: str, cut) -> DataFrame:
    """``cut(id, text)`` rows of the documents in ``ids(node)`` and some others, in one pass without a shuffle."""
    size, marks = _marks(ids)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield cut(b.filter(pa.array(_marked(shared.value, b.column(2)))))

    rows = _texts(docs).where("doc_id is not null").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(size)))
    return rows.mapInArrow(thrifty(run), schema)


def sets_of(docs: DataFrame, ids: DataFrame, rule: Rule) -> DataFrame:
    """``node, n, shingles`` of the documents in ``ids(node)`` and some others."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        seen = Words()
        found = [shingles(t, seen, rule.words).view(np.int64) for t in b.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["node", "n", "shingles"])

    return materialize(_read_again(docs, ids, "node bigint, n bigint, shingles array<bigint>", cut), "sets")


def packed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``node, packed`` of the documents in ``ids(node)`` and some others: texts take a fraction of the room of their sets."""

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(3).compress
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([pack((t or "").encode("utf-8", "replace")) for t in b.column(1).to_pylist()], pa.binary())], names=["node", "packed"])

    return _read_again(docs, ids, "node bigint, packed binary", cut)


def may_link(rule: Rule, a: str, b: str) -> Column:
    """Whether sizes ``n_a, n_b`` and places ``pos_a, pos_b`` of a common shingle in the order of both sets allow a link.

    Both have at most so many common shingles before it as the nearer place, and
    after it as the shorter rest.  A subset key has no place.
    """
    n, p = (lambda k: F.col(f"n_{k}")), (lambda k: F.col(f"pos_{k}"))
    most = F.least(p(a), p(b)) + 1 + F.least(n(a) - p(a) - 1, n(b) - p(b) - 1)
    sizes = 100 * F.least(n(a), n(b)) >= rule.percent * F.greatest(n(a), n(b))
    return sizes & F.coalesce((100 + rule.percent) * most >= rule.percent * (n(a) + n(b)), F.lit(True))


def sketches_fit(rule: Rule, a: str, b: str) -> Column:
    """Whether narrow sketches allow a link; true of every link."""
    differ = sum((F.bit_count(F.col(f"{x}_{a}").bitwiseXOR(F.col(f"{x}_{b}"))) for x in _NARROW), F.lit(0))
    return (100 + rule.percent) * differ <= (100 - rule.percent) * (F.col(f"n_{a}") + F.col(f"n_{b}"))


def differing(a: str, b: str) -> Column:
    """Bits in which the sketches of two rows differ, the wider one folded to the other's width."""
    xor = lambda x, y: x.bitwiseXOR(y)
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), xor)
    x, y = F.col(f"sketch_{a}"), F.col(f"sketch_{b}")
    one, two = F.when(F.size(x) > F.size(y), half(x)).otherwise(x), F.when(F.size(y) > F.size(x), half(y)).otherwise(y)
    # sizes that can link and are still two widths apart are only held against each other in full
    each = F.zip_with(one, two, lambda x, y: F.bit_count(xor(x, y)))
    return F.when(F.size(one) == F.size(two), F.aggregate(each, F.lit(0), lambda s, x: s + x)).otherwise(0)


def near(pairs: DataFrame, slim: DataFrame, rule: Rule) -> DataFrame:
    """``a, b, differ`` of the ``pairs(a, b)`` whose sizes and sketches allow a link; true of every link.  ``a`` may be in many pairs."""
    side = lambda k: slim.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.when(F.size("sketch") > 0, F.col("sketch")).otherwise(F.array(*_NARROW)).alias(f"sketch_{k}"))
    centres = pairs.groupBy("a").agg(F.count("*").alias("k")).join(side("a"), "a")
    both = lookup(pairs.join(side("b"), "b"), centres, ["a"], pairs.count(), "b", "k").where("n_a is not null")
    both = both.withColumn("differ", differing("a", "b"))
    fits = (100 + rule.percent) * F.col("differ") <= (100 - rule.percent) * (F.col("n_a") + F.col("n_b"))
    sizes = 100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b")
    return both.where(sizes & fits).groupBy("a", "b").agg(F.min("differ").alias("differ"), F.max("n_b").alias("n_b"))


def lists_of(nodes: DataFrame, n_nodes: int) -> DataFrame:
    """``key, node, n, pos, first`` of all lists with two nodes or more, first being the smallest node's ``node, n, pos``.

    Lists that a hashed 64th of the nodes shows to be long are dealt by node
    and need their smallest node only; all others meet by key.  Which way a
    list goes has no bearing on the result.
    """
    explode = lambda df: df.select("node", "n", F.posexplode("lists").alias("pos", "key")).unionByName(df.select("node", "n", F.lit(None).cast("int").alias("pos"), F.explode("subsets").alias("key")))
    listed = explode(nodes).select("key", "node", F.col("n").cast("int").alias("n"), "pos")
    drawn = explode(nodes.where(F.pmod(F.xxhash64("node"), F.lit(64)) == 0)).select("key")
    share = max(HOT_SHARE, 4 * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    long = drawn.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") >= max(16, n_nodes // (64 * share)))
    hot = [(r["key"],) for r in long.orderBy(F.desc("k"), "key").limit(share).collect()]
    names = F.broadcast(nodes.sparkSession.createDataFrame(hot, "key bigint"))
    whole, row = Window.partitionBy("key"), F.struct("node", "n", "pos")
    cold = listed.join(names, "key", "left_anti") if hot else listed
    out = cold.withColumn("first", F.min(row).over(whole)).withColumn("last", F.max("node").over(whole)).where("first.node < last").drop("last")
    if hot:
        held = listed.join(names, "key", "left_semi")
        first = held.groupBy("key").agg(F.min(row).alias("first"))
        out = out.unionByName(held.join(F.broadcast(first), "key"))
    return materialize(out.select("key", "node", "n", "pos", "first"), "members")


def shorter(docs: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """``key, node, n, pos, comp`` with lists of over ``LONGEST`` nodes replaced by their parts.

    Under another seed the members of a list get new keys; linked ones share
    one of these too, so old and new key together make the parts.
    """
    columns = ["key", "node", "n", "pos", "comp"]
    for seed in range(1, SEEDS + 1):
        long = materialize(members.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > LONGEST), "long")
        n = long.count()
        if not n:
            break
        sizes = long.agg(F.sum("k")).first()[0]
        marked = lookup(members, long, ["key"], sizes, "node", "k")
        inside = marked.where("k is not null").select(*columns)
        sets = sets_of(docs, inside.select("node").distinct(), rule)

        def again(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [block_keys(np.asarray(x, np.int64).view(np.uint64), rule, seed).view(np.int64) for x in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "more"])

        more = sets.where("n > 0").select("node", "shingles").mapInArrow(thrifty(again), "node bigint, more array<bigint>")
        parts = inside.join(more, "node").select(*columns, F.explode("more").alias("part")).withColumn("key", F.xxhash64("key", "part")).drop("part")
        old, members = members, materialize(still_open(marked.where("k is null").select(*columns).unionByName(parts.distinct())), "open")
        forget(sets, long, old)
    return members


def still_open(members: DataFrame) -> DataFrame:
    """``key, node, comp`` and more of the lists that hold two components or more."""
    split = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    return members.join(split, "key", "left_semi")


def pairs_of(members: DataFrame, slim: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs ``a < b`` of different components in a list of ``members(key, node, n, pos, comp)`` that places and narrow sketches allow.

    A list of many nodes is cut into parts by hash, and each two parts make a
    tile, so no list is dealt to one task.
    """
    rows = materialize(members.join(slim.select("node", *_NARROW), "node"), "sided")
    size = materialize(rows.groupBy("key").agg(F.count("*").alias("k")).withColumn("parts", F.ceil(F.col("k") / LIST_TILE).cast("int")).where("parts > 1"), "long")
    placed = lookup(rows, size, ["key"], rows.count(), "node", "k").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("n", "pos", "comp", *_NARROW)]
    one = placed.select("key", F.col("part").alias("p"), F.expr("explode(sequence(part, parts - 1))").alias("q"), F.col("node").alias("a"), *side("a"))
    two = placed.select("key", F.expr("explode(sequence(0, part))").alias("p"), F.col("part").alias("q"), F.col("node").alias("b"), *side("b"))
    same = [one[c] == two[c] for c in ("key", "p", "q")]
    met = one.join(two, [*same, (one["p"] < one["q"]) | (F.col("a") < F.col("b")), F.col("comp_a") != F.col("comp_b"), may_link(rule, "a", "b"), sketches_fit(rule, "a", "b")])
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def minorities(members: DataFrame, found: DataFrame) -> DataFrame:
    """``key, node, n, pos, comp, major``: of each list with several components the nodes outside its largest, ``major``."""
    named = members.join(found, "node", "left").select("key", "node", "n", "pos", F.coalesce("comp", "node").alias("comp"))
    held = named.groupBy("key", "comp").agg(F.count("*").alias("k"))
    major = held.groupBy("key").agg(F.max_by("comp", F.struct("k", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1").select(F.col("key").alias("of"), "major")
    return named.join(major, (F.col("key") == F.col("of")) & (F.col("comp") != F.col("major"))).drop("of")


def pairs_with(minor: DataFrame, found: DataFrame, slim: DataFrame, rule: Rule) -> DataFrame:
    """Distinct pairs ``a < b`` of a node with the members of a component that is the largest of a list of its, as sizes and narrow sketches allow.

    A text in many lists with the same component meets each member once.  Large
    components are cut into parts by hash.
    """
    every = slim.select("node", "n", *_NARROW).join(found, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    size = every.groupBy("comp").agg(F.count("*").alias("k")).withColumn("parts", F.ceil(F.col("k") / LIST_TILE).cast("int"))
    size = materialize(size.where("k > 1"), "sizes")
    side = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("n", *_NARROW)]
    asked = minor.select("node", F.col("major").alias("comp")).distinct().join(slim.select("node", "n", *_NARROW), "node")
    asked = lookup(asked, size, ["comp"], slim.count(), "node", "k").select("comp", F.expr("explode(sequence(0, coalesce(parts, 1) - 1))").alias("part"), F.col("node").alias("a"), *side("a"))
    placed = lookup(every, size, ["comp"], slim.count(), "node", "k")
    placed = placed.select(F.col("comp").alias("of"), F.expr("cast(pmod(xxhash64(node), coalesce(parts, 1)) as int)").alias("at"), F.col("node").alias("b"), *side("b"))
    sizes = 100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b")
    met = asked.join(placed, [F.col("comp") == F.col("of"), F.col("part") == F.col("at"), F.col("a") != F.col("b"), sizes, sketches_fit(rule, "a", "b")])
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirmed(group: pa.Table, rule: Rule) -> pa.Table:
    """``a, b`` of the texts of a group that link with one of its centre's."""
    seen, unpack = Words(), zstandard.ZstdDecompressor().decompress
    a, nodes = group["a"][0].as_py(), group["node"].to_pylist()
    sets = [shingles(unpack(x).decode("utf-8"), seen, rule.words) for x in group["packed"].to_pylist()]
    centres, out = [h for i, h in zip(nodes, sets, strict=True) if i == a], set()
    for i, h in zip(nodes, sets, strict=True):
        for c in centres if i != a and i not in out else ():
            at = np.searchsorted(c, h)
            common = int((c[np.minimum(at, len(c) - 1)] == h).sum()) if len(c) else 0
            if 100 * common >= rule.percent * (len(h) + len(c) - common):
                out.add(i)
    return pa.table({"a": pa.array([a] * len(out), pa.int64()), "b": pa.array(sorted(out), pa.int64())})


def confirm(docs: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """The linked ones of distinct ``pairs(a, b, n_b)``, held against the whole texts; ``a`` may be in many pairs.

    The pairs of a centre are split into groups of bounded size, each with the
    centre's text, so a text moves once for each of its pairs at most.
    """
    pairs = materialize(pairs.select("a", "b", "n_b"), "pairs")
    parts = F.greatest(F.ceil(F.count("*") / GROUP_TEXTS), F.ceil(F.sum("n_b") / GROUP_SHINGLES), F.lit(1)).cast("int")
    centres = materialize(pairs.groupBy("a").agg(F.count("*").alias("k"), parts.alias("parts")), "centres")
    placed = lookup(pairs, centres, ["a"], pairs.count(), "b", "k").select("a", F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("part"), F.col("b").alias("node"))
    placed = placed.unionByName(centres.select("a", F.expr("explode(sequence(0, parts - 1))").alias("part"), F.col("a").alias("node")))
    texts = packed_texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    held = placed.join(texts, "node")
    found = held.groupBy("a", "part").applyInArrow(lambda t: _confirmed(t, rule), "a bigint, b bigint")
    links = materialize(found.distinct(), "links")
    forget(pairs, centres)
    return links


def _tile(table: pa.Table, percent: int) -> pa.Table:
    """``node, links`` of a tile: left sets against right ones, or all against all where both sides are one part."""
    alone = table["lo"][0] == table["hi"][0] and table["p"][0] == table["q"][0]
    node, ids, right = (table[c].to_numpy() for c in ("node", "ids", "right"))
    lists = table["shingles"].combine_chunks()
    flat, size = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
    ends = np.cumsum(size)
    # a repeated row gives its set again
    first = {(node[i], flat[ends[i] - size[i] : ends[i]].tobytes()): i for i in reversed(range(len(node)))}
    kept = np.isin(np.arange(len(node)), list(first.values()))
    flat, node, ids, right, size = flat[np.repeat(kept, size)], node[kept], ids[kept], right[kept], size[kept].astype(np.int64)
    _, col, held = np.unique(flat, return_inverse=True, return_counts=True)
    col = np.where(held > 1, np.cumsum(held > 1) - 1, -1)[col]
    order = np.argsort(col, kind="stable")
    col, row = col[order], np.repeat(np.arange(len(node)), size)[order]
    a, b = (np.arange(len(node)),) * 2 if alone else (np.flatnonzero(~right), np.flatnonzero(right))
    common = np.zeros((len(a), len(b)))
    for start in range(0, int(col[-1]) + 1 if len(col) else 0, TILE_WIDTH):
        lo, hi = np.searchsorted(col, (start, start + TILE_WIDTH))
        dense = np.zeros((len(node), TILE_WIDTH), np.float32)
        dense[row[lo:hi], col[lo:hi] - start] = 1
        common += dense[a] @ dense[b].T
    common = common.astype(np.int64)
    linked = (100 * common >= percent * (size[a][:, None] + size[b][None] - common)) & (node[a][:, None] != node[b][None])
    out = np.zeros(len(node), np.int64)
    out[a] = linked @ ids[b]
    if not alone:
        out[b] = ids[a] @ linked
    return pa.table({"node": pa.array(node, pa.int64()), "links": pa.array(out, pa.int64())})


def links_of(docs: DataFrame, sets: DataFrame, found: DataFrame, rule: Rule) -> DataFrame:
    """``node, links`` of the nodes in ``found(node, comp)``: the ids of all other sets that link with the node's.

    ``sets(node, n, ids)``: size of a node's set and the number of its ids.  Two
    nodes alone are linked with each other.  Larger components are cut by class
    of size and hash of the node, and each two parts that can hold a link make
    a tile; so no component, whatever its size, is dealt to one task.
    """
    base = materialize(sets.join(found, "node"), "linked")
    total = base.groupBy("comp").agg(F.count("*").alias("k"), F.sum("ids").alias("all_ids"))
    base = materialize(lookup(base, total, ["comp"], base.count(), "node", "k"), "grouped")
    two = base.where("k = 2").select("node", (F.col("all_ids") - F.col("ids")).alias("links"))
    edges = rule.class_edges
    cls = lambda n: sum(((F.expr(n) >= e).cast("int") for e in edges[1:]), F.lit(0))
    low, high = f"({rule.percent} * n + 99) div 100", f"100 * n div {rule.percent}"
    many = base.where("k > 2").select("comp", "node", "n", "ids", cls("n").alias("c"), cls(low).alias("c_lo"), cls(high).alias("c_hi"))
    many = materialize(many, "many")
    parts = F.greatest(F.ceil(F.count("*") / TILE_SETS), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int")
    size = materialize(many.groupBy("comp", "c").agg(F.count("*").alias("k"), parts.alias("parts")), "parts")
    beside = lambda step, name: size.select("comp", (F.col("c") + step).alias("c"), F.col("parts").alias(name))
    facts = size.join(beside(-1, "above"), ["comp", "c"], "left").join(beside(1, "below"), ["comp", "c"], "left")
    placed = lookup(many, facts, ["comp", "c"], many.count(), "node", "k").withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    tiles = F.expr("""explode(concat(
        transform(sequence(0, parts - 1), q -> struct(c as lo, c as hi, least(part, q) as p, greatest(part, q) as q, part > q as right)),
        if(c_hi > c and above is not null, transform(sequence(0, coalesce(above, 1) - 1), q -> struct(c as lo, c + 1 as hi, part as p, q as q, false as right)), array()),
        if(c_lo < c and below is not null, transform(sequence(0, coalesce(below, 1) - 1), q -> struct(c - 1 as lo, c as hi, q as p, part as q, true as right)), array())))""")
    placed = placed.select("comp", "node", "n", "ids", tiles.alias("t")).select("comp", "node", "n", "ids", "t.*")
    percent = rule.percent
    held = placed.join(sets_of(docs, many.select("node").distinct(), rule), ["node", "n"])
    counted = held.groupBy("comp", "lo", "hi", "p", "q").applyInArrow(lambda t: _tile(t, percent), "node bigint, links bigint")
    return materialize(two.unionByName(counted).groupBy("node").agg(F.sum("links").alias("links")), "counts")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """``a, b, n_b, differ, c_a`` of the pairs whose ends are in different components of ``found(node, comp)``."""
    centres = pairs.groupBy("a").agg(F.count("*").alias("k")).join(found.select(F.col("node").alias("a"), F.col("comp").alias("c")), "a")
    sided = pairs.select("a", "b", "n_b", "differ").join(found.select(F.col("node").alias("b"), F.col("comp").alias("c_b")), "b", "left")
    both = lookup(sided, centres, ["a"], pairs.count(), "b", "k").withColumn("c_a", F.coalesce("c", "a"))
    return both.where(F.col("c_a") != F.coalesce("c_b", "b")).select("a", "b", "n_b", "differ", "c_a")


def settle(docs: DataFrame, pairs: DataFrame, links: DataFrame | None, rule: Rule, found: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Links and components after ``pairs(a, b, n_b, differ)`` are decided, as far as these need it.

    Of each node's pairs with a component the likeliest is confirmed first;
    pairs whose ends have come together need no look at the texts.  What is
    left after ``ROUNDS`` rounds is confirmed whole.
    """
    for k in range(ROUNDS + 1):
        pairs = materialize(_apart(pairs, found) if found is not None else pairs.withColumn("c_a", F.lit(0).cast("long")), "apart")
        if links is not None and not pairs.take(1):
            break
        picked = pairs
        if k < ROUNDS:
            one = pairs.groupBy("b", "c_a").agg(F.min_by(F.struct("a", "n_b"), F.struct("differ", "a")).alias("x"))
            picked = materialize(one.select("x.a", "b", "x.n_b"), "picked")
        new = confirm(docs, picked, rule)
        pairs = pairs.join(picked.select("a", "b"), ["a", "b"], "left_anti")
        if links is None or new.take(1):
            links = new if links is None else links.unionByName(new)
            found = components(links)
        release(docs.sparkSession)
    return links, found


def join(docs: DataFrame, rule: Rule = Rule(), count_links: bool = True) -> DataFrame:
    """``doc_id, n_shingles, component_id`` and, unless not asked for, ``n_links`` for every row of ``docs(doc_id, text)``.

    component_id: smallest doc_id reachable by links, itself included.  A null
    text or one without words has an empty set and stands alone.  Rows with
    equal sets are linked; a repeated row gives its row again.  A row with a
    null doc_id gets the component of its equals, null where there are none,
    and links nothing itself.  n_links: other doc_ids whose sets link with the
    row's, those of equal sets included; an id with several texts counts with
    each.  Other columns are not read; an empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        return _joined(docs, rule, count_links)


def _joined(docs: DataFrame, rule: Rule, count_links: bool) -> DataFrame:
    signed = materialize(signatures(docs, rule), "sig")
    sig = signed.where("at is null")
    nodes = sig.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", *_NARROW, "sketch")])
    nodes = materialize(nodes, "nodes")
    n_rows = sig.count()
    again = nodes.where("copies > 1 and node is not null").select("h1", "h2", F.col("node").alias("kept"), "copies")
    copies = lookup(sig.where("n > 0 and doc_id is not null").select(F.col("doc_id").alias("node"), "h1", "h2"), again, ["h1", "h2"], n_rows, "node", "copies")
    copies = materialize(copies.where("kept <> node").select("node", "h1", "h2"), "copies")
    keys, written = keyed(docs, copies, rule, levels_of(signed.where("at is not null").select("at", "counts")))
    members = lists_of(keys, nodes.count())
    forget(written, copies)
    release(docs.sparkSession)
    slim = nodes.where("node is not null").select("node", "n", *_NARROW, "sketch")
    met = members.where("node <> first.node").select(F.col("first.node").alias("a"), F.col("node").alias("b"), F.col("first.n").alias("n_a"), F.col("n").alias("n_b"), F.col("first.pos").alias("pos_a"), F.col("pos").alias("pos_b"))
    stars = materialize(met.where(may_link(rule, "a", "b")).select("a", "b").distinct(), "stars")
    likely = materialize(near(stars, slim, rule), "likely")
    links, found = settle(docs, likely, None, rule)
    # lists that still hold two components: every pair of theirs that is not yet decided
    minor = materialize(minorities(members, found), "minor")
    few = shorter(docs, materialize(still_open(minor.select("key", "node", "n", "pos", "comp")), "open"), rule)
    rest = pairs_of(few, slim, rule).unionByName(pairs_with(minor, found, slim, rule)).distinct()
    rest = materialize(near(materialize(rest, "rest"), slim, rule), "likely")
    release(docs.sparkSession)
    links, found = settle(docs, rest, links, rule, found)
    forget(members, minor, few, stars, likely)
    more_facts, more_columns = [], []
    if count_links:
        ids = sig.where("n > 0 and doc_id is not null").select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("ids"))
        nodes = materialize(nodes.join(ids, ["h1", "h2"], "left"), "nodes")
        found = found.join(links_of(docs, nodes.where("node is not null").select("node", "n", "ids"), found, rule), "node", "left")
        more_facts = [(F.col("ids") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")]
        more_columns = [F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).alias("n_links")]
    facts = nodes.join(found, "node", "left").select("h1", "h2", F.coalesce("comp", "node").alias("component"), "copies", *more_facts)
    rows = sig.select("doc_id", "n", F.when(F.col("n") > 0, F.col("h1")).alias("h1"), "h2")
    out = lookup(rows, facts, ["h1", "h2"], n_rows, "doc_id", "copies")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *more_columns)


def deduplicate(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """Rows of ``docs`` that stand for their component: that of the smallest doc_id; all columns stay.

    Of repeated rows one stays.  A row with a null doc_id goes if its text
    equals that of a row with an id; of equal texts without ids one stays.
    """
    found = materialize(join(docs, rule, count_links=False), "components")
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("k"))
    odd = bool(ids.where("k > 1 or doc_id is null").take(1))
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if not odd:
        return kept
    plain = kept.join(ids.where("k = 1 and doc_id is not null").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    rank, digest = "_rank_of_copy", "_digest_of_copy"
    repeated = docs.join(gone, "doc_id", "left_anti").join(ids.where("k > 1").select("doc_id"), "doc_id", "left_semi")
    repeated = repeated.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(rank) == 1)
    nameless = docs.where("doc_id is null").withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    named = docs.where("doc_id is not null").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias(digest)).distinct()
    alone = nameless.join(named, digest, "left_anti").withColumn(rank, F.row_number().over(Window.partitionBy(digest).orderBy("text"))).where(F.col(rank) == 1)
    return plain.unionByName(repeated.select(*docs.columns)).unionByName(alone.select(*docs.columns))
