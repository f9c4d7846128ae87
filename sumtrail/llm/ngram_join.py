"""N-gram Jaccard self-join: size-banded tiles, bitmap bounds, exact intersection.

Two documents link when their sets of word shingles have a Jaccard similarity
of at least ``share`` percent. The join is exact:

1. One pass turns every text into its set of 64-bit shingle hashes, as a sorted
   array. Kept of it are the set's size, its identity (a hash of the array), a
   bitmap with a bit flipped per shingle, and the prefix: so many of its first
   shingles that two linked sets must share one of theirs. First are those that
   are not frequent, by hash; frequent ones, from lines and passages that many
   documents share, come last. A pass before counts, over all texts, in how many
   a shingle lies among the first by hash, twice the prefix; the order decides the
   cost of the join, never its result. Equal sets are one node from here on,
   however many copies there are.
2. Tiles are the nodes that share a prefix hash. Most prefix hashes are in one set
   only: blocks of sets, a packed row each, ask in shards which of theirs another
   set has, by 40 bits or more of the hash, and get back a bit for each; only those
   become rows. Each node is first held against its tiles' smallest and largest
   node, which decides every pair of a tile of three, then, where a larger tile
   spans components, against its most central one. The links found give
   preliminary components, so a large group of near copies needs few comparisons.
3. Larger tiles that still span components are split by size band (a set meets only
   its own band and the next) and searched whole: pairs from different
   components whose sizes allow a link, whose places in the tile leave enough
   shingles after the first common one, and whose bitmaps allow enough overlap.
   A pair differs by at least as many shingles as their bitmaps differ in bits.
4. What passes is held against wider bitmaps, with about a bit per shingle, and
   then decided by intersecting the sorted arrays, recomputed from the texts of
   the nodes in question only.

Pairs inside a preliminary component are never listed; as their nodes are
linked already, no component loses anything. Nothing is capped: a hot tile
costs comparisons inside the join, not rows, and adaptive execution splits it.
Ends and centres of tiles are aggregates, combined before the shuffle, and come
back by joins.

Null, empty or blank texts have an empty set and link with nothing. Fewer words
than a shingle count as one shingle. Rows without doc_id get no component; rows
that share a doc_id are judged each by its own text. An empty table gives an
empty result; extra columns are ignored (and kept by :func:`deduplicated`).

Two different sets share an identity with a probability of 2^-64 per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow, ship, small
from sumtrail.llm.components import components
from sumtrail.session import written


@dataclass(frozen=True)
class Join:
    """Words per shingle, least similarity in percent, bits of the bitmaps in tiles, rows and bytes that may be broadcast.

    A shingle is frequent if ``frequent`` documents have it; if more are than
    ``frequent_bytes`` hold, the limit is raised by powers of two until they fit.
    A block holds about ``block`` prefix hashes, a shard is asked about ``shard``.
    """

    width: int = 5
    share: int = 80
    bits: int = 512
    broadcast_rows: int = 500_000
    broadcast_bytes: int = 16_000_000
    known_words: int = 300_000
    frequent: int = 8
    frequent_bytes: int = 16_000_000
    block: int = 1 << 18
    shard: int = 1 << 20


JOIN = Join()
_SCALE = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, join: Join = JOIN):
        self.width, self.limit = join.width, join.known_words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
        if not tokens:
            return np.empty(0, np.int64)
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            hashes = np.array([known[t] for t in tokens], np.uint64)
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = xxhash.xxh64_intdigest(t)
            hashes = np.array([known[t] for t in tokens], np.uint64)
        width = min(self.width, len(hashes))
        n = len(hashes) - width + 1
        out = np.full(n, np.uint64(width))
        for k in range(width):
            out = out * _SCALE + hashes[k : k + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
        return np.unique(out.view(np.int64))


def bitmap(shingles: np.ndarray, bits: int) -> np.ndarray:
    """One bit flipped per shingle, as 64-bit words; ``bits`` is a power of two.

    Folding the halves of a bitmap by exclusive or gives the one of half the bits.
    """
    odd = np.bincount((shingles.view(np.uint64) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def bounded(n: int, m: int, a: bytes, b: bytes, share: int) -> bool:
    """Do the bitmaps of sets of n and m shingles leave room for the similarity?"""
    x, y = np.frombuffer(a, np.int64), np.frombuffer(b, np.int64)
    size = min(len(x), len(y))
    apart = int(np.bitwise_count((folded(x, size) ^ folded(y, size)).view(np.uint64)).sum())
    return 100 * (n + m - apart) >= share * (n + m + apart)


def first_shingles(shingles: np.ndarray, frequent: np.ndarray, size: int) -> np.ndarray:
    """The first ``size`` shingles, frequent ones last."""
    if not size or not len(frequent):
        return shingles[:size]
    common = frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles
    return np.concatenate([shingles[~common][:size], shingles[common][:size]])[:size]


def frequent_shingles(docs: DataFrame, join: Join = JOIN) -> np.ndarray:
    """Shingles that ``frequent`` documents or more have among their first, sorted; at most ``frequent_bytes``.

    First are those by hash up to twice the prefix: a shingle further back is in no
    tile, unless most of those before it are frequent.
    """
    schema = T.StructType([T.StructField("token", T.LongType()), T.StructField("n", T.LongType())])

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        tokens, n = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(n.astype(np.int64))], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, held, size = Shingler(join), [], 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                shingles = shingler(text)
                held.append(shingles[: 2 * prefix_size(len(shingles), join.share)])
                size += len(held[-1])
                if size > 1 << 19:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    found = written(
        docs.select("text").transform(map_arrow, run, schema)
        .groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= join.frequent))
    level = F.floor(F.log2("n")).cast("int").alias("level")
    least, room = join.frequent, join.frequent_bytes // 8
    for r in sorted(found.groupBy(level).count().collect(), reverse=True):  # a row per power of two
        room -= r["count"]
        if room < 0:
            least = 2 << r.level
            break
    tokens = found.where(F.col("n") >= least).select("token").toArrow()["token"]
    return np.sort(tokens.to_numpy())


def prefix_size(n: int, share: int) -> int:
    """So many of the first shingles of a set of n that linked sets share one of theirs."""
    return n - -(-share * n // 100) + 1 if n else 0


def identity(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


_BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("nodes", T.BinaryType()), T.StructField("ns", T.BinaryType()),
    T.StructField("sizes", T.BinaryType()), T.StructField("tokens", T.BinaryType())])
_ASKED = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType()),
    T.StructField("marks", T.BinaryType()), T.StructField("twice", T.BinaryType())])
_FLAGS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("flags", T.BinaryType())])


def sets(docs: DataFrame, join: Join = JOIN) -> tuple[DataFrame, DataFrame]:
    """doc_id, a hash of the text, n, node and bitmaps of every row, and blocks of nodes with their prefixes; written, as all steps read it."""
    rows = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("node", T.LongType()), T.StructField("bitmap", T.ArrayType(T.LongType())), T.StructField("wide", T.BinaryType())])
    schema = T.StructType([*rows, *_BLOCK])
    target = arrow_schema(schema)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, join))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, number = Shingler(join), TaskContext.get().partitionId() << 32
        heads: dict[int, tuple[int, np.ndarray]] = {}
        size = 0

        def closed() -> pa.RecordBatch:
            values = [
                np.array(list(heads), np.int64), np.array([n for n, _ in heads.values()], np.int32),
                np.array([len(h) for _, h in heads.values()], np.int32), np.concatenate([h for _, h in heads.values()])]
            return pa.RecordBatch.from_arrays(
                [*(pa.nulls(1, target.field(f.name).type) for f in rows), pa.array([number], pa.int64()),
                 *(pa.array([v.tobytes()], pa.binary()) for v in values)], schema=target)

        for batch in batches:
            found = [shingler(t) for t in batch.column("text").to_pylist()]
            nodes = [identity(s) for s in found]
            wide = [bitmap(s, max(join.bits, 1 << max(0, len(s) - 1).bit_length())) for s in found]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in found], pa.int64()), pa.array(nodes, pa.int64()),
                pa.array([folded(w, join.bits // 64).tolist() for w in wide], target.field("bitmap").type),
                pa.array([w.tobytes() for w in wide], pa.binary()),
                *(pa.nulls(len(found), target.field(f.name).type) for f in _BLOCK)], schema=target)
            for s, node, known in zip(found, nodes, batch.column("doc_id").is_valid().to_pylist()):
                if known and len(s) and node not in heads:
                    heads[node] = len(s), first_shingles(s, frequent.value, prefix_size(len(s), join.share))
                    size += len(heads[node][1])
                if size >= join.block:
                    yield closed()
                    heads.clear()
                    number, size = number + 1, 0
        if heads:
            yield closed()

    both = written(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).transform(map_arrow, run, schema))
    return both.where("block is null").select(rows.names), both.where("block is not null").select(_BLOCK.names)


def marks_of(tokens: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The first ``bits`` + 32 bits of a block's hashes: distinct ones in order, where each hash has its own, how often they come, edges of the shards."""
    keys = np.frombuffer(tokens, np.uint64) >> np.uint64(32 - bits)
    keys, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    return keys, place, n, np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32))


def members(blocks: DataFrame, join: Join = JOIN) -> DataFrame:
    """(token, node, left) of every prefix hash that another set may have too; left counts it and those after it in the set."""
    total = blocks.agg(F.sum(F.length("tokens"))).first()[0] or 0
    bits = max(8, math.ceil(math.log2(total / 8 / join.shard + 1)))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("token", "node", "left")])
    asked_, flagged = arrow_schema(_ASKED), arrow_schema(_FLAGS)
    ship(blocks.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, tokens in zip(batch.column("block").to_pylist(), batch.column("tokens")):
                keys, _, n, edges = marks_of(tokens.as_py(), bits)
                full = np.flatnonzero(np.diff(edges)).tolist()
                cut = [slice(edges[s], edges[s + 1]) for s in full]
                low = keys.astype(np.uint32)
                values = [[number] * len(full), full, [low[c].tobytes() for c in cut], [np.packbits(n[c] > 1).tobytes() for c in cut]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, asked_)], schema=asked_)

    def shard(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(m.as_py(), np.uint32) for m in table["marks"]]
        twice = [np.unpackbits(np.frombuffer(t.as_py(), np.uint8), count=len(r)) for t, r in zip(table["twice"], rows)]
        _, place, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        several = n > 1
        several[place[np.concatenate(twice) == 1]] = True
        edges = np.cumsum([0, *map(len, rows)])
        flags = [np.packbits(several[place[a:b]]).tobytes() for a, b in zip(edges, edges[1:])]
        return pa.Table.from_arrays([table["block"], table["shard"], pa.array(flags, pa.binary())], schema=flagged)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, flags in zip(zip(*(batch.column(c) for c in _BLOCK.names[1:])), batch.column("flags")):
                nodes, ns, sizes, tokens = (np.frombuffer(r.as_py(), k) for r, k in zip(raw, (np.int64, np.int32, np.int32, np.int64)))
                _, place, _, edges = marks_of(tokens.tobytes(), bits)
                counts = np.diff(edges)
                bits_ = [np.unpackbits(np.frombuffer(f["flags"], np.uint8), count=counts[f["shard"]]) for f in flags.as_py()]
                hit = np.flatnonzero(np.concatenate(bits_)[place])
                owner = np.repeat(np.arange(len(nodes)), sizes)[hit]
                left = ns[owner] - (hit - (np.cumsum(sizes) - sizes)[owner])
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (tokens[hit], nodes[owner], left)], names=schema.names)

    flags = map_arrow(blocks.select("block", "tokens"), ask, _ASKED).groupBy("shard").applyInArrow(shard, _FLAGS)
    answers = flags.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "flags"))).alias("flags"))
    return map_arrow(blocks.join(answers, "block").select(*_BLOCK.names[1:], "flags"), told, schema)


def may_link(n: Column, m: Column, share: int) -> Column:
    """Sizes allow the similarity."""
    return (100 * F.least(n, m)) >= (share * F.greatest(n, m))


def in_reach(n: Column, m: Column, left_n: Column, left_m: Column, share: int) -> Column:
    """Enough shingles are left, from the first common one on: ``left_`` counts it and those after it."""
    both = F.least(left_n, left_m)
    return (100 * both) >= (share * (n + m - both))


def enough(n: Column, m: Column, differing: Column, share: int) -> Column:
    """Bitmaps that differ in so many bits allow the similarity: overlap <= (n + m - differing) / 2."""
    return (100 * (n + m - differing)) >= (share * (n + m + differing))


def differing(a: Column, b: Column, bits: int) -> Column:
    return sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(1, bits // 64)), F.bit_count(a[0].bitwiseXOR(b[0])))


def linked(docs: DataFrame, known: DataFrame, pairs: DataFrame, join: Join = JOIN) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough: wide bitmaps first, then exact intersection."""
    link = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    held = small(written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()), join.broadcast_rows)
    wides = written(known.select("node", "n", "wide").join(held, "node", "left_semi").dropDuplicates(["node"]))
    size = wides.agg(F.coalesce(F.sum(F.length("wide") + 40), F.lit(0))).first()[0]
    wides = F.broadcast(wides) if size <= join.broadcast_bytes else wides
    mark = lambda s: wides.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("wide").alias(f"w_{s}"))

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "w_a", "w_b")))
            good = [bounded(n, m, x, y, join.share) for n, m, x, y in rows]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = written(pairs.select("a", "b").join(mark("a"), "a").join(mark("b"), "b").select(
        "a", "b", "n_a", "n_b", "w_a", "w_b").transform(map_arrow, prune, link))
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = written(
        known.join(small(written(nodes), join.broadcast_rows), "node", "left_semi").groupBy("node")
        .agg(F.min("doc_id").alias("doc_id")))
    wanted_docs = small(wanted.withColumnRenamed("doc_id", "id"), join.broadcast_rows)
    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])
    target = arrow_schema(schema)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(join)
        for batch in batches:
            rows = []
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                shingles = shingler(text)
                if identity(shingles) == node:  # rows that share a doc_id can differ
                    rows.append((node, shingles))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], target.field("shingles").type)], schema=target)

    found = written(
        docs.select("doc_id", "text").join(wanted_docs, F.col("doc_id") == F.col("id")).select("node", "text")
        .transform(map_arrow, arrays, schema).dropDuplicates(["node"]))
    of = lambda side: found.select(F.col("node").alias(side), F.col("shingles").alias(f"of_{side}"))
    both = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("of_a", "of_b"):
                column = batch.column(name)
                flat, edge = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
                sides.append([flat[s:e] for s, e in zip(edge, edge[1:])])
            good = []
            for x, y in zip(*sides):
                both_ = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both_ >= join.share * (len(x) + len(y) - both_))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return written(both.transform(map_arrow, intersect, link))


def spanning(tiles: DataFrame, parts: DataFrame, join: Join = JOIN) -> DataFrame:
    """Rows of ``tiles`` (token, node, ...) whose tile spans components, with the node's as ``part``."""
    placed = tiles.join(small(parts, join.broadcast_rows), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    open_ = written(placed.groupBy("token").agg(F.min("part").alias("least"), F.max("part").alias("most"))
                    .where("least < most").select("token"))
    return placed.join(small(open_, join.broadcast_rows), "token", "left_semi")


def grouped(docs: DataFrame, join: Join = JOIN) -> DataFrame:
    """doc_id, text_hash, n_shingles, node and component_id of every row of ``docs``."""
    every, blocks = sets(docs, join)
    known = every.where("n > 0 and doc_id is not null")
    # A node lies in as many blocks as have copies of it; "left" is the same in all.
    shared = written(members(blocks, join).groupBy("token", "node").agg(F.min("left").alias("left")))
    ends = written(shared.groupBy("token").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("nodes")).where("low < high"))
    shared = written(shared.join(small(ends, join.broadcast_rows), "token"))
    bitmaps = written(
        known.select("node", "n", "bitmap")
        .join(small(written(shared.select("node").distinct()), join.broadcast_rows), "node", "left_semi").dropDuplicates(["node"]))

    # Every node against the ends of its tiles.
    stars = (
        shared.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    marks = small(bitmaps, join.broadcast_rows)
    side = lambda s: marks.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("bitmap").alias(f"bits_{s}"))
    tried = written(
        stars.join(side("a"), "a").join(side("b"), "b")
        .where(may_link(F.col("n_a"), F.col("n_b"), join.share))
        .where(enough(F.col("n_a"), F.col("n_b"), differing(F.col("bits_a"), F.col("bits_b"), join.bits), join.share))
        .select("a", "b"))
    links = linked(docs, known, tried, join)
    first = components(links)

    # What is left: tiles that span preliminary components. Of three nodes, two are
    # the ends, so that every pair has been tried.
    at = F.floor(F.log("n") / math.log(100 / join.share * 1.000001)).cast("int")
    placed = written(
        spanning(shared.where("nodes > 3").select("token", "node", "left"), first, join).join(marks, "node").withColumn("band", at))

    # Their nodes against the tile's most central one, which shares most tiles with others: in a
    # group of near copies, one with few changes of its own.
    central = small(written(placed.groupBy("node").agg(F.count("*").alias("tiles"))), join.broadcast_rows)
    best = written(placed.drop("bitmap").join(central, "node").groupBy("token").agg(F.max(F.struct("tiles", "node", "part", "n", "left")).alias("best"))
                   .select("token", *(F.col(f"best.{c}").alias(f"best_{c}") for c in ("node", "part", "n", "left"))))
    best = best.join(marks.select(F.col("node").alias("best_node"), F.col("bitmap").alias("best_bitmap")), "best_node")
    centred = written(
        placed.join(best, "token").where("best_part <> part")
        .where(may_link(F.col("n"), F.col("best_n"), join.share))
        .where(in_reach(F.col("n"), F.col("best_n"), F.col("left"), F.col("best_left"), join.share))
        .where(enough(F.col("n"), F.col("best_n"), differing(F.col("bitmap"), F.col("best_bitmap"), join.bits), join.share))
        .select(F.least("node", "best_node").alias("a"), F.greatest("node", "best_node").alias("b")).distinct()
        .join(tried, ["a", "b"], "left_anti"))
    links = links.unionByName(linked(docs, known, centred, join))
    tried = tried.unionByName(centred)
    parts = components(links)

    # The rest whole, by size band.
    placed = written(spanning(placed.drop("part"), parts, join))
    home = placed.select("token", "band", F.col("node").alias("a"), F.col("part").alias("part_a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"), F.col("bitmap").alias("bits_a"))
    guest = placed.select(
        "token", F.explode(F.array(F.col("band"), F.col("band") - 1)).alias("band"), F.col("band").alias("own"), F.col("node").alias("b"),
        F.col("part").alias("part_b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"), F.col("bitmap").alias("bits_b"))
    rest = written(
        home.join(guest, ["token", "band"])
        .where((F.col("part_a") != F.col("part_b")) & ((F.col("own") != F.col("band")) | (F.col("a") < F.col("b"))))
        .where(may_link(F.col("n_a"), F.col("n_b"), join.share))
        .where(in_reach(F.col("n_a"), F.col("n_b"), F.col("left_a"), F.col("left_b"), join.share))
        .where(enough(F.col("n_a"), F.col("n_b"), differing(F.col("bits_a"), F.col("bits_b"), join.bits), join.share))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
                F.least("part_a", "part_b").alias("p"), F.greatest("part_a", "part_b").alias("q"))
        .distinct().join(tried, ["a", "b"], "left_anti"))
    # One pair for each two components first; the others only if that left them apart.
    one = written(rest.groupBy("p", "q").agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b"))
    found = linked(docs, known, one, join)
    if found.take(1):
        links = links.unionByName(found)
        parts = components(links)
    where = lambda s: parts.select(F.col("node").alias(s), F.col("component").alias(f"in_{s}"))
    others = written(
        rest.select("a", "b").join(one, ["a", "b"], "left_anti").join(where("a"), "a", "left").join(where("b"), "b", "left")
        .where(F.coalesce("in_a", "a") != F.coalesce("in_b", "b")).select("a", "b"))
    if others.take(1):
        found = linked(docs, known, others, join)
        if found.take(1):
            parts = components(links.unionByName(found))
    final = parts

    # Nodes back to documents: the smallest doc_id of a component.
    ids = known.groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = ids.join(final, "node", "left").withColumn("part", F.coalesce("component", "node"))
    smallest = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    lookup = written(named.select("node", "part").join(smallest, "part").select(F.col("node").alias("k"), "component_id"))
    joined = every.select("doc_id", "text_hash", "n", "node").join(
        lookup, (F.col("node") == F.col("k")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    return joined.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, join: Join = JOIN) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; all columns stay.

    Documents with an empty set, and rows without doc_id, are kept. Of rows that
    share a doc_id, one of each set of shingles stays: equal ones are copies,
    different ones are different texts.
    """
    verdict = grouped(docs, join).where("doc_id is not null")
    stays = verdict.where("component_id = doc_id").groupBy("doc_id", "node").agg(F.min("text_hash").alias("__hash"))
    stays = written(stays.select(F.col("doc_id").alias("__id"), "__hash").distinct())
    named = docs.where("doc_id is not null").withColumn("__text", F.xxhash64("text"))
    kept = named.join(small(stays, join.broadcast_rows), (F.col("doc_id") == F.col("__id")) & (F.col("__text") == F.col("__hash")), "left_semi")
    kept = kept.dropDuplicates(["doc_id", "__text"]).select(*docs.columns)
    return docs.where("doc_id is null").unionByName(kept)
