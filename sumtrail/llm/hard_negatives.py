"""Hard negatives of anchors, with score bounds along a spanning tree of the anchors.

An anchor's positives are the ``positives`` best rows of its label. The hard
negatives of an anchor and a positive are the ``negatives`` best rows of other
labels with a score of ``low`` to ``high`` per cent of the positive's. A score is
the inner product of whole-number vectors, exact; ties go to the smaller id.

Anchors are dealt into chunks of near ones (the nearest of a bounded sample, then
by hash), and each chunk has a minimum spanning tree. Rows are packed into blocks.
For each block and chunk, every row has an interval for its score at every
anchor: the exact score where it was computed, otherwise the parent's interval,
widened on both sides by the edge's length times the row's norm. Only rows whose
interval meets the anchor's window are scored. The window narrows while a task
goes through its blocks: its lower end is the task's worst result so far.

A task reads its share of the rows once per pass and returns its best of each
anchor; the bests of all tasks are ranked per anchor. A pass broadcasts chunks of
``PASS_BYTES`` at most, so more anchors make more passes, not larger broadcasts.
No pair of a row and an anchor is ever a row of a table, whatever the labels.

Rows without id, label or vector, or with a null or huge component (beyond
``LARGEST``, where scores may leave 64 bits), take no part. Vectors meet vectors
of their own length only. Anchors that agree in everything are one anchor; equal
candidate rows take a rank each; rows with the anchor's id are not its partners.
An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow, ship
from sumtrail.session import written

#: Rows of a block, anchors of a chunk, and most anchors in the sample that deals them out.
BLOCK, CHUNK, PIVOTS = 2048, 512, 256
#: Most bytes of chunks that one pass broadcasts.
PASS_BYTES = 16 << 20
#: Largest component, so that 100 times a score of 1024 components fits 64 bits.
LARGEST = 1 << 23

_NONE = np.iinfo(np.int64).min


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where the vector or a component is null or not finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    # The bound keeps floor() within 64 bits; such components are far beyond LARGEST.
    held = F.transform(numbers, lambda x: F.floor(F.greatest(F.lit(-1e17), F.least(F.lit(1e17), x * scale))))
    return F.when(vector.isNotNull() & ~bad, held)


def _fit(rows: DataFrame) -> DataFrame:
    return (
        rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector")
        .where("id is not null and label is not null and vector is not null")
        .where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) <= LARGEST))))


# -- packing ------------------------------------------------------------------


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _bytes(matrix: np.ndarray) -> tuple[int, bytes]:
    """The matrix in the narrowest whole numbers that hold it, and their width."""
    most = int(np.abs(matrix).max(initial=0))
    width = 2 if most < 1 << 15 else 4
    return width, matrix.astype(f"<i{width}").tobytes()


def _read(raw: bytes, width: int, dim: int) -> np.ndarray:
    numbers = np.frombuffer(raw, f"<i{width}")
    return numbers.astype(np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))


_BLOCK = T.StructType([
    T.StructField("dim", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("labels", T.BinaryType()), T.StructField("width", T.IntegerType()), T.StructField("vectors", T.BinaryType())])


def packed(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` as blocks of vectors of one length."""
    target = arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        open_: dict[int, list[pa.RecordBatch]] = {}

        def closed(dim: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(open_.pop(dim)).combine_chunks()
            width, raw = _bytes(_matrix(t["vector"].combine_chunks(), dim))
            values = [dim, number, t["id"].to_numpy().tobytes(), t["label"].to_numpy().tobytes(), width, raw]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                own = batch.filter(pa.array(lengths == dim))
                for at in range(0, own.num_rows, block):
                    open_.setdefault(dim, []).append(own.slice(at, block))
                    if sum(b.num_rows for b in open_[dim]) >= block:
                        yield closed(dim)
                        number += 1
        for dim in list(open_):
            yield closed(dim)
            number += 1

    return map_arrow(rows.select("id", "label", "vector"), run, _BLOCK)


def spanning_tree(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree: nodes in an order that puts parents first, each node's parent as a place in it, edge lengths."""
    n = len(matrix)
    squares = (matrix**2).sum(axis=1)
    far, near = np.full(n, np.inf), np.zeros(n, np.int64)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    place = np.full(n, -1)
    node = int(((matrix - matrix.mean(axis=0)) ** 2).sum(axis=1).argmin())
    for k in range(n):
        order[k], place[node], far[node] = node, k, -np.inf
        if k:
            parent[k] = place[near[node]]
            edge[k] = np.linalg.norm(matrix[node] - matrix[near[node]])
        reach = squares + squares[node] - 2 * (matrix @ matrix[node])
        closer = (place < 0) & (reach < far)
        far[closer], near[closer] = reach[closer], node
        node = int(np.where(place < 0, far, np.inf).argmin())
    return order, parent, edge


_CHUNK = T.StructType([
    T.StructField("dim", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("own_ids", T.BinaryType()), T.StructField("own_labels", T.BinaryType()), T.StructField("own_width", T.IntegerType()),
    T.StructField("own_vectors", T.BinaryType()), T.StructField("parents", T.BinaryType()), T.StructField("edges", T.BinaryType())])


def chunks(anchors: DataFrame) -> DataFrame:
    """Anchors in chunks of near ones, each with its spanning tree."""
    spark = anchors.sparkSession
    anchors = written(anchors.dropDuplicates(["id", "label", "vector"]).withColumn("dim", F.size("vector")).where("dim > 0"))
    pivots = min(PIVOTS, anchors.count() // CHUNK)
    sample: dict[int, list] = {}
    if pivots > 1:
        for row in anchors.orderBy(F.xxhash64("id"), "id").limit(pivots).collect():
            sample.setdefault(row.dim, []).append(row.vector)
    near = {dim: np.array(v, np.float64) for dim, v in sample.items()}

    kind = T.StructType([*anchors.schema.fields, T.StructField("pivot", T.LongType())])
    target = arrow_schema(kind)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            out = np.zeros(len(dims), np.int64)
            for dim in np.unique(dims).tolist():
                if (p := near.get(dim)) is not None:
                    own = dims == dim
                    m = _matrix(batch.column("vector").filter(pa.array(own)), dim).astype(np.float64)
                    out[own] = ((p**2).sum(axis=1) - 2 * (m @ p.T)).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], schema=target)

    dealt = written(map_arrow(anchors, nearest, kind)) if near else anchors.withColumn("pivot", F.lit(0).cast("long"))
    parts = dealt.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    # Equal vectors share a pivot; the hash deals them out all the same.
    dealt = dealt.join(parts, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.col("parts")))
    out = arrow_schema(_CHUNK)

    def tree(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        chunk = (dim * PIVOTS + table["pivot"][0].as_py() << 32) + table["part"][0].as_py()
        matrix = _matrix(table["vector"].combine_chunks(), dim)
        order, parent, edge = spanning_tree(matrix.astype(np.float64))
        width, raw = _bytes(matrix[order])
        values = [dim, chunk, len(order), table["id"].to_numpy()[order].tobytes(), table["label"].to_numpy()[order].tobytes(),
                  width, raw, parent.tobytes(), edge.tobytes()]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, out)], schema=out)

    ship(spark)
    return dealt.groupBy("dim", "pivot", "part").applyInArrow(tree, _CHUNK)


# -- search -------------------------------------------------------------------


class _Block:
    def __init__(self, row: dict) -> None:
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.vectors = _read(row["vectors"], row["width"], row["dim"])
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.of = {int(v): self.labels == v for v in np.unique(self.labels)}


class _Chunk:
    """A chunk's tree with, for each anchor and goal, the ``k`` best results so far."""

    def __init__(self, row: dict, k: int) -> None:
        self.ids, self.labels = np.frombuffer(row["own_ids"], np.int64), np.frombuffer(row["own_labels"], np.int64)
        self.vectors = _read(row["own_vectors"], row["own_width"], row["dim"])
        self.parents, self.edges = np.frombuffer(row["parents"], np.int64), np.frombuffer(row["edges"], np.float64)
        n, goals = len(self.ids), row.get("goals")
        self.same = goals is None
        width = 1 if self.same else max((g["goal"] for g in goals), default=0)
        # Bounds of the windows; a goal that does not exist has an empty one.
        self.low, self.high = np.full((n, width), _NONE if self.same else -_NONE - 1), np.full((n, width), -_NONE - 1 if self.same else _NONE)
        for g in goals or ():
            self.low[g["place"], g["goal"] - 1], self.high[g["place"], g["goal"] - 1] = g["low"], g["high"]
        self.scores, self.found = np.full((n, width, k), _NONE), np.zeros((n, width, k), np.int64)

    def search(self, block: _Block) -> int:
        """Take in a block; returns how many rows were scored."""
        n, scored = len(self.ids), 0
        lows, highs = np.empty((n, len(block.ids))), np.empty((n, len(block.ids)))
        exact = self.vectors.shape[1] * float(np.abs(self.vectors).max(initial=0)) * float(np.abs(block.vectors).max(initial=0)) < 2**53
        everyone = np.zeros(len(block.ids), bool)
        for node in range(n):
            # The factor covers the rounding of lengths and norms.
            reach = block.norms * (self.edges[node] * (1 + 1e-9)) + 1e-6 if node else np.inf
            lows[node], highs[node] = lows[self.parents[node]] - reach if node else -np.inf, highs[self.parents[node]] + reach if node else np.inf
            bottom = np.maximum(self.low[node], self.scores[node, :, -1])
            live = bottom <= self.high[node]
            if not live.any():
                if node:
                    continue
                at = np.arange(len(block.ids))  # the root's scores start all bounds
            else:
                own = block.of.get(int(self.labels[node]), everyone)
                meets = (highs[node] >= float(bottom[live].min())) & (lows[node] <= float(self.high[node][live].max()))
                at = np.flatnonzero(meets if not node else meets & (own if self.same else ~own))
            if exact:
                score = (block.vectors[at] @ self.vectors[node]).astype(np.int64)
            else:
                score = block.vectors[at].astype(np.int64) @ self.vectors[node].astype(np.int64)
            scored += len(at)
            lows[node, at] = highs[node, at] = score
            fits = (block.labels[at] == self.labels[node]) == self.same
            fits &= block.ids[at] != self.ids[node]
            for goal in np.flatnonzero(live).tolist():
                new = np.flatnonzero(fits & (score >= bottom[goal]) & (score <= self.high[node, goal]))
                if len(new):
                    self._keep(node, goal, score[new], block.ids[at[new]])
        return scored

    def _keep(self, node: int, goal: int, score: np.ndarray, ids: np.ndarray) -> None:
        old = self.scores[node, goal] != _NONE
        score, ids = np.concatenate([self.scores[node, goal][old], score]), np.concatenate([self.found[node, goal][old], ids])
        best = np.lexsort((ids, -score))[: self.scores.shape[2]]
        self.scores[node, goal, : len(best)], self.found[node, goal, : len(best)] = score[best], ids[best]

    def results(self) -> tuple[np.ndarray, ...]:
        """(place, goal from 1, id, score) of all that was kept."""
        place, goal, at = np.nonzero(self.scores != _NONE)
        return place, goal + 1, self.found[place, goal, at], self.scores[place, goal, at]


_FOUND = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("goal", T.IntegerType()),
    T.StructField("anchor_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.LongType())])


def searched(blocks: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Each task's ``k`` best rows of every anchor and goal; without ``goals`` in the chunks, of the anchor's own label."""
    target = arrow_schema(_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, _Chunk] = {}
        number, block = None, None
        for batch in batches:
            for k_row in range(batch.num_rows):
                if (now := batch.column("block")[k_row].as_py()) != number:
                    number, block = now, _Block({c: batch.column(c)[k_row].as_py() for c in ("ids", "labels", "vectors", "width", "dim")})
                if (chunk := batch.column("chunk")[k_row].as_py()) not in trees:
                    trees[chunk] = _Chunk({c: batch.column(c)[k_row].as_py() for c in batch.schema.names}, k)
                trees[chunk].search(block)
        for chunk, tree in trees.items():
            place, goal, ids, scores = tree.results()
            values = [np.full(len(ids), chunk), place, goal, tree.ids[place], ids, scores]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target)], schema=target)

    return map_arrow(blocks.join(F.broadcast(chunks), "dim"), run, _FOUND)


def passes(chunks: DataFrame, most: int = PASS_BYTES) -> list[tuple[int, int]]:
    """Ranges of chunk numbers whose chunks hold ``most`` bytes at most (a single chunk may hold more)."""
    size = F.length("own_vectors") + 40 * F.col("n") + (F.size("goals") * 64 if "goals" in chunks.columns else 0)
    out: list[list[int]] = []
    room = 0
    for chunk, n in chunks.select("chunk", size.cast("long")).orderBy("chunk").collect():
        if not out or n > room:
            out.append([chunk, chunk])
            room = most
        out[-1][1] = chunk
        room -= n
    return [tuple(r) for r in out]


def _best(blocks: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of every anchor and goal, with their rank."""
    ranges = passes(chunks)
    found = None
    for low, high in ranges or [(0, -1)]:
        one = searched(blocks, chunks.where(F.col("chunk").between(low, high)), k)
        one = written(one) if len(ranges) > 1 else one
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("chunk", "place", "goal").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """Hard negatives among ``rows`` (id, label, vector of whole numbers) for each of ``anchors`` and each of its positives.

    Returns anchor_id, positive_id, rank from 1, negative_id, positive_score and negative_score.
    """
    blocks = written(packed(_fit(rows)))
    trees = written(chunks(_fit(anchors)))
    best = written(_best(blocks, trees, positives).select(
        "chunk", "place", F.col("rank").alias("goal"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # Whole numbers: the least and largest score within low and high per cent.
    share = lambda p: F.expr(f"(positive_score * {p} - pmod(positive_score * {p}, 100)) div 100")
    window = F.struct("place", "goal", (-F.expr(f"(-positive_score * {low} - pmod(-positive_score * {low}, 100)) div 100")).alias("low"), share(high).alias("high"))
    goals = best.groupBy("chunk").agg(F.collect_list(window).alias("goals"))
    asked = written(trees.join(goals, "chunk"))
    found = _best(blocks, asked, negatives)
    return found.join(best, ["chunk", "place", "goal"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
