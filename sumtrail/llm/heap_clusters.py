"""Lloyd's algorithm on whole-number vectors, with heaps of bounds.

Every vector has an upper bound on the distance to its own centroid and a lower
bound on the distance to any other. When centroids move, the gap between the two
shrinks at most by the way of its own centroid and the longest way of the others.
That sum is the same for all vectors of a cluster, so it is added up once per
cluster, as drift, and each cluster keeps a heap of its vectors ordered by their
gap plus the drift at the time they entered. Only vectors whose entry is not above
the present drift can have changed sides: they are popped, their distances to all
centroids computed exactly, and they enter the heap of the nearest.

Vectors are packed into blocks, written once, bucketed by block. Heaps are a
second table in the same buckets, so a round joins both without a shuffle, writes
new heaps (some twelve bytes a vector) and for each block the sums that moved.
Centroids, counts and drifts are all the driver holds. Sums and distances are
whole numbers, so results do not depend on blocks or tasks.

Vectors of another length, with a null or not finite component, or with one that
exceeds ``LARGEST`` when scaled (distances may leave 64 bits there), are not kept.
Centroids start as the kept vectors with the smallest hash of their id, equal
hashes by vector; rows without id are clustered but start no centroid unless
others run out. Fewer vectors than centroids make fewer clusters. Ties go to the
smaller number, an empty cluster keeps its centroid, equal rows are clustered
each. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow
from sumtrail.llm.hard_negatives import whole
from sumtrail.session import shared_folder, written

#: Vectors of a block; blocks of a bucket, about.
BLOCK, BUCKET = 4096, 64
#: Largest component: distances between vectors of 64 stay below 2^62.
LARGEST = 1 << 27


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row per vector; both are whole numbers."""
    most = max(int(np.abs(vectors).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if vectors.shape[1] * 4 * most * most < 2**53:
        v, c = vectors.astype(np.float64), centroids.astype(np.float64)
        return ((v**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * (v @ c.T)).astype(np.int64)
    v, c = vectors.astype(np.int64), centroids.astype(np.int64)
    return np.stack([((v - one) ** 2).sum(axis=1) for one in c], axis=1)


def gaps(distances: np.ndarray, nearest: np.ndarray) -> np.ndarray:
    """Distance to the second centroid less that to the nearest, rounded down; infinite for a single one."""
    rows = np.arange(len(nearest))
    roots = np.sqrt(distances.astype(np.float64))
    own = roots[rows, nearest]
    roots[rows, nearest] = np.inf
    other = roots.min(axis=1, initial=np.inf)
    return np.where(np.isinf(other), np.inf, other - own - 1e-9 * (1 + np.where(np.isinf(other), 0, other)))


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By how much gaps of each cluster can shrink when centroids move, rounded up."""
    way = np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
    others = [np.delete(way, c).max(initial=0.0) for c in range(len(way))]
    return (way + np.array(others)) * (1 + 1e-9)


# -- heaps --------------------------------------------------------------------


class Heaps:
    """For each cluster, (gap plus drift, index of the vector), least first."""

    def __init__(self, heaps: list[list[tuple[float, int]]]) -> None:
        self.heaps = heaps

    @classmethod
    def new(cls, keys: np.ndarray, clusters: np.ndarray, k: int) -> Heaps:
        heaps = [list(zip(keys[i := np.flatnonzero(clusters == c)].tolist(), i.tolist())) for c in range(k)]
        for heap in heaps:
            heapify(heap)
        return cls(heaps)

    @classmethod
    def read(cls, keys: bytes, places: bytes, sizes: list[int]) -> Heaps:
        ends = np.cumsum([0, *sizes]).tolist()
        keys, places = np.frombuffer(keys, np.float64).tolist(), np.frombuffer(places, np.int32).tolist()
        return cls([list(zip(keys[a:b], places[a:b])) for a, b in zip(ends, ends[1:])])

    def values(self) -> tuple[bytes, bytes, list[int]]:
        both = [entry for heap in self.heaps for entry in heap]
        keys, places = np.array([e[0] for e in both], np.float64), np.array([e[1] for e in both], np.int32)
        return keys.tobytes(), places.tobytes(), [len(h) for h in self.heaps]

    def expired(self, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pop every vector whose gap may be used up; their indexes and clusters."""
        places, clusters = [], []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c]:
                places.append(heappop(heap)[1])
                clusters.append(c)
        return np.array(places, np.int64), np.array(clusters, np.int64)

    def enter(self, keys: np.ndarray, places: np.ndarray, clusters: np.ndarray) -> None:
        for key, place, c in zip(keys.tolist(), places.tolist(), clusters.tolist()):
            heappush(self.heaps[c], (key, place))

    def clusters(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        for c, heap in enumerate(self.heaps):
            out[[place for _, place in heap]] = c
        return out


def moved_sums(vectors: np.ndarray, old: np.ndarray | None, new: np.ndarray, k: int) -> np.ndarray:
    """k x (1 + length): counts and sums that clusters gain, less what they lose; without ``old`` all is gained."""
    out = np.zeros((k, 1 + vectors.shape[1]), np.int64)
    for c in range(k):
        gained = new == c
        out[c] = [gained.sum(), *vectors[gained].sum(axis=0, dtype=np.int64)]
        if old is not None:
            lost = old == c
            out[c] -= [lost.sum(), *vectors[lost].sum(axis=0, dtype=np.int64)]
    return out


# -- tables -------------------------------------------------------------------


def bucketed(df: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder in buckets by block, and the name of the table."""
    spark = df.sparkSession
    name = f"heap_clusters_{uuid.uuid4().hex}"
    (df.repartition(buckets, "block").write.bucketBy(buckets, "block").sortBy("block").format("parquet")
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name), name


def _dropped(spark: SparkSession, name: str) -> None:
    """Forget the table and delete its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_HEAPS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("keys", T.BinaryType()), T.StructField("places", T.BinaryType()),
    T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("moved", T.ArrayType(T.LongType()))])


def kept(rows: DataFrame, length: int, largest: int = LARGEST) -> DataFrame:
    """``rows`` (id, vector) whose vectors have the length and whole components within bounds."""
    return rows.select("id", "vector").where(F.size("vector") == length).where(
        F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) <= largest)))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k smallest sha256 of ``seed:id``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = rows.withColumn("hash", key).orderBy(F.asc_nulls_last("hash"), "vector").limit(k).collect()
    return np.array([r.vector for r in first], np.int64)


def packed(rows: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """``rows`` as blocks of ids and vectors."""
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)),
        T.StructField("width", T.IntegerType()), T.StructField("vectors", T.BinaryType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def closed() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            m = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            width = next(w for w in (2, 4) if int(np.abs(m).max(initial=0)) < 1 << 8 * w - 1)
            values = [number, t["id"].to_pylist(), width, m.astype(f"<i{width}").tobytes()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                held.append(batch.slice(at, block))
                if sum(b.num_rows for b in held) >= block:
                    yield closed()
                    number += 1
        if held:
            yield closed()

    return map_arrow(rows.select("id", "vector"), run, schema)


def _vectors(row: dict, length: int) -> np.ndarray:
    return np.frombuffer(row["vectors"], f"<i{row['width']}").reshape(-1, length)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {c: batch.column(c)[k].as_py() for c in batch.schema.names}


def _entered(blocks: DataFrame, centroids: np.ndarray, length: int) -> DataFrame:
    """Heaps of all vectors, from distances to all centroids."""
    target, k = arrow_schema(_HEAPS), len(centroids)

    def run(batches):
        for row in _rows(batches):
            vectors = _vectors(row, length)
            distances = squared(vectors, centroids)
            near = distances.argmin(axis=1)
            heaps = Heaps.new(gaps(distances, near), near, k)
            values = [row["block"], *heaps.values(), moved_sums(vectors, None, near, k).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

    return map_arrow(blocks.select("block", "width", "vectors"), run, _HEAPS)


def _round(both: DataFrame, centroids: np.ndarray, drift: np.ndarray, length: int) -> DataFrame:
    """Heaps after a move of the centroids: expired vectors are popped, compared with all centroids and entered again."""
    target, k = arrow_schema(_HEAPS), len(centroids)

    def run(batches):
        for row in _rows(batches):
            heaps = Heaps.read(row["keys"], row["places"], row["sizes"])
            places, old = heaps.expired(drift)
            vectors = _vectors(row, length)[places]
            distances = squared(vectors, centroids)
            near = distances.argmin(axis=1)
            heaps.enter(gaps(distances, near) + drift[near], places, near)
            left = near != old
            values = [row["block"], *heaps.values(), moved_sums(vectors[left], old[left], near[left], k).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, target)], schema=target)

    return map_arrow(both.select("block", "width", "vectors", "keys", "places", "sizes"), run, _HEAPS)


def _assigned(both: DataFrame, centroids: np.ndarray, length: int, kind: T.DataType) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    schema = T.StructType([T.StructField("id", kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    target = arrow_schema(schema)

    def run(batches):
        for row in _rows(batches):
            vectors = _vectors(row, length)
            near = Heaps.read(row["keys"], row["places"], row["sizes"]).clusters(len(vectors))
            distance = np.zeros(len(near), np.int64)
            for c in np.unique(near).tolist():
                distance[near == c] = squared(vectors[near == c], centroids[c : c + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip([row["ids"], near, distance], target)], schema=target)

    return map_arrow(both.select("ids", "width", "vectors", "keys", "places", "sizes"), run, schema)


def _gained(heaps: DataFrame, k: int) -> np.ndarray:
    """What clusters gained and lost over all blocks, as k x (1 + length); exact."""
    moved = heaps.select(F.posexplode("moved").alias("at", "n")).where("n <> 0")
    out = {r["at"]: int(r["n"]) for r in moved.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}
    width = heaps.select(F.size("moved")).first()[0]
    return np.array([out.get(i, 0) for i in range(width)], object).reshape(k, -1)


def clustered(rows: DataFrame, length: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of the vectors kept from ``rows`` (id, vector of whole numbers), distances squared, and the centroids.

    ``rounds`` rounds assign all vectors and move the centroids, then vectors are
    assigned once more.
    """
    spark, kind = rows.sparkSession, rows.schema["id"].dataType
    rows = kept(rows, length)
    centroids = first_centroids(rows, k, seed)
    k = len(centroids)
    if not k:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    plain = written(packed(rows, length))
    buckets = max(1, -(-plain.count() // BUCKET), min(200, 2 * spark.sparkContext.defaultParallelism))
    blocks, table = bucketed(plain, buckets)
    heaps, name = bucketed(_entered(blocks, centroids, length), buckets)
    totals, drift = _gained(heaps, k), np.zeros(k)
    for _ in range(rounds):
        moved = centroids.copy()
        for c in range(k):
            if totals[c, 0]:
                moved[c] = [int(s) // int(totals[c, 0]) for s in totals[c, 1:]]
        drift, centroids = drift + drifts(centroids, moved), moved
        old = name
        heaps, name = bucketed(_round(blocks.join(heaps.drop("moved"), "block"), centroids, drift, length), buckets)
        _dropped(spark, old)
        totals = totals + _gained(heaps, k)
    out = written(_assigned(blocks.join(heaps.drop("moved"), "block"), centroids, length, kind))
    _dropped(spark, name)
    _dropped(spark, table)
    return out, centroids.tolist()


def report(rows: DataFrame, length: int = 64, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """``clustered`` with cluster_inertia, inertia and centroid_sha256, the hash of the centroid's components joined by commas.

    A sum that does not fit 64 bits is null.
    """
    spark = rows.sparkSession
    found, centroids = clustered(rows, length, k, rounds, seed)
    sums = {r.cluster: int(r.n) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    total = sum(sums.values())
    held = lambda n: n if n < 1 << 63 else None
    facts = [(c, held(sums.get(c, 0)), held(total), sha256(",".join(map(str, one)).encode()).hexdigest()) for c, one in enumerate(centroids)]
    # One row per centroid.
    about = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

