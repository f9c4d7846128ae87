"""Exact top-k search of binary codes by incremental multi-index hashing.

Codes are cut into segments of a width that follows the number of codes, and
each segment has an index. A query probes, segment by segment, all values at
distance 0, then 1, 2 and so on from its own. After radius r every code that
was not met differs by more than r in each of the m segments, so by at least
m (r + 1) in all: the search of a query ends once its k-th verified distance is
no more than that less one.

Equal codes are one index entry with their k smallest ids, and equal queries
are searched once, so copies cost nothing. Radii grow for all open queries
together, as joins of probes with the index on (segment, value); a probe keeps
only codes that can still enter the query's best k. Nothing is capped: the last
radius covers every code.

A vector is a code of its components' signs (a bit for every component of 0 or more).
Rows without id or code are not searched; the query takes vectors of 64
components. Ties go to the smallest id; a query does not find
itself. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow
from sumtrail.session import written


def sign_code(vector: Column, bits: int) -> Column:
    """Signs of up to 64 components as a whole number; the first component is the lowest bit."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.when(vector[k] >= 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    return out


def segments(bits: int, n: int) -> list[tuple[int, int]]:
    """(first bit, width) of equal segments of about log2(n) - 3 bits: some eight codes for each value.

    Looking at a code costs less than making a probe, so values are shared by a few codes.
    """
    m = max(1, round(bits / min(bits, max(4.0, math.log2(max(2, n)) - 3))))
    edges = [round(k * bits / m) for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def part(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else code


def masks(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits with ``radius`` bits set."""
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


_PROBE = T.StructType([
    T.StructField("query", T.LongType()), T.StructField("worst", T.IntegerType()), T.StructField("segment", T.IntegerType()),
    T.StructField("value", T.LongType())])


def probes(queries: DataFrame, cuts: list[tuple[int, int]], radius: int, rows: int = 1 << 16) -> DataFrame:
    """(query, worst, segment, value) of all values at distance ``radius`` from each segment of each query, some ``rows`` at a time."""
    target = arrow_schema(_PROBE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {width: np.array(masks(width, radius), np.int64) for _, width in cuts}
        for batch in batches:
            query, worst = batch.column("query").to_numpy(), batch.column("worst").to_numpy()
            for s, (first, width) in enumerate(cuts):
                flip = flips[width]
                step = max(1, rows // max(1, len(flip)))
                own = (query.view(np.uint64) >> np.uint64(first)).view(np.int64)
                own = own if width == 64 else own & ((1 << width) - 1)
                for at in range(0, len(query) if len(flip) else 0, step):
                    value = (own[at : at + step, None] ^ flip).ravel()
                    columns = [np.repeat(query[at : at + step], len(flip)), np.repeat(worst[at : at + step], len(flip)), np.full(len(value), s, np.int32), value]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    return map_arrow(queries.select("query", F.col("worst").cast("int").alias("worst")), run, _PROBE)


def neighbours(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64) -> DataFrame:
    """The k nearest rows of ``codes`` (id, code) for each row of ``queries`` (id, code), by Hamming distance.

    Returns query_id, rank from 1, id and distance.
    """
    spark = codes.sparkSession
    by_id = Window.partitionBy("code").orderBy("id")
    # k + 1 ids per code: one of them may be the query itself.
    entries = written(
        codes.where("id is not null and code is not null").select("id", "code").distinct()
        .withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1)
        .groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = written(queries.where("id is not null and code is not null").select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct())
    cuts = segments(bits, entries.count())
    index = written(entries.select("code", F.size("ids").alias("held"), F.explode(F.array(*[
        F.struct(F.lit(s).alias("segment"), part(F.col("code"), *cut).alias("value")) for s, cut in enumerate(cuts)])).alias("key"))
        .select("code", "held", "key.segment", "key.value"))
    # A query needs k ids besides itself, so codes that hold k + 1 ids are enough.
    open_ = written(asked.select("query").distinct().withColumn("worst", F.lit(bits)))
    met = spark.createDataFrame([], "query long, code long, held int, distance int")
    done = spark.createDataFrame([], "query long, code long, distance int")
    for radius in range(max(w for _, w in cuts) + 1):
        # Probes are many more than the queries they come from, which is all that size estimates
        # know of; a merge join never gathers either side anywhere.
        probe = probes(open_, cuts, radius).hint("merge")
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        new = probe.join(index, ["segment", "value"]).where(distance <= F.col("worst")).select(
            "query", "code", "held", distance.cast("int").alias("distance")).distinct()
        near = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)
        # Codes matter until nearer ones hold k + 1 ids; all codes at one distance stay together, for ties by id.
        best = written(
            met.unionByName(new).distinct().withColumn("before", F.coalesce(F.sum("held").over(near), F.lit(0)))
            .where(F.col("before") <= k).drop("before"))
        state = written(
            best.groupBy("query").agg(F.sum("held").alias("ids"), F.max("distance").alias("worst"))
            .where((F.col("ids") > k) & (F.col("worst") <= len(cuts) * (radius + 1) - 1)).select("query"))
        last = radius == max(w for _, w in cuts)
        closed = best if last else best.join(state, "query", "left_semi")
        done = done.unionByName(written(closed.select("query", "code", "distance")))
        if last:
            break
        reach = best.groupBy("query").agg(F.sum("held").alias("ids"), F.max("distance").alias("far"))
        left = open_.join(state, "query", "left_anti")
        open_ = written(left.join(reach, "query", "left").select(
            "query", F.when(F.col("ids") > k, F.col("far")).otherwise(F.col("worst")).cast("int").alias("worst")))
        met = best.join(state, "query", "left_anti")
        if not open_.take(1):
            break
    hits = (
        asked.join(done, "query").join(entries, "code").select("query_id", "distance", F.explode("ids").alias("id"))
        .where("id <> query_id"))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
