"""Mix sources to target weights with a low-discrepancy schedule.

Each source is a shuffled stream of words cut into blocks of equal size. Slots
of the mix are laid on a golden-ratio lattice: slot i stands at i·m modulo the
number of slots, m being a whole number next to (slots / golden ratio) that
shares no factor with it. The lattice visits every position once, so a source
whose interval of positions is q wide gets exactly q slots, evenly spread over
the schedule. The slots of a source are ranked and joined with its blocks in
turn; once all blocks are used the next pass starts.

Everything is DataFrame operations. Only ids, sizes and hashes are shuffled,
never texts. Long prefix sums (positions of documents in a stream, ranks of
slots) are taken inside chunks of bounded size and then offset by the sums of
the chunks before, so a hot source is spread over many tasks. The windows
without partitions or per source run over one row per source or per chunk.

Null or blank texts have size 0 and are never taken. A null source is a source
of its own and comes last. Rows that agree in all used columns are
interchangeable; ties are broken by hash and position. An empty table gives an
empty result. Extra columns are ignored by :func:`schedule` and kept by
:func:`mixed`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumtrail.session import written

GOLDEN = (math.sqrt(5) - 1) / 2


@dataclass(frozen=True)
class Mix:
    """Weights by the sources' order, total as a share of all words, most passes over a source."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    total: float = 1.5
    most: float = 2.0
    block_words: int = 2048
    least_blocks: int = 256
    chunk_docs: int = 2_000
    chunk_slots: int = 5_000
    seed: int = 11


MIX = Mix()


def n_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Words to take per source, from a table (source, source_size) of one row per source.

    Shares follow the weights; no source gives more than ``most`` times its size,
    and what it can't give is shared by weight among the others. Sorted by the
    level at which a source is full, the full ones are a prefix; the level of the
    rest follows from running sums.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, mix.weights)),
                          ((F.row_number().over(order) - 1) % len(mix.weights) + 1).cast("int"))
    every = Window.partitionBy()
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * mix.most)
        .withColumn("full_at", F.col("cap") / F.col("weight"))
        .withColumn("left_words", F.sum("source_size").over(every) * mix.total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        # The first source that stays below its cap sets the level of all from there on.
        .withColumn("open", F.col("level") < F.col("full_at"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct("full_at", "level"))).over(every)["level"])
        .withColumn("target", F.when(F.col("final").isNull() | (F.col("full_at") <= F.col("final")), F.col("cap"))
                    .otherwise(F.col("weight") * F.col("final")))
        .select("source", "source_size", "weight", F.col("target").cast("double").alias("target"))
    )


def placed(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Place every document in the shuffled stream of its source.

    Needs doc_id, source and text. Returns doc_id, source, size, key (of the row,
    unique) and start (words before it in the stream). Written once, as sizes,
    positions and the schedule all read it.
    """
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                                F.xxhash64("doc_id", "text", F.lit(mix.seed)).alias("shuffle")))
    chunks = (
        sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
        .withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("n") / mix.chunk_docs)).cast("long"))
    )
    chunked = sized.join(
        chunks.select(F.col("source").alias("s"), "chunks"), F.col("source").eqNullSafe(F.col("s"))
    ).withColumn("chunk", F.pmod(F.shiftrightunsigned("shuffle", 20), "chunks")).drop("s", "chunks")
    sums = chunked.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"),
                          F.coalesce(F.sum("chunk_size").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "chunk").orderBy("shuffle", "doc_id", "size")
    return written(
        chunked.withColumn("place", F.row_number().over(inside))
        .withColumn("within", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
        .select("doc_id", "source", "size", "shuffle", F.struct("source", "chunk", "place").alias("key"),
                (F.col("offset") + F.col("within")).alias("start"))
    )


def quotas(sizes: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Blocks and slots of each source, and its interval of lattice positions.

    A source has equal blocks of at most ``block_words`` words, at least
    ``least_blocks`` of them where it has so many words. Its slots are its target
    over the size of its blocks, rounded, so at most ``most`` per block.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    blocks = F.greatest(F.ceil(F.col("source_size") / mix.block_words), F.least(F.col("source_size"), F.lit(mix.least_blocks)))
    return (
        targets(sizes, mix)
        .withColumn("blocks", blocks.cast("long"))
        .withColumn("slots", F.coalesce(F.round(F.col("target") * F.col("blocks") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
        .withColumn("until", F.sum("slots").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("since", F.col("until") - F.col("slots"))
    )


def largest_quotient(m: int, n: int) -> int:
    """Largest partial quotient of m / n as a continued fraction; small ones mean even spreading."""
    most = 0
    while m:
        q, r = divmod(n, m)
        most, n, m = max(most, q), m, r
    return most


def step(n: int) -> int:
    """A whole number next to n / golden ratio that shares no factor with n and spreads evenly."""
    middle = round(n * GOLDEN)
    near = [m for m in range(max(1, middle - 64), middle + 65) if math.gcd(m, n) == 1]
    return min(near, key=lambda m: (largest_quotient(m, n), abs(m - middle)))


def slots(quota: DataFrame, mix: Mix = MIX) -> DataFrame:
    """The schedule of blocks: slot, source, block, epoch.

    Positions are cut into cells of bounded size; a source's interval is listed
    once per cell that it meets, so finding a slot's source is an equality join.
    """
    spark = quota.sparkSession
    n = quota.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    cell = mix.chunk_slots
    position = F.pmod(F.col("slot").cast("decimal(20,0)") * F.lit(step(max(1, n))).cast("decimal(18,0)"), F.lit(max(1, n)).cast("decimal(20,0)")).cast("long")
    lattice = spark.range(n).select(F.col("id").alias("slot")).withColumn("position", position)
    cells = quota.where("slots > 0").select(
        "source", "blocks", "since", "until",
        F.explode(F.sequence(F.floor(F.col("since") / cell), F.floor((F.col("until") - 1) / cell))).alias("cell"))
    owned = (
        lattice.withColumn("cell", F.floor(F.col("position") / cell)).join(cells, "cell")
        .where("position >= since and position < until")
        .select("slot", "source", "blocks", F.floor(F.col("slot") / cell).alias("chunk"))
    )
    # Rank of a slot among its source's: those of earlier chunks, and those before it in its own.
    counts = owned.groupBy("source", "chunk").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("s"), F.col("chunk").alias("k"),
                            F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "chunk").orderBy("slot")
    rank = F.col("offset") + F.row_number().over(inside) - 1
    return (
        owned.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("k")))
        .withColumn("rank", rank)
        .select("slot", "source", (F.col("rank") % F.col("blocks")).alias("block"),
                F.floor(F.col("rank") / F.col("blocks")).alias("epoch"))
    )


def schedule(place: DataFrame, quota: DataFrame, mix: Mix = MIX) -> DataFrame:
    """What each slot takes: slot, epoch, source, block, doc_id, key, first word and words of the document."""
    edge = lambda b: F.floor(F.col("source_size").cast("decimal(20,0)") * b / F.col("blocks")).cast("long")
    block_of = lambda p: F.floor(((p + 1) * F.col("blocks") - 1).cast("decimal(38,0)") / F.col("source_size")).cast("long")
    sized = quota.select(F.col("source").alias("s"), "source_size", "blocks")
    parts = (
        place.where("size > 0").join(sized, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("block", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))))
        .withColumn("from_", F.greatest(F.col("start"), edge(F.col("block"))))
        .withColumn("to_", F.least(F.col("start") + F.col("size"), edge(F.col("block") + 1)))
        .where("to_ > from_")
        .select(F.coalesce(F.col("source"), F.lit("")).alias("name"), F.col("source").isNull().alias("none"), "block", "doc_id",
                "key", (F.col("from_") - F.col("start")).alias("first_word"), (F.col("to_") - F.col("from_")).alias("words"))
    )
    taken = slots(quota, mix).select("slot", "epoch", "source", "block", F.coalesce(F.col("source"), F.lit("")).alias("name"),
                                     F.col("source").isNull().alias("none"))
    return taken.join(parts, ["name", "none", "block"]).select("slot", "epoch", "source", "block", "doc_id", "key", "first_word", "words")


def report(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target (its source's), taken, key and shuffle."""
    place = placed(docs, mix)
    sizes = place.groupBy("source").agg(F.sum("size").alias("source_size"))
    quota = written(quotas(sizes, mix))
    taken = schedule(place, quota, mix).groupBy("key").agg(F.sum("words").alias("words"))
    sums = quota.select(F.col("source").alias("s"), "source_size", "target")
    return (
        place.join(taken.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left")
        .join(sums, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "source", "shuffle")
    )


def mixed(docs: DataFrame, mix: Mix = MIX) -> DataFrame:
    """The documents of the mix, each as often as the schedule takes it, whole.

    Blocks may cut a document at the end of a source's last pass; there it is
    taken when at least half of its words are. Rows are matched by doc_id and a hash of
    the row, so rows that agree in both share the copies of their group.
    """
    copies = (
        report(docs, mix).where("size > 0")
        .select(F.col("doc_id").alias("__id"), F.col("shuffle").alias("__hash"),
                F.floor((2 * F.col("taken") + F.col("size")) / (2 * F.col("size"))).alias("n"))
        .groupBy("__id", "__hash").agg(F.sum("n").alias("__n"), F.count("*").alias("__rows"))
        .where("__n > 0")
    )
    hashed = docs.withColumn("__own", F.xxhash64("doc_id", "text", F.lit(mix.seed)))
    joined = hashed.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")))
    # A lone row gives all its copies; rows that are equal give the rounded mean of theirs.
    each = F.round(F.col("__n") / F.col("__rows")).cast("int")
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), each))).select(*docs.columns)
