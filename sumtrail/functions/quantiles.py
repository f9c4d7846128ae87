"""Exact quantiles of columns of any size.

``percentile`` keeps every distinct value of a group in one buffer and a
ranking window sorts a whole group in one task; neither survives a measure
with billions of values. Here a mergeable sketch first brackets each wanted
rank, then one counting pass keeps single values only inside the brackets and
collapses everything between them into one row. The exact order statistics
are read off the cumulative counts of that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumtrail.functions.grouping import join_by, window_by
from sumtrail.functions.values import finite
from sumtrail.session import written

# Rank error of the sketch is at most 1/ACCURACY of the rows; the bracket is
# three errors wide on each side, so the wanted rank is always inside it.
ACCURACY = 100_000
MARGIN = 3.0 / ACCURACY

# A bracket is counted in so many parts, each of its own.
PARTS = 256


def exact_quantiles(
    rows: DataFrame,
    value: str,
    fractions: Sequence[float],
    by: Sequence[str] = (),
    rank_form: bool = False,
    names: Sequence[str] | None = None,
    extra: Sequence[Column] = (),
) -> DataFrame:
    """One row per key with one column per fraction, plus the row count ``n``.

    By default the quantile interpolates at position ``(n-1)*q``. With
    ``rank_form`` it is the element at index ``floor(n*q)``, not interpolated.
    ``extra`` are further aggregates of the number column ``_x``, computed in
    the sketching pass so that they cost no scan of their own.
    """
    by = list(by)
    names = list(names or [f"q{round(f * 100)}" for f in fractions])
    x = rows.select(*by, finite(F.col(value)).alias("_x"))

    edges = []
    for f in fractions:
        edges += [max(0.0, f - MARGIN), min(1.0, f + MARGIN)]
    sketch = x.groupBy(*by).agg(
        F.count("_x").alias("_rows"),
        F.percentile_approx("_x", F.array(*map(F.lit, edges)), F.lit(ACCURACY)).alias("_edges"),
        *extra,
    )
    kept = sketch.columns[len(by) + 2:]
    # Read below by the counting pass and for ``extra``. Written, it is small
    # enough to be broadcast whenever the number of keys allows it, and the
    # rows stay where they are.
    sketch = written(sketch)

    inside, below, passed = F.lit(False), F.lit(float("-inf")), F.lit(0)
    part = F.lit(None).cast("int")
    for i in reversed(range(len(fractions))):
        low, high = F.col("_edges")[2 * i], F.col("_edges")[2 * i + 1]
        within = F.col("_x").between(low, high)
        slot = F.least(F.floor((F.col("_x") - low) / (high - low) * PARTS), F.lit(PARTS - 1))
        part = F.when(within, i * PARTS + F.when(high > low, slot).otherwise(0).cast("int")).otherwise(part)
        inside = inside | within
        below = F.greatest(below, F.when(high < F.col("_x"), high).otherwise(F.lit(float("-inf"))))
        passed = passed + F.when(high < F.col("_x"), 1).otherwise(0)
    counted = written(
        join_by(x, sketch.drop(*kept), by)
        .select(
            *by,
            F.when(inside, F.col("_x")).otherwise(below).alias("_key"),
            (~inside).alias("_gap"), F.when(inside, part).otherwise(-1 - passed).alias("_part"),
            "_x", "_rows",
        )
        .groupBy(*by, "_rows", "_part", "_key", "_gap")
        .agg(F.count("_x").alias("_n"), F.min("_x").alias("_first"), F.max("_x").alias("_last"))
        # Missing numbers are dropped here rather than before the aggregation,
        # where the filter would compute a derived column a second time.
        .where("_n > 0")
    )
    # Positions: those of earlier parts, of which a key has a set number, and
    # those inside the part. No task sees more than one part of a bracket.
    parts = counted.groupBy(*by, "_part").agg(
        F.sum("_n").alias("_in_part"), F.min(F.struct("_key", "_gap")).alias("_place"))
    earlier = window_by(by).orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, "_part", F.coalesce(F.sum("_in_part").over(earlier), F.lit(0)).alias("_before"))
    upto = F.col("_before") + F.sum("_n").over(window_by([*by, "_part"]).orderBy("_key", "_gap"))
    ranked = join_by(counted, offsets, [*by, "_part"]).withColumn("_end", upto).withColumn("_start", F.col("_end") - F.col("_n"))

    def element(index):
        """Value at a 0-based index; an index inside a gap can only be its edge."""
        here = (F.col("_start") <= index) & (index < F.col("_end"))
        at = (
            F.when(index == F.col("_start"), F.col("_first"))
            .when(index == F.col("_end") - 1, F.col("_last"))
            .when(~F.col("_gap"), F.col("_first"))
            .otherwise(F.raise_error(F.lit("quantile bracket missed the wanted rank")).cast("double"))
        )
        return F.max(F.when(here, at))

    picks = []
    for f, name in zip(fractions, names):
        if rank_form:
            index = F.least(F.floor(F.col("_rows") * F.lit(f)), F.col("_rows") - 1)
            picks.append(element(index).alias(name))
            continue
        position = (F.col("_rows") - 1) * F.lit(f)
        picks.append(element(F.floor(position)).alias(f"_lo_{name}"))
        picks.append(element(F.ceil(position)).alias(f"_hi_{name}"))
    out = ranked.groupBy(*by).agg(F.max("_rows").alias("n"), *picks)
    if kept:
        out = join_by(out, sketch.select(*by, *kept), by)
    if rank_form:
        return out.select(*by, "n", *names, *kept)
    interpolated = []
    for f, name in zip(fractions, names):
        position = (F.col("n") - 1) * F.lit(f)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        interpolated.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return out.select(*by, "n", *interpolated, *kept)


# -- from counts --------------------------------------------------------------

# Parts into which a range of values is cut, and rows of a range that are ranked one by one.
CUTS, RANKED = 1024, 50_000


def counted_quantiles(
    counts: DataFrame,
    value: str,
    weight: str,
    fractions: Sequence[float],
    by: Sequence[str] = (),
    names: Sequence[str] | None = None,
    ranked: int = RANKED,
    stored: bool = False,
) -> DataFrame:
    """``exact_quantiles`` of values that come ``weight`` times each: one row per key, interpolated, with the count ``n``.

    Counts per range of values say in which range each wanted rank lies, first by
    sign and magnitude, then in ever finer parts of that range, until it holds one
    value or few enough rows to be ranked. Every step is one aggregation over what
    is left; rows of one value may be many. Missing values and those that are not
    finite do not count, and a key without any other has no row. ``stored`` says that
    ``counts`` is read from a table and need not be written to be read repeatedly.
    """
    by = list(by)
    names = list(names or [f"q{round(f * 100)}" for f in fractions])
    rows = counts.select(*by, finite(F.col(value)).alias("_x"), F.col(weight).cast("long").alias("_w")).where(
        "_x is not null and _w > 0")
    if not stored:
        rows = written(rows)
    x, zone = F.col("_x"), ["_first", "_last", "_before"]
    # Subnormal numbers have logarithms of -1074 and more.
    magnitude = F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (F.floor(F.log2(F.abs(x)) * 8) + 10_000))
    size = [F.sum("_w").alias("_w"), F.min("_x").alias("_from"), F.max("_x").alias("_to"), F.count(F.lit(1)).alias("_rows")]
    parts = written(rows.groupBy(*by, magnitude.alias("_slot")).agg(*size).withColumn("_before", F.lit(0).cast("long")))

    n = F.col("n")
    places = F.array_distinct(F.array(*[g((n - 1) * F.lit(f)).cast("long") for f in fractions for g in (F.floor, F.ceil)]))
    totals = written(parts.groupBy(*by).agg(F.sum("_w").alias("n")))
    wanted = totals.select(*by, F.explode(places).alias("_rank"))

    def placed(parts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """The part that holds each wanted rank; ``parts`` of a key or zone are at most some thousands."""
        earlier = window_by(keys).orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
        upto = parts.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_w").over(earlier), F.lit(0)))
        here = (F.col("_start") <= F.col("_rank")) & (F.col("_rank") < F.col("_start") + F.col("_w"))
        return join_by(upto, wanted, keys).where(here).select(
            *by, "_rank", F.col("_from").alias("_first"), F.col("_to").alias("_last"), F.col("_start").alias("_before"), "_rows")

    found = written(placed(parts, wanted, by))
    exact = found.where("_first = _last").select(*by, "_rank", F.col("_first").alias("_at"))
    while True:
        open_ = found.where("_first < _last")
        most = open_.agg(F.max("_rows")).first()[0]
        if most is None:
            break
        inside = join_by(rows, open_.select(*by, *zone).distinct(), by).where("_x between _first and _last")
        if most <= ranked:
            order = window_by([*by, *zone]).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
            ends = inside.withColumn("_end", F.col("_before") + F.sum("_w").over(order))
            hit = join_by(ends, open_.select(*by, *zone, "_rank"), [*by, *zone]).where("_rank < _end and _rank >= _end - _w")
            exact = exact.unionByName(hit.select(*by, "_rank", F.col("_x").alias("_at")))
            break
        # Halves keep the difference of any two numbers finite.
        share = (x / 2 - F.col("_first") / 2) / (F.col("_last") / 2 - F.col("_first") / 2)
        slot = F.least(F.floor(share * CUTS), F.lit(CUTS - 1))
        parts = inside.groupBy(*by, *zone, slot.alias("_slot")).agg(*size)
        found = written(placed(parts, open_.select(*by, *zone, "_rank"), [*by, *zone]))
        exact = exact.unionByName(found.where("_first = _last").select(*by, "_rank", F.col("_first").alias("_at")))

    known = exact.groupBy(*by).agg(F.map_from_entries(F.collect_set(F.struct("_rank", "_at"))).alias("_at"))
    out = join_by(totals, known, by)
    picked = []
    for f, name in zip(fractions, names):
        position = (n - 1) * F.lit(f)
        low, high = (F.col("_at")[g(position).cast("long")] for g in (F.floor, F.ceil))
        picked.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return out.select(*by, "n", *picked)
