"""Links between tables: purpose, shared keys, relations and reconciliation."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.grouping import top_rows
from sumtrail.functions.values import half_up, ratio, strip, to_amount
from sumtrail.session import written


def table_purposes(roles: DataFrame) -> DataFrame:
    """Purpose of every dataset from its name, else from its roles."""
    found = roles.groupBy("dataset").agg(F.collect_set("role").alias("_roles"))

    def has(role: str) -> Column:
        return F.array_contains("_roles", role)

    by_roles = {
        "inventory": has("inventory"),
        "customers": has("customer") & ~has("revenue"),
        "products": has("product") & ~has("date"),
        "finance": has("cost") & ~has("revenue"),
        "sales": has("revenue") & has("date"),
    }
    purpose = F.lit("operations")
    for name, words in reversed(fixed.PURPOSE_WORDS):
        purpose = F.when(F.lower("dataset").rlike(words) | by_roles[name], name).otherwise(purpose)
    return found.select("dataset", purpose.alias("purpose"))


def primary_table(purposes: DataFrame, sizes: DataFrame) -> DataFrame:
    """The sales table, else the largest. ``sizes`` has (dataset, rows)."""
    joined = purposes.join(sizes, "dataset")
    order = [F.when(F.col("purpose") == "sales", 0).otherwise(1),
             F.when(F.col("purpose") == "sales", 0).otherwise(-F.col("rows")), F.col("dataset")]
    return top_rows(joined, [], order, 1).select("dataset", "purpose", "rows")


def _key(c: str) -> Column:
    return F.lower(strip(F.col(f"`{c}`").cast("string")))


def _plain_name(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isascii() and ch.isalnum())


def link_candidates(columns: Iterable[Row], order: Iterable[str]) -> list[dict]:
    """Column pairs worth comparing, from the column catalog alone.

    ``columns`` are catalog rows (dataset, position, column_name, role), read
    from a table with one row per column; values are not looked at. ``order``
    lists the datasets. One side must have a linking role, and the names or
    the roles have to agree, so only columns sharing a name or a role meet.
    """
    rank = {name: i for i, name in enumerate(order)}
    catalog = sorted(columns, key=lambda r: (rank[r.dataset], r.position))
    meeting = defaultdict(list)
    for i, c in enumerate(catalog):
        meeting["name", _plain_name(c.column_name)].append(i)
        if c.role in fixed.LINK_ROLES:
            meeting["role", c.role].append(i)
    agreed = defaultdict(set)
    for (what, _), places in meeting.items():
        for i, j in combinations(places, 2):
            if catalog[i].dataset != catalog[j].dataset:
                agreed[i, j].add(what)
    pairs = []
    for (i, j), reasons in sorted(agreed.items()):
        a, b = catalog[i], catalog[j]
        if {a.role, b.role} & set(fixed.LINK_ROLES):
            pairs.append(dict(
                pair=len(pairs), left_dataset=a.dataset, left_column=a.column_name,
                right_dataset=b.dataset, right_column=b.column_name, left_role=a.role,
                same_name="name" in reasons, same_role="role" in reasons,
            ))
    return pairs


#: Columns whose bits one number holds.
WORD = 62


def key_overlap(tables: dict[str, DataFrame], pairs: list[dict]) -> DataFrame:
    """Distinct and shared keys of every candidate pair, over the whole tables.

    A row sends each of its keys once, however many pairs the column is in.
    Grouping by key gives the set of columns that hold it, one bit each, so
    repeats collapse map-side, and keys with equal sets are counted together;
    pairs are only formed from those counts.
    """
    columns = sorted({(p[f"{s}_dataset"], p[f"{s}_column"]) for p in pairs for s in ("left", "right")})
    number = {c: i for i, c in enumerate(columns)}
    parts = []
    for name, df in tables.items():
        mine = [F.struct(F.lit(number[d, c]).alias("place"), _key(c).alias("key")) for d, c in columns if d == name]
        if mine:
            parts.append(df.select(F.inline(F.array(*mine))).where("key <> ''"))
    place, words = F.col("place"), [f"_word{w}" for w in range((len(columns) + WORD - 1) // WORD)]
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place % WORD)
    holders = reduce(DataFrame.unionByName, parts).groupBy("key").agg(*[
        F.bit_or(F.when(F.floor(place / WORD) == w, bit).otherwise(F.lit(0).cast("bigint"))).alias(word)
        for w, word in enumerate(words)])
    # One row per set of columns from here on.
    held = F.filter(F.array(*map(F.lit, range(len(columns)))),
                    lambda p: F.getbit(F.array(*words)[F.floor(p / WORD).cast("int")], p % WORD) == 1)
    sets = written(holders.groupBy(*words).agg(F.count(F.lit(1)).alias("n")).select(held.alias("places"), "n"))
    spark = sets.sparkSession
    wanted = spark.createDataFrame(
        [(p["pair"], number[p["left_dataset"], p["left_column"]], number[p["right_dataset"], p["right_column"]]) for p in pairs],
        "pair bigint, l int, r int")
    single = sets.select(F.explode("places").alias("place"), "n").groupBy("place").agg(F.sum("n").alias("n"))
    both = sets.select(F.explode("places").alias("l"), "places", "n").select("l", F.explode("places").alias("r"), "n").groupBy(
        "l", "r").agg(F.sum("n").alias("shared_keys"))
    counts = (
        wanted.join(single.select(F.col("place").alias("l"), F.col("n").alias("left_keys")), "l", "left")
        .join(single.select(F.col("place").alias("r"), F.col("n").alias("right_keys")), "r", "left")
        .join(both, ["l", "r"], "left").na.fill(0, ["left_keys", "right_keys", "shared_keys"])
        .where("left_keys > 0 or right_keys > 0").select("pair", "left_keys", "right_keys", "shared_keys")
    )
    smaller = F.least("left_keys", "right_keys")
    return counts.withColumn("overlap_pct", half_up(ratio(F.col("shared_keys"), smaller) * 100))


def relations(tables: dict[str, DataFrame], pairs: list[dict], k: int | None = None) -> DataFrame:
    """Relations per table pair, best first, with confidence and confirmation; with ``k`` the best ``k``."""
    spark = next(iter(tables.values())).sparkSession
    schema = ("pair bigint, left_dataset string, left_column string, right_dataset string, "
              "right_column string, left_role string, same_name boolean, same_role boolean")
    if not pairs:
        pairs_df = spark.createDataFrame([], schema)
        overlap = spark.createDataFrame([], "pair bigint, overlap_pct double")
    else:
        pairs_df = spark.createDataFrame([tuple(p.values()) for p in pairs], schema)
        overlap = key_overlap(tables, pairs).select("pair", "overlap_pct")
    joined = pairs_df.join(overlap, "pair", "left").na.fill(0.0, ["overlap_pct"])
    confidence = F.least(
        F.lit(fixed.LINK_CAP),
        F.when(F.col("same_name"), fixed.LINK_SAME_NAME).otherwise(0.0)
        + F.when(F.col("same_role"), fixed.LINK_SAME_ROLE).otherwise(0.0)
        + F.col("overlap_pct") / 100 * fixed.LINK_OVERLAP,
    )
    kept = joined.withColumn("_confidence", confidence).where(F.col("_confidence") >= fixed.LINK_FLOOR)
    best = top_rows(kept, ["left_dataset", "right_dataset"],
                    [F.desc(half_up(F.col("_confidence"), 2)), F.col("pair")], k)
    kind = F.when(F.col("left_role") == "date", "period_alignment").otherwise("shared_key")
    return best.select(
        "pair", "left_dataset", "left_column", "right_dataset", "right_column",
        kind.alias("kind"), half_up(F.col("_confidence"), 2).alias("confidence"), "overlap_pct",
        (F.col("_confidence") >= fixed.LINK_CONFIRMED).alias("confirmed"),
    )


def total_amount(df: DataFrame, column: str, name: str = "total") -> DataFrame:
    """Sum of the readable amounts of one column; unreadable cells count 0."""
    return df.agg(F.coalesce(F.sum(to_amount(F.col(f"`{column}`").cast("string"))), F.lit(0.0)).alias(name))


def _amount_per_key(df: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    sums = F.sum(to_amount(F.col(f"`{amount}`").cast("string")))
    return df.groupBy(_key(key).alias("key")).agg(sums.alias(name)).where("key <> ''")


def stock_coverage(sales: DataFrame, sales_key: str, demand: str,
                   inventory: DataFrame, inventory_key: str, stock: str) -> DataFrame:
    """Demand and stock of every key both tables have.

    Both sides are summed per key before the join, so each key is one row on
    either side and no key can flood a join task.
    """
    joined = _amount_per_key(sales, sales_key, demand, "demand").join(
        _amount_per_key(inventory, inventory_key, stock, "stock"), "key"
    )
    return joined.withColumn("under_stocked", F.col("stock") < F.col("demand"))


def coverage_summary(coverage: DataFrame) -> DataFrame:
    totals = coverage.agg(
        F.count(F.lit(1)).alias("matched_keys"), F.count_if("under_stocked").alias("under_stocked"),
        F.sum("demand").alias("_demand"), F.sum("stock").alias("_stock"),
    )
    exposed = F.col("under_stocked") / F.col("matched_keys")
    return totals.select(
        "matched_keys", "under_stocked",
        F.when(F.col("_demand") > 0, half_up(F.col("_stock") / F.col("_demand") * 100, 4)).otherwise(0.0).alias("coverage_pct"),
        F.when(F.col("matched_keys") == 0, F.lit(None)).when(F.col("under_stocked") == 0, "opportunity")
        .when(exposed >= 0.25, "high").otherwise("medium").alias("priority"),
    )


def linkage_review(overlap_pct: Column) -> Column:
    """Priority of a weak customer link; NULL when the link is good enough."""
    return F.when(overlap_pct < 50, "high").when(overlap_pct < 80, "medium")


def unmatched_keys(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have."""
    mine = left.select(_key(left_key).alias("key")).where("key <> ''").distinct()
    theirs = right.select(_key(right_key).alias("key")).where("key <> ''").distinct()
    return mine.join(theirs, "key", "left_anti")


def contribution(sales: DataFrame, revenue: str, finance: DataFrame, cost: str) -> DataFrame:
    """Revenue less the costs of another table, in percent of revenue."""
    both = total_amount(sales, revenue, "revenue").crossJoin(F.broadcast(total_amount(finance, cost, "cost")))
    share = (F.col("revenue") - F.col("cost")) / F.col("revenue") * 100
    return both.where("revenue > 0").select(
        half_up(F.col("revenue"), 2).alias("revenue"), half_up(F.col("cost"), 2).alias("cost"),
        half_up(share, 4).alias("contribution_pct"),
    )


def confirmed_only(metrics: DataFrame, relation_table: DataFrame) -> DataFrame:
    """Metrics without a relation, and those whose relation is confirmed."""
    confirmed = relation_table.where("confirmed").select("pair")
    free = metrics.where("pair IS NULL")
    return free.unionByName(metrics.join(confirmed, "pair", "left_semi"))
