"""One query per operator, over the whole of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.views import dirty_events, sales, scratch_folder, table, workspace_tables
from sumtrail.functions import values as vl
from sumtrail.operators import actions as ac
from sumtrail.operators import breakdown as bd
from sumtrail.operators import clean as cl
from sumtrail.operators import features as ft
from sumtrail.operators import gates as gt
from sumtrail.operators import linkage as lk
from sumtrail.operators import models as md
from sumtrail.operators import planning as pn
from sumtrail.operators import profile as pf
from sumtrail.operators import quality as ql
from sumtrail.operators import retail as rt
from sumtrail.operators import roles as rl
from sumtrail.operators import scorecard as sc
from sumtrail.operators import segments as sg
from sumtrail.operators import series as sr
from sumtrail.operators import stats as st
from sumtrail.plans import workspace as ws
from sumtrail.session import written
from sumtrail.sources import readers, sinks
from sumtrail.streaming import live

QUERIES = {}
REGION = ["region"]
PRODUCT = ["product"]


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: vl.half_up(F.col(c), digits) for c in columns})


# --- sources and sinks -------------------------------------------------------

@query
def csv_round_trip(spark, sf):
    """Orders written fully quoted and read back as text."""
    path = scratch_folder(spark) + "/orders.csv"
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("o_totalprice"), "o_orderpriority",
    )
    sinks.write_csv(orders, path)
    return readers.read_csv(spark, path, quoted_newlines=False)


@query
def tsv_scan(spark, sf):
    path = scratch_folder(spark) + "/customer.tsv"
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option(
        "header", True).option("sep", "\t").csv(path)
    return readers.read_tsv(spark, path)


@query
def json_scan(spark, sf):
    """Events as JSON Lines; the nested object comes back as JSON text."""
    path = scratch_folder(spark) + "/events.json"
    table(spark, sf, "events").select(
        "event_id", "event_type", F.from_json("props", "k int").alias("props")).write.json(path)
    return readers.read_json(spark, path, lines=True)


@query
def csv_line_breaks(spark, sf):
    """Documents as quoted cells that hold line breaks and quotes, written and read back by many tasks."""
    path = scratch_folder(spark) + "/documents.csv"
    docs = table(spark, sf, "documents")
    sinks.write_csv(docs.select("doc_id", "text", F.concat(F.lit('say "'), "source", F.lit('"')).alias("source")), path)
    return readers.read_csv(spark, path)


@query
def csv_ragged(spark, sf):
    """Customers of which some have a cell too few or too many; those come with their whole text."""
    path = scratch_folder(spark) + "/ragged.csv"
    cells = F.concat_ws(",", F.col("c_custkey"), "c_mktsegment", F.when(F.col("c_custkey") % 3 > 0, F.col("c_nationkey")), F.when(F.col("c_custkey") % 5 == 0, F.lit("more")))
    (table(spark, sf, "customer").select(cells.alias("key,segment,nation")).write.option("header", True)
     .option("quote", "").option("sep", "\x01").csv(path))
    return readers.read_csv(spark, path, sep=",", ragged="raw")


@query
def json_array_scan(spark, sf):
    """Orders as objects with an array of records, one file for some thousand orders."""
    path = scratch_folder(spark) + "/orders-array.json"
    record = F.struct("o_orderkey", "o_orderstatus", F.struct(F.col("o_custkey").alias("key")).alias("customer"))
    orders = table(spark, sf, "orders").groupBy(F.expr("o_orderkey div 8000").alias("file")).agg(F.collect_list(record).alias("records"))
    orders.select("file", F.to_json(F.struct(F.struct(F.lit("}").alias("note")).alias("meta"), "records"))).write.partitionBy("file").text(path)
    return readers.read_json(spark, path, split=True)


@query
def latest_runs(spark, sf):
    """The newest three orders of every customer."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("dataset"), "o_orderkey",
        F.struct("o_orderdate", "o_orderkey").alias("created_at"))
    return sinks.latest_runs(orders, 3).select("dataset", "position", "o_orderkey")


# --- values ------------------------------------------------------------------

@query
def coerced_values(spark, sf):
    r = dirty_events(spark, sf)
    return r.select(
        "event", vl.to_number(F.col("value")).alias("number"),
        vl.is_missing(F.col("event_type")).alias("type_missing"),
        vl.is_missing(F.col("value")).alias("value_missing"),
        vl.looks_like_date(F.col("ts")).alias("is_date"), vl.to_day(F.col("ts")).alias("day"),
        vl.looks_like_boolean(F.col("event_type")).alias("is_boolean"),
    )


@query
def lenient_amounts(spark, sf):
    r = dirty_events(spark, sf)
    return r.groupBy("user_id").agg(
        vl.half_up(F.sum(vl.to_amount(F.col("value"))), 2).alias("amount"),
        vl.half_up(F.sum(vl.price_of(F.col("value"))), 2).alias("price"),
        vl.half_up(F.sum(vl.quantity_of(F.col("value"))), 2).alias("quantity"),
    )


@query
def half_up_rounding(spark, sf):
    v = F.col("s_acctbal")
    return table(spark, sf, "supplier").select(
        "s_suppkey", vl.half_up(v).alias("whole"), vl.half_up(-v / 2, 1).alias("one_digit"),
        vl.half_up(F.floor(v) * -0.5).alias("halves"),
    )


# --- profiling ---------------------------------------------------------------

@query
def inferred_types(spark, sf):
    return pf.infer_types(dirty_events(spark, sf), "events").drop("dataset")


def _profile_output(profile: DataFrame) -> DataFrame:
    plain = profile.withColumn("samples", F.array_join("samples", "|"))
    return rounded(plain, 4, "mean", "median", "sd")


@query
def profile_columns(spark, sf):
    return _profile_output(pf.profile_columns(dirty_events(spark, sf), "events"))


@query
def profile_catalog(spark, sf):
    return _profile_output(pf.profile_tables(workspace_tables(spark, sf)))


@query
def distinct_by_hash(spark, sf):
    """Kinds of line items: rows go by hash, only repeated ones are shuffled whole."""
    items = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_quantity").cast("int").alias("l_quantity"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("l_shipdate"))
    return cl.deduplicated(items, by_hash=True)


@query
def duplicate_rows(spark, sf):
    return pf.duplicate_rows(dirty_events(spark, sf), "events")


@query
def duplicate_documents(spark, sf):
    return pf.duplicate_rows(table(spark, sf, "documents").select("text"), "documents")


# --- cleaning ----------------------------------------------------------------

@query
def clean_rows(spark, sf):
    """Cleaned text; the filled mean is compared as a rounded number."""
    rows = cl.clean(dirty_events(spark, sf)).rows
    return rows.withColumn("value", vl.half_up(F.col("value").cast("double"), 4))


@query
def cleaning_log(spark, sf):
    return cl.clean(dirty_events(spark, sf)).log.drop("step")


@query
def fill_values(spark, sf):
    r = dirty_events(spark, sf)
    profile = pf.profile_columns(r).collect()
    types = {p.column_name: p.inferred_type for p in profile}
    rows = cl.normalised(cl.deduplicated(r), types)
    values = cl.fills(rows, cl.fillable_columns(profile))
    number = vl.half_up(F.col("fill").try_cast("double"), 4)
    return values.select("column_name", "method", F.when(number.isNull(), F.col("fill")).alias("label"),
                         number.alias("number"))


@query
def fill_values_by_type(spark, sf):
    """A fill of its own for every event type."""
    r = dirty_events(spark, sf)
    rows = cl.normalised(cl.deduplicated(r), {"value": "number"})
    values = cl.fills(rows, {"value": "number", "event_type": "string"}, ["event_type"])
    return values.select("event_type", "method", vl.half_up(F.col("fill").try_cast("double"), 4).alias("number"))


@query
def gaps_filled_by_type(spark, sf):
    """Values before and after filling by type; a type without values keeps its gaps."""
    rows = cl.normalised(cl.deduplicated(dirty_events(spark, sf)), {"value": "number"})
    values = cl.fills(rows, {"value": "number"}, ["event_type"])
    done = cl.filled(rows, values, ["value"], ["event_type"])
    return done.groupBy("event_type").agg(
        F.count("value").alias("n"), vl.half_up(vl.total(F.col("value").try_cast("double")), 2).alias("total"))


@query
def typed_rejects(spark, sf):
    return cl.rejects(dirty_events(spark, sf), {"value": "number", "ts": "date", "event_type": "number"})


# --- quality -----------------------------------------------------------------

def _event_roles(spark):
    return spark.createDataFrame(
        [("events", "event", "identifier"), ("events", "ts", "date"), ("events", "user_id", "customer"),
         ("events", "event_type", "category"), ("events", "value", "revenue")],
        "dataset string, column_name string, role string")


def _event_quality(spark, sf):
    r = dirty_events(spark, sf)
    columns = ql.column_quality(pf.profile_columns(r, "events"), _event_roles(spark))
    return columns, pf.duplicate_rows(r, "events")


@query
def quality_columns(spark, sf):
    return _event_quality(spark, sf)[0].drop("position")


@query
def quality_dataset(spark, sf):
    return ql.dataset_quality(*_event_quality(spark, sf))


@query
def quality_flags(spark, sf):
    return ql.quality_flags(*_event_quality(spark, sf))


@query
def quality_flags_by_nation(spark, sf):
    """Every limit breached by some nation: shares of its customers stand for the scores of a column."""
    share = lambda flag: F.avg(F.when(flag, 100.0).otherwise(0.0))
    balance, key = F.col("c_acctbal"), F.col("c_custkey")
    columns = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(
        share(balance > 2000).alias("completeness"), share(balance > 800).alias("validity"), share(key % 37 > 0).alias("uniqueness"),
        F.count("*").alias("rows"), F.count_if(key % 50 == 0).alias("duplicates"),
    ).select(
        F.concat(F.lit("nation "), "nation").alias("dataset"), F.lit("balance").alias("column_name"), "completeness", "validity", "uniqueness",
        F.when(F.col("nation") % 2 == 0, "number").otherwise("string").alias("inferred_type"),
        F.when(F.col("nation") % 3 == 0, "identifier").otherwise("amount").alias("role"), "rows", "duplicates")
    return ql.quality_flags(columns, columns)


# --- roles and gates ---------------------------------------------------------

def _catalog(spark, sf):
    """Profile of all tables, one row per column, written once."""
    return written(pf.profile_tables(workspace_tables(spark, sf)))


def _roles(spark, sf):
    return written(rl.classify_columns(_catalog(spark, sf), OVERRIDES))


@query
def role_scores(spark, sf):
    scores = rl.role_scores(_catalog(spark, sf))
    return rounded(scores, 4, "score").select(
        "dataset", "column_name", "role", "score",
        F.array_join(F.transform("evidence", lambda e: e["source"]), ",").alias("evidence"))


OVERRIDES = {("products", "brand"): "category"}


@query
def column_roles(spark, sf):
    return _roles(spark, sf).drop("position", "evidence", "rows", "months")


@query
def mapping_warnings(spark, sf):
    return rl.mapping_warnings(_roles(spark, sf))


@query
def best_columns(spark, sf):
    return rl.best_columns(_roles(spark, sf))


@query
def primary_measures(spark, sf):
    return rl.primary_measures(_roles(spark, sf))


@query
def analysis_gates(spark, sf):
    return gt.gates(_roles(spark, sf))


@query
def analysis_ranking(spark, sf):
    found = gt.gates(_roles(spark, sf))
    candidates = found.where("available").withColumn(
        "coefficient", F.when(F.col("capability") == "correlation", 0.5))
    return bd.rank_analyses(candidates)


# --- features and statistics -------------------------------------------------

@query
def calendar_parts(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ft.calendar_parts(orders, "o_orderdate").drop("o_orderdate")


@query
def transaction_value(spark, sf):
    lines = ft.transaction_value(sales(spark, sf, "order_id", "price", "units"), "price", "units")
    return lines.groupBy("order_id").agg(vl.half_up(F.sum("transaction_value"), 2).alias("value"),
                                         F.count(F.lit(1)).alias("n"))


@query
def margins(spark, sf):
    lines = ft.margin(sales(spark, sf, "order_id", "revenue", "cost"), "revenue", "cost")
    return lines.groupBy("order_id").agg(
        vl.half_up(F.sum("margin"), 2).alias("margin"), vl.half_up(F.min("margin_pct"), 1).alias("lowest_pct"),
        vl.half_up(F.max("margin_pct"), 1).alias("highest_pct"))


def _band_counts(df, by=()):
    return df.groupBy(*by, "band").agg(
        F.count(F.lit(1)).alias("n"), F.min("revenue").alias("low"), F.max("revenue").alias("high"))


@query
def value_bands(spark, sf):
    return _band_counts(ft.value_bands(sales(spark, sf, "revenue"), "revenue"))


@query
def value_bands_by_region(spark, sf):
    return _band_counts(ft.value_bands(sales(spark, sf, "region", "revenue"), "revenue", REGION), REGION)


@query
def numeric_summary(spark, sf):
    f = sales(spark, sf, "revenue", "cost", "units")
    return rounded(st.numeric_summary(f, ["revenue", "cost", "units"]), 0, "variance")


@query
def numeric_summary_by_region(spark, sf):
    f = sales(spark, sf, "region", "revenue", "units")
    return rounded(st.numeric_summary(f, ["revenue", "units"], REGION), 0, "variance")


@query
def outlier_examples(spark, sf):
    f = ft.margin(sales(spark, sf, "product", "revenue", "cost"), "revenue", "cost")
    return st.outlier_examples(f, "margin_pct", PRODUCT)


@query
def category_frequencies(spark, sf):
    return st.category_frequencies(sales(spark, sf, "brand", "region", "status"), ["brand", "region", "status"])


@query
def correlations(spark, sf):
    f = ft.margin(sales(spark, sf, "revenue", "cost", "units", "price"), "revenue", "cost")
    return st.correlations(f, ["revenue", "cost", "units", "price", "margin"]).drop("pair")


@query
def correlations_by_region(spark, sf):
    f = sales(spark, sf, "region", "revenue", "cost", "units")
    return st.correlations(f, ["revenue", "cost", "units"], REGION).drop("pair")


def _series(spark, sf, by=()):
    return st.monthly_series(sales(spark, sf, *by, "order_date", "revenue"), "order_date", "revenue", by)


@query
def monthly_series(spark, sf):
    return _series(spark, sf)


@query
def monthly_series_by_region(spark, sf):
    return _series(spark, sf, REGION)


@query
def monthly_series_without_gaps(spark, sf):
    """Thousands of sparse series, one per customer."""
    f = sales(spark, sf, "customer_id", "order_date", "revenue")
    return st.monthly_series(f, "order_date", "revenue", ["customer_id"], fill_gaps=True)


@query
def numeric_summary_blank_as_zero(spark, sf):
    """Open orders count 0."""
    orders = table(spark, sf, "orders").select(
        "o_orderpriority", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")).alias("closed"))
    return st.numeric_summary(orders, ["closed"], ["o_orderpriority"], blank_as_zero=True).select(
        "o_orderpriority", "n", "mean", "median", "q3", "min", "max", "outliers")


@query
def weekday_totals(spark, sf):
    events = table(spark, sf, "events")
    return st.weekday_totals(events, "ts", "value", ["event_type"])


@query
def month_totals(spark, sf):
    return st.month_totals(sales(spark, sf, "region", "order_date", "revenue"), "order_date", "revenue", REGION)


@query
def month_totals_one_month(spark, sf):
    """Eleven of the twelve months have no event and still get a row."""
    return st.month_totals(table(spark, sf, "events"), "ts", "value")


# --- breakdowns --------------------------------------------------------------

@query
def breakdown(spark, sf):
    return bd.breakdown(sales(spark, sf, "brand", "revenue"), "brand", "revenue")


@query
def breakdown_by_region(spark, sf):
    return bd.breakdown(sales(spark, sf, "region", "product", "revenue"), "product", "revenue", REGION)


@query
def top_categories(spark, sf):
    return bd.top_categories(sales(spark, sf, "brand", "revenue"), "brand", "revenue")


@query
def top_customers_by_region(spark, sf):
    f = sales(spark, sf, "region", "customer_id", "revenue")
    return bd.top_categories(f, "customer_id", "revenue", REGION)


@query
def histogram(spark, sf):
    return bd.histogram(sales(spark, sf, "revenue"), "revenue")


@query
def histogram_by_product(spark, sf):
    return bd.histogram(sales(spark, sf, "product", "units"), "units", PRODUCT)


@query
def concentration(spark, sf):
    return bd.concentration(sales(spark, sf, "brand", "revenue"), "brand", "revenue")


@query
def concentration_by_region(spark, sf):
    f = sales(spark, sf, "region", "customer_id", "revenue")
    return bd.concentration(f, "customer_id", "revenue", REGION)


@query
def strongest_pair(spark, sf):
    f = sales(spark, sf, "revenue", "cost", "units")
    return bd.strongest_pair(st.correlations(f, ["revenue", "cost", "units"]))


@query
def pair_points(spark, sf):
    f = sales(spark, sf, "order_date", "order_id", "revenue", "units")
    key = F.md5(F.concat_ws("|", "order_id", F.col("units").cast("bigint"), F.col("revenue").cast("decimal(18,2)")))
    return bd.pair_points(f, "revenue", "units", [key], k=300)


@query
def history_and_forecast(spark, sf):
    series = written(_series(spark, sf))
    return bd.history_and_forecast(series, sr.linear_forecast(series))


@query
def flagged_periods(spark, sf):
    return bd.flagged_periods(sr.anomalies(_series(spark, sf, PRODUCT), PRODUCT))


@query
def recent_periods(spark, sf):
    return bd.recent_periods(_series(spark, sf, REGION), REGION)


@query
def same_month_across_years(spark, sf):
    return bd.same_month_across_years(_series(spark, sf, REGION), 3, REGION)


# --- series models -----------------------------------------------------------

@query
def forecast_linear(spark, sf):
    return sr.linear_forecast(_series(spark, sf, REGION), REGION)


@query
def forecast_scenarios(spark, sf):
    return sr.linear_forecast(_series(spark, sf), (), ["base", "optimistic", "conservative"])


@query
def forecast_outlook(spark, sf):
    return sr.forecast_outlook(_series(spark, sf, PRODUCT), PRODUCT)


@query
def moving_average(spark, sf):
    return sr.moving_average_forecast(_series(spark, sf, REGION), REGION)


@query
def forecast_model(spark, sf):
    return sr.choose_forecast_model(_series(spark, sf, REGION), REGION)


def _customer_series(spark, sf):
    return _series(spark, sf, ["customer_id"])


@query
def forecast_per_customer(spark, sf):
    """Thousands of short and long series, each with the model it selects."""
    return sr.forecast(_customer_series(spark, sf), ["customer_id"])


@query
def anomalies(spark, sf):
    return sr.anomalies(_series(spark, sf, REGION), REGION)


@query
def anomaly_model(spark, sf):
    return sr.choose_anomaly_model(_customer_series(spark, sf), ["customer_id"])


@query
def forecast_executed(spark, sf):
    """The model that the rules choose is the model that runs."""
    return md.executed_forecast(_series(spark, sf, REGION), REGION)


@query
def forecast_executed_per_customer(spark, sf):
    return md.executed_forecast(_customer_series(spark, sf), ["customer_id"], scenario="optimistic")


@query
def forecast_seasonal(spark, sf):
    return md.executed_forecast(_series(spark, sf, PRODUCT), PRODUCT, model="moving_seasonal", horizon=12)


@query
def forecast_tested(spark, sf):
    """Each region by the model with the smallest error over its last six months."""
    return md.executed_forecast(_series(spark, sf, REGION), REGION, model="tested")


@query
def tested_models(spark, sf):
    return md.tested_models(_series(spark, sf, PRODUCT), PRODUCT)


@query
def anomalies_executed(spark, sf):
    """Long and even series: the z-score is chosen."""
    return md.executed_anomalies(_series(spark, sf, REGION), REGION)


@query
def anomalies_executed_per_customer(spark, sf):
    """Short and wild series: quartiles are chosen."""
    return md.executed_anomalies(_customer_series(spark, sf), ["customer_id"])


@query
def anomalies_by_quartiles(spark, sf):
    return md.executed_anomalies(_series(spark, sf, REGION), REGION, "iqr")


@query
def anomalies_seasonal(spark, sf):
    return md.executed_anomalies(_series(spark, sf, REGION), REGION, "seasonal_residual")


# --- segments ----------------------------------------------------------------

def _customers(spark, sf, by=()):
    f = sales(spark, sf, *by, "customer_id", "order_date", "revenue")
    return sg.customer_rollup(f, "customer_id", "order_date", "revenue", by)


@query
def customer_rollup(spark, sf):
    return _customers(spark, sf).drop("newest_month")


@query
def tercile_cuts(spark, sf):
    return sg.tercile_cuts(_customers(spark, sf, REGION), REGION)


@query
def customer_segments(spark, sf):
    return sg.customer_segments(_customers(spark, sf)).drop("spend")


@query
def customer_segments_by_region(spark, sf):
    return sg.customer_segments(_customers(spark, sf, REGION), REGION).drop("spend")


@query
def segment_sizes(spark, sf):
    return bd.segment_sizes(sg.customer_segments(_customers(spark, sf, REGION), REGION), REGION)


@query
def churn_exposure(spark, sf):
    segments = sg.customer_segments(_customers(spark, sf, REGION), REGION)
    return sg.churn_exposure(segments, _series(spark, sf, REGION), REGION)


# --- retail ------------------------------------------------------------------

def _lines(spark, sf, *columns):
    f = sales(spark, sf, *columns, "price", "units")
    return rt.line_revenue(f, "price", "units")


@query
def retail_columns(spark, sf):
    """Columns are found in the catalog of all tables, one row per column."""
    profile = _catalog(spark, sf)
    return rt.find_columns(profile.select("dataset", "position", "column_name"))


@query
def sales_totals(spark, sf):
    return rt.sales_totals(_lines(spark, sf, "region"), REGION)


@query
def order_value_buckets(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("value", "total")
    return rt.order_value_buckets(rt.line_revenue(events, "total"), ["event_type"])


def _spenders(spark, sf, by=()):
    lines = _lines(spark, sf, *by, "customer_id", "order_date")
    return rt.customer_spend(lines, "customer_id", "order_date", by)


@query
def customer_spend(spark, sf):
    return _spenders(spark, sf)


@query
def lifetime_value_buckets(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("value", "total")
    return rt.lifetime_value_buckets(rt.customer_spend(rt.line_revenue(events, "total"), "user_id", "ts"))


@query
def new_customers_per_month(spark, sf):
    return rt.new_customers_per_month(_spenders(spark, sf, REGION), REGION)


@query
def customer_counts(spark, sf):
    return rt.customer_counts(_spenders(spark, sf, REGION), REGION)


@query
def fill_rates(spark, sf):
    r = dirty_events(spark, sf)
    return rt.fill_rates(cl.standardised(r))


@query
def retail_growth(spark, sf):
    return rt.growth(_series(spark, sf, REGION), REGION)


@query
def forecast_total(spark, sf):
    return rt.forecast_total(_series(spark, sf, REGION), REGION)


@query
def shortfall_at_risk(spark, sf):
    series = written(_series(spark, sf, REGION))
    segments = sg.customer_segments(_customers(spark, sf, REGION), REGION)
    return rt.shortfall_at_risk(series, sg.churn_exposure(segments, series, REGION), REGION)


@query
def retail_health(spark, sf):
    f = sales(spark, sf, "region", "customer_id", "order_date", "revenue")
    series = st.monthly_series(f, "order_date", "revenue", REGION)
    quality = rt.fill_score(rt.fill_rates(f, by=REGION), REGION)
    spenders = rt.customer_spend(f.withColumnRenamed("revenue", "line_revenue"), "customer_id", "order_date", REGION)
    return rt.retail_health(series, spenders, quality, REGION)


@query
def dependency_risk(spark, sf):
    """Product dependency of every customer."""
    lines = _lines(spark, sf, "customer_id", "product")
    return rt.dependency_risk(lines, "product", ["customer_id"])


@query
def small_base_actions(spark, sf):
    events = table(spark, sf, "events").withColumnRenamed("value", "total")
    lines = rt.line_revenue(events, "total")
    customers = rt.customer_spend(lines, "user_id", "ts", ["event_type"])
    return rt.small_base_actions(lines, customers, ["event_type"])


# --- scorecards and actions --------------------------------------------------

QUALITY_SCORE = 84


def _facts(spark, sf, by=("region",)):
    """Facts of every region, written once since most queries use them twice."""
    f = sales(spark, sf, *by, "customer_id", "order_date", "product", "revenue")
    quality = spark.range(1).select(F.lit(QUALITY_SCORE).cast("bigint").alias("quality_score"))
    return written(sc.entity_facts(f, list(by), "order_date", "revenue", "customer_id", "product", quality))


@query
def entity_facts(spark, sf):
    facts = _facts(spark, sf)
    return rounded(facts, 2, "total", "mean", "sd", "top_share").drop("mean", "sd")


@query
def health_by_region(spark, sf):
    health = sc.health_scores(_facts(spark, sf), REGION)
    return health.withColumns({
        "health_band": sc.health_band(F.col("total")),
        "quality_card": sc.quality_band(F.lit(QUALITY_SCORE)),
        "quality_overview": sc.quality_band(F.lit(QUALITY_SCORE), strict=False),
    })


@query
def risks_by_region(spark, sf):
    return sc.risks(_facts(spark, sf), REGION)


@query
def actions_by_region(spark, sf):
    return ac.ranked_actions(_facts(spark, sf), REGION, {"category": 90, "measure": 95})


@query
def action_totals(spark, sf):
    return ac.action_totals(ac.ranked_actions(_facts(spark, sf), REGION), REGION)


@query
def alerts_by_region(spark, sf):
    facts = _facts(spark, sf)
    return pn.alerts(
        sc.health_scores(facts, REGION), facts.select("region", "quality_score"), sc.risks(facts, REGION), REGION,
        {"health": 99, "quality": 90})


@query
def targets_by_region(spark, sf):
    facts = _facts(spark, sf)
    health = sc.health_scores(facts, REGION)
    metrics = health.join(facts.select("region", "quality_score", "confidence"), "region").select(
        "region", F.col("total").alias("health"), F.col("quality_score").alias("quality"), "trend",
        vl.half_up(F.col("confidence") * 100).alias("confidence"))
    return pn.target_attainment(metrics, REGION, {"trend": 12})


@query
def target_summary(spark, sf):
    return pn.target_summary(targets_by_region(spark, sf), REGION)


@query
def scenario_grid(spark, sf):
    f = sales(spark, sf, "region", "revenue", "cost")
    return pn.scenario_grid(f, "revenue", REGION, "cost", (-10, 0, 10), (0, 20), (0, 5), (0, 15))


@query
def scenario_default_cost(spark, sf):
    return pn.scenario_grid(sales(spark, sf, "product", "revenue"), "revenue", PRODUCT, None, (5,), (10,), (0,), (10,))


@query
def outcome_totals(spark, sf):
    """Orders as decisions: expected value, recorded text, validated status."""
    orders = table(spark, sf, "orders").select(
        "o_orderpriority", F.col("o_totalprice").alias("expected"),
        F.when(F.col("o_orderstatus") == "P", "n/a")
        .otherwise(F.concat(F.lit("£"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("actual"),
        F.when(F.col("o_orderstatus") == "F", "validated").otherwise("not_started").alias("status"))
    return pn.outcome_totals(orders, ["o_orderpriority"])


@query
def latest_events(spark, sf):
    events = table(spark, sf, "events")
    return pn.latest_events(events, "user_id", 7, "ts", "event_id").select("event_id", "event_type", "value")


@query
def latest_events_of_type(spark, sf):
    """The newest forty purchases by all users of one group: the type decides before the limit does."""
    events = table(spark, sf, "events").withColumn("tenant", F.col("user_id") % 2)
    return pn.latest_events(events, "tenant", 1, "ts", "event_id", "event_type", "purchase", k=40).select(
        "event_id", "user_id", "value")


@query
def all_events_of_type(spark, sf):
    events = table(spark, sf, "events")
    return pn.latest_events(events, "user_id", 7, "ts", "event_id", "event_type", "purchase", k=None).select("event_id", "value")


@query
def event_types(spark, sf):
    return pn.event_types(table(spark, sf, "events"), "user_id", 7, "event_type")


# --- linkage -----------------------------------------------------------------

def _roles_and_tables(spark, sf):
    tables = workspace_tables(spark, sf)
    return written(rl.classify_columns(written(pf.profile_tables(tables)))), tables


@query
def table_purposes(spark, sf):
    return lk.table_purposes(_roles_and_tables(spark, sf)[0])


@query
def primary_table(spark, sf):
    roles = written(rl.classify_columns(_catalog(spark, sf)))
    sizes = roles.groupBy("dataset").agg(F.max("rows").alias("rows"))
    return lk.primary_table(lk.table_purposes(roles), sizes)


@query
def key_overlap(spark, sf):
    roles, tables = _roles_and_tables(spark, sf)
    pairs = lk.link_candidates(roles.drop("evidence").collect(), tables)
    names = spark.createDataFrame(
        [(p["pair"], p["left_dataset"], p["left_column"], p["right_dataset"], p["right_column"]) for p in pairs],
        "pair bigint, left_dataset string, left_column string, right_dataset string, right_column string")
    return lk.key_overlap(tables, pairs).join(names, "pair").drop("pair")


@query
def relations(spark, sf):
    roles, tables = _roles_and_tables(spark, sf)
    pairs = lk.link_candidates(roles.drop("evidence").collect(), tables)
    return lk.relations(tables, pairs).drop("pair")


@query
def stock_coverage(spark, sf):
    t = workspace_tables(spark, sf)
    return lk.stock_coverage(t["sales"], "part_id", "quantity", t["inventory"], "part_id", "inventory")


@query
def coverage_summary(spark, sf):
    return lk.coverage_summary(stock_coverage(spark, sf))


@query
def unmatched_keys(spark, sf):
    """Customers without any order line."""
    t = workspace_tables(spark, sf)
    return lk.unmatched_keys(t["customers"], "customer_id", t["sales"], "customer_id")


@query
def unmatched_recent_keys(spark, sf):
    """Customers without an order line in the last month that has any."""
    t = workspace_tables(spark, sf)
    newest = t["sales"].agg(F.max(F.substring("order_date", 1, 7)).alias("newest"))
    recent = t["sales"].join(F.broadcast(newest), F.col("order_date").startswith(F.col("newest")))
    return lk.unmatched_keys(t["customers"], "customer_id", recent, "customer_id")


@query
def contribution(spark, sf):
    t = workspace_tables(spark, sf)
    return lk.contribution(t["sales"], "revenue", t["expenses"], "cost")


@query
def connected_metrics(spark, sf):
    return ws.prepare_workspace(workspace_tables(spark, sf))["confirmed_metrics"].select(
        "metric", vl.half_up(F.col("value"), 2).alias("value"))


@query
def connected_insights(spark, sf):
    return ws.prepare_workspace(workspace_tables(spark, sf))["insights"].drop("pair")


# --- streaming ---------------------------------------------------------------

def _event_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query
def live_revenue(spark, sf):
    """Latest state of every day after all events have arrived."""
    totals = live.live_revenue(_event_stream(spark, sf), "ts", "value")
    return rounded(_latest_state(spark, totals, "day", ["revenue", "orders"]), 2, "revenue")


def _latest_state(spark, totals, key, values):
    base = scratch_folder(spark)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(f"{base}/rows")

    live.run_upserts(totals, write, f"{base}/state").awaitTermination()
    newest = F.max_by(F.struct(*values), "batch").alias("s")
    return spark.read.parquet(f"{base}/rows").groupBy(key).agg(newest).select(key, "s.*")


@query
def live_customers(spark, sf):
    """Latest state of every user after all events have arrived."""
    totals = live.live_customers(_event_stream(spark, sf), "user_id", "ts", "value")
    return rounded(_latest_state(spark, totals, "customer", ["spend", "orders", "first_day"]), 2, "spend")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalous months of every region: fact join, monthly series, z-scores."""
    return anomalies(spark, sf_dir)
