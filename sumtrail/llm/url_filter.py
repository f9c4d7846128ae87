"""URL filter: rules on host and path, then a weighted vocabulary.

An Aho-Corasick automaton finds all terms of the vocabulary in a url in one
pass. A hit counts only between boundaries: the characters next to it must not
be letters (nor digits, for terms that start or end in one). One strict term
blocks; so do soft terms once the weights of the distinct ones reach
``soft_limit``.

Rules come first: a rule names a host, which stands for itself and all
subdomains, and the start of a path; the longest fitting rule decides.

A null url, or one without "://", has an empty host and path, fits no rule and
is judged by its terms. Rows are independent: copies, hot hosts and long urls
need no care, extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow

#: Rules as (rule, verdict).
RULES = [
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
    ("net/es/", "block"), ("net/fr/", "block"),
]

#: Terms that block alone.
STRICT = [
    "casino", "poker", "gambling", "betting", "free-bets", "porn", "xxx", "escort", "nude", "viagra", "cialis",
    "cheap-pills", "spam-farm", "ads-track", "warez", "torrent", "keygen", "phishing", "malware",
]

#: Terms that block together, with their weights.
SOFT = [
    ("adult", 1.0), ("bet", 1.0), ("bets", 1.0), ("bonus", 0.5), ("buy", 0.5), ("cheap", 1.0), ("click", 0.5),
    ("crack", 1.0), ("dating", 1.0), ("deal", 0.5), ("discount", 0.5), ("free", 0.5), ("hot", 0.5), ("jackpot", 1.0),
    ("loan", 1.0), ("loans", 1.0), ("lottery", 1.0), ("pills", 1.0), ("promo", 0.5), ("sex", 1.0), ("spam", 1.0),
    ("track", 0.5), ("win", 0.5), ("winner", 0.5),
]
SOFT_LIMIT = 1.5
SOFT_DISTINCT = 2

FOUND = T.StructType([
    T.StructField("strict_hits", T.LongType()), T.StructField("soft_hits", T.LongType()), T.StructField("soft_weight", T.DoubleType()),
    T.StructField("terms", T.StringType()),
])


def host(url: Column) -> Column:
    """After the first "://" up to /, ?, # or end, A-Z lower-cased; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ?, # or end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: str, host_: Column, path_: Column) -> Column:
    name, _, start = rule.partition("/")
    return ((host_ == name) | host_.endswith(f".{name}")) & path_.startswith(f"/{start}")


def chosen(rules: list[tuple[str, str]], host_: Column, path_: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        fit = fits(text, host_, path_)
        rule, verdict = F.when(fit, text).otherwise(rule), F.when(fit, decision).otherwise(verdict)
    return rule, verdict


def automaton(strict: list[str], soft: list[tuple[str, float]]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for term, weight in [*((t, w) for t, w in soft), *((t, None) for t in strict)]:
        found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def _open(text: str, at: int, inner: str) -> bool:
    """Is the place ``at`` a boundary for a term whose character there is ``inner``?"""
    if not 0 <= at < len(text):
        return True
    c = text[at]
    return not (c.isalpha() or c.isdigit() and inner.isdigit())


def hits(found, url: str | None) -> tuple[set, dict]:
    """Distinct strict terms, and distinct soft terms with weights, between boundaries."""
    strict, soft = set(), {}
    text = (url or "").lower()
    for end, (term, weight) in found.iter(text):
        if _open(text, end - len(term), term[0]) and _open(text, end + 1, term[-1]):
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
    return strict, soft


def judged(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, limit: float = SOFT_LIMIT, distinct: int = SOFT_DISTINCT) -> DataFrame:
    """page_id, url, host, path, rule, verdict, and the hits of every row."""
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], *FOUND])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(strict, soft)
        for batch in batches:
            rows = []
            for url in batch.column("url").to_pylist():
                hard, weak = hits(terms, url)
                rows.append((len(hard), len(weak), float(sum(weak.values())), ",".join(sorted(hard | weak.keys()))))
            values = list(zip(*rows)) or [()] * len(FOUND)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), *(pa.array(v, type=target.field(f.name).type) for v, f in zip(values, FOUND))],
                schema=target)

    found = pages.select("page_id", "url").transform(map_arrow, run, schema)
    found = found.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    rule, verdict = chosen(list(rules), F.col("host"), F.col("path"))
    blocked = (F.col("strict_hits") > 0) | ((F.col("soft_hits") >= distinct) & (F.col("soft_weight") >= limit))
    return found.withColumn("rule", rule).withColumn(
        "verdict", F.coalesce(verdict, F.when(blocked, "block").otherwise("allow"))
    ).select("page_id", "url", "host", "path", "rule", "verdict", *FOUND.fieldNames())
