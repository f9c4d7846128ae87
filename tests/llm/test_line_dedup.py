"""Repeated lines across documents."""

import random

import pytest
from pyspark.sql import functions as F

from sumtrail.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def plain(rows):
    """(doc_id, text) after dropping, with counts, by sets."""
    def key(line):
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))
        return k if len(k) >= 10 else None

    held = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n") if doc_id is not None else ():
            if key(line):
                held.setdefault(key(line), set()).add(doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        lost = lambda l: doc_id is not None and key(l) and len(held[key(l)]) > 1 and min(held[key(l)]) != doc_id  # noqa: B023, E731
        kept = [l for l in lines if not lost(l)]
        out.append((doc_id, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


CASES = [
    (3, "a line that two hold\nshort\nonly here, really"),
    (7, "  A Line THAT two hold\t\r\nshort\nÄ line of its own\n"),
    (9, "ä line of its own\nA LINE that two hold\nten points"),
    (9, "ten points\nanother text with the same id"),
    (11, None), (12, ""), (13, "\n\n"), (14, "twice in one text\ntwice in one text"),
    (15, "nine poin\nten pointſ\nten points"), (16, "nine poin\nübergänge1\nübergäng1"), (17, "übergänge1\nübergäng1"),
    (None, "a line that two hold"), (None, "only without an id"), (18, "only without an id\n\x00 zero and   more"),
    (19, "\x00 zero and   more\n" + "long " * 50_000), (20, "long " * 50_000 + "\n" + "Long " * 50_000),
]


def test_cases(spark):
    df = spark.createDataFrame(CASES, "doc_id long, text string").repartition(4)
    got = ordered(line_dedup.report(df).select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == ordered(plain(CASES))


@pytest.mark.parametrize("block", [1, 5, 1 << 18])
def test_random_texts_in_small_blocks_and_narrow_filters(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    monkeypatch.setattr(line_dedup, "SHARD", 7)  # many shards
    random.seed(block)
    lines = [f"line number {i} of all" for i in range(60)] + [f"s{i}" for i in range(5)]
    rows = [(f"d{i:03}", "\n".join(random.choice(lines[: random.choice([3, 65])]) + f" {random.random() < 0.3 and i}" for _ in range(random.randint(0, 9)))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(7)
    assert ordered(line_dedup.report(df).select("doc_id", "n_lines", "n_dropped", "text").collect()) == ordered(plain(rows))


def test_filters_suspect_every_repeat_and_few_others(spark):
    rows = [(i, "\n".join([f"own line {i} {j}" for j in range(200)] + ["held by everyone"])) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    held = line_dedup.blocks(df)
    shards, width = line_dedup.sizes(20_100)
    seen = line_dedup.suspects(held, line_dedup.suspicions(line_dedup.asked(held, shards, width), width), shards)
    by = seen.groupBy("digest").count().collect()
    assert max(r["count"] for r in by) == 100
    assert len(by) < 0.05 * 20_000


def test_hot_line_and_extra_columns(spark):
    rows = [(i, f"the same line in all\nline of {i} alone", "x", i) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lost string, first long").repartition(6)
    out = line_dedup.cleaned(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text == f"line of {i} alone" and got[i].lost == "x" and got[i].first == i for i in range(1, 500))


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.report(df).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert ordered(line_dedup.report(nulls).collect()) == [(1, 1, 0, None), (2, 1, 0, "")]


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = ordered(line_dedup.report(docs).select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == ordered(plain([(r.doc_id, r.text) for r in docs.collect()]))
    assert docs.select(F.count("*")).first()[0] == len(got)
