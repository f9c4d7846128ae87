"""Profiles, fills and JSON pieces: the short ways give what the long ones would."""

import random

from pyspark.sql import functions as F

from sumtrail.operators import clean as cl
from sumtrail.operators import linkage as lk
from sumtrail.operators import profile as pf
from sumtrail.sources.split_text import Objects, State


def test_smallest_texts_of_many(spark, monkeypatch):
    values = [f"v{i:05d}" for i in range(3_000)] + ["n/a", "-", ""]
    df = spark.createDataFrame([(k, v) for k in (0, None) for v in values], "place int, value string")
    found = pf._smallest(df, ["place"], 8).collect()
    for k in (0, None):
        assert sorted(r.value for r in found if r.place == k) == values[:8]


def test_cells_are_shuffled_by_number(spark):
    """No name of a table or column goes with each of its cells."""
    df = spark.createDataFrame([("a", "1"), ("b", "2")], "name_of_text string, name_of_number string")
    assert pf._numbered_cells(df, 3).schema.simpleString() == "struct<place:int,raw:string>"
    rows = {r.column_name: r for r in pf.profile_tables({"one": df, "two": df.where("false"), "three": df}).collect() if r.dataset == "three"}
    assert rows["name_of_number"].median == 1.5 and rows["name_of_text"].samples == ["a", "b"]


def test_overlap_of_more_columns_than_one_number_has_bits(spark):
    names = [f"c{i}" for i in range(40)]
    left = spark.createDataFrame([tuple(f"k{i % 7}" for i in range(40)), tuple(f"k{i % 5}" for i in range(40))], names)
    right = spark.createDataFrame([tuple(f"k{i % 3}" for i in range(40))], names)
    pairs = [dict(pair=i, left_dataset="l", left_column=c, right_dataset="r", right_column=c, left_role="x", same_name=True, same_role=False)
             for i, c in enumerate(names)]
    overlap = lk.key_overlap({"l": left, "r": right}, pairs)
    found = {r.pair: (r.left_keys, r.right_keys, r.shared_keys) for r in overlap.collect()}
    assert found == {i: (len({i % 7, i % 5}), 1, int(i % 3 in {i % 7, i % 5})) for i in range(40)}


def test_fills_read_their_rows_once(spark, tmp_path, monkeypatch):
    """The rows may come from a shuffle of the whole table."""
    seen = []
    monkeypatch.setattr(cl, "written", lambda df: seen.append(df.columns) or df)
    rows = spark.createDataFrame([("a", "1"), ("a", None), ("b", "3")], "k string, x string")
    values = cl.fills(rows, {"x": "number", "k": "string"})
    assert ["x", "k"] in seen
    assert {r.column_name: r.fill for r in values.collect()} == {"x": "2", "k": "a"}


def test_whole_numbers_stay_as_they_are(spark):
    cells = ["0", "-0", "00", "12", "-7", "012", "+3", "1e3", "1.50", "£1,200", "9" * 15, "9" * 16, "12%", "x", None, "12\n"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    slow = [r[0] for r in df.orderBy("i").select(cl._normal_form("c", "number", False)).collect()]
    assert [r.c for r in cl.normalised(df, {"c": "number"}).orderBy(F.col("i").cast("int")).collect()] == slow


def test_quick_pieces_go_as_walked():
    rng = random.Random(3)
    marks = ["{", "[", "]", '"', '"', "\\", ",", " ", "a", '"k":', '"r":[', '"v"', ",{", ":"]
    quick = 0
    for _ in range(20_000):
        piece = "".join(rng.choice(marks) for _ in range(rng.randint(0, 9)))
        state = State(rng.random() < 0.3, rng.randint(0, 5), rng.choice([None, "r", "k"]))
        for scanner in (Objects(None, False), Objects("r", True)):
            *_, (_, _, end) = scanner._walk(piece, state)
            assert scanner.end(piece, state) == end
            assert scanner.moved(piece, state.quoted, state.depth) == (end.quoted, end.depth)
            slow = Objects(scanner.name, scanner.level == 2)
            slow._within = lambda piece, state: None
            assert scanner.records(piece, state) == slow.records(piece, state)
            quick += scanner._within(piece, state) is not None
    assert quick > 1_000
