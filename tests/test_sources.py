import pytest
from pyspark.sql import functions as F

from sumtrail.sources import readers, sinks


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_csv_trims_headers_and_keeps_text(spark, tmp_path):
    path = put(tmp_path, "a.csv", "date, revenue\n2024-01-01,100\n\n2024-01-02, 7 \n")
    assert rows(readers.read_csv(spark, path)) == [
        {"date": "2024-01-01", "revenue": "100"}, {"date": "2024-01-02", "revenue": " 7 "}]


def test_csv_quotes_newlines_and_delimiters(spark, tmp_path):
    path = put(tmp_path, "b.csv", 'a;b\n"x;1";"line\nbreak"\n"say ""hi""";\n')
    assert rows(readers.read_csv(spark, path, quoted_newlines=True)) == [
        {"a": "x;1", "b": "line\nbreak"}, {"a": 'say "hi"', "b": ""}]


def test_tsv(spark, tmp_path):
    path = put(tmp_path, "a.tsv", "date\tproduct\trevenue\n2024-01-01\tA\t1\n2024-01-02\tB\t2\n")
    assert rows(readers.read_table(spark, path))[1] == {"date": "2024-01-02", "product": "B", "revenue": "2"}


def test_json_array_wrapper_and_ragged(spark, tmp_path):
    array = put(tmp_path, "a.json", '[{"product":"A","revenue":1200},{"product":"B","revenue":5,"note":{"k":[1]}}]')
    got = rows(readers.read_json(spark, array))
    assert got[0] == {"product": "A", "revenue": "1200", "note": ""}
    assert got[1]["note"] == '{"k":["1"]}'
    wrapped = put(tmp_path, "w.json", '{"meta": {}, "records": [{"a": 1}]}')
    assert rows(readers.read_json(spark, wrapped)) == [{"a": "1"}]
    lines = put(tmp_path, "l.json", '{"a": 1}\n{"a": 2, "b": true}\n')
    assert rows(readers.read_json(spark, lines, lines=True)) == [{"a": "1", "b": ""}, {"a": "2", "b": "true"}]


@pytest.mark.parametrize("name,text,code", [
    ("bad.json", "{not json", "PARSE_FAILED"),
    ("scalar.json", '{"count": 5}', "PARSE_FAILED"),
    ("numbers.json", '{"values": [1, 2]}', "PARSE_FAILED"),
    ("two.json", '{"a": [{"x": 1}], "b": [{"y": 1}]}', "PARSE_FAILED"),
    ("empty.csv", "", "EMPTY_FILE"),
    ("header.csv", "date,revenue\n", "NO_ROWS"),
    ("twice.csv", "a, a\n1,2\n", "PARSE_FAILED"),
])
def test_bad_inputs(spark, tmp_path, name, text, code):
    with pytest.raises(readers.IngestError) as error:
        readers.read_table(spark, put(tmp_path, name, text))
    assert error.value.code == code


def test_several_tables_fail_together(spark, tmp_path):
    good, bad = put(tmp_path, "g.csv", "a\n1\n"), put(tmp_path, "h.csv", "a\n")
    assert set(readers.read_tables(spark, {"g": good})) == {"g"}
    with pytest.raises(readers.IngestError):
        readers.read_tables(spark, {"g": good, "h": bad})


def test_csv_sink_quotes_every_field(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', None)], "n int, t string, e string")
    sinks.write_csv(df.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == '"n","t","e"\n"1","say ""hi""",""\n'


def test_run_history_keeps_the_newest(spark, tmp_path):
    path = str(tmp_path / "runs")
    for i in range(4):
        one = spark.createDataFrame([("a", i)], "dataset string, i int")
        sinks.append_run(one.withColumn("created_at", F.to_timestamp(F.lit(f"2024-01-0{i + 1}"))), path)
    assert [r.i for r in sinks.load_runs(spark, path, 2).orderBy("position").collect()] == [3, 2]


def test_equal_headers_are_refused(spark, tmp_path):
    path = put(tmp_path, "dup.csv", 'a,"b ",b\n1,2,3\n')
    with pytest.raises(readers.IngestError) as error:
        readers.read_csv(spark, path)
    assert error.value.code == "PARSE_FAILED"


@pytest.mark.parametrize("extension", ["jsonl", "ndjson"])
def test_json_lines_by_extension(spark, tmp_path, extension):
    path = put(tmp_path, f"e.{extension}", '{"a": 1, "b": {"c": 2}}\n{"a": null}\n')
    assert rows(readers.read_table(spark, path)) == [{"a": "1", "b": '{"c":"2"}'}, {"a": "", "b": ""}]


def test_large_files_are_split(spark, tmp_path):
    path = put(tmp_path, "big.csv", "a,b\n" + "1,2\n" * 200_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert readers.read_csv(spark, path).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
