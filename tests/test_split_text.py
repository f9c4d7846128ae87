"""Records over split files, against one parser over the whole text."""

import csv
import io
import json
import random

import pytest

from sumtrail.sources import readers, split_text


@pytest.fixture(params=["400", "1000000"])
def split_bytes(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield int(request.param)
    for n, v in before.items():
        spark.conf.set(n, v)


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_bytes(text.encode())
    return str(path)


CELLS = ["", "a", "x,y", 'say "hi"', "two\nlines", "\n", '"', '""\n"', "Ünïcode\r\nline", "  spaced ", "a" * 300 + "\n" + "b" * 300, 'tail"']


def table(seed, n=70):
    r = random.Random(seed)
    return [[str(i), r.choice(CELLS), r.choice(CELLS)] for i in range(n)]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_cells_with_line_breaks(spark, tmp_path, split_bytes, end, quoting):
    rows = table(split_bytes)
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end, quoting=quoting)
    w.writerow(["id", " b ", "c"])
    w.writerows(rows)
    path = put(tmp_path, "a.csv", out.getvalue())
    df = readers.read_csv(spark, path)
    assert df.columns == ["id", "b", "c"]
    assert as_rows(df) == [tuple(r) for r in rows]
    if split_bytes == 400:
        assert split_text.pieces(spark, path, "\n").rdd.getNumPartitions() > 8
        assert split_text.scanned(split_text.pieces(spark, path, "\n"), split_text.Cells(",")).splits > 8


@pytest.mark.parametrize("split_bytes", ["400"], indirect=True)
def test_several_files_blank_lines_and_a_header_with_a_break(spark, tmp_path, split_bytes):
    (tmp_path / "t.csv").mkdir()
    for k in range(3):
        body = "".join(f'{100 * k + i};"cell\n{i}"\n\n' for i in range(40))
        put(tmp_path / "t.csv", f"part-{k}.csv", '\n\n"id";"long\nname"\n' + body)
    df = readers.read_csv(spark, str(tmp_path / "t.csv"), sep=";")
    assert df.columns == ["id", "long\nname"]
    assert as_rows(df) == [(str(100 * k + i), f"cell\n{i}") for k in range(3) for i in range(40)]


@pytest.mark.parametrize("split_bytes", ["400"], indirect=True)
def test_quotes_inside_plain_cells_open_nothing(spark, tmp_path, split_bytes):
    body = "".join(f'{i},5" disk,"in\nside"\n' for i in range(80))
    df = readers.read_csv(spark, put(tmp_path, "q.csv", "id,size,note\n" + body))
    assert as_rows(df) == [(str(i), '5" disk', "in\nside") for i in range(80)]


def test_ragged_records_are_shown(spark, tmp_path):
    df = readers.read_csv(spark, put(tmp_path, "r.csv", 'id,b\n1,x\n2\n3,x,"sur\nplus"\n'), ragged="raw")
    assert as_rows(df) == [("1", "x", None), ("2", "", "2"), ("3", "x", '3,x,"sur\nplus"')]


def test_lines_against_a_plain_automaton():
    r = random.Random(1)

    def ends(text, quoted):
        start = True
        i = 0
        while i < len(text):
            c = text[i]
            if quoted:
                if c == '"':
                    if text[i + 1 : i + 2] == '"':
                        i += 1
                    else:
                        quoted, start = False, False
            elif c == '"' and start:
                quoted = True
            else:
                start = c == ","
            i += 1
        return quoted

    cells = split_text.Cells(",")
    for _ in range(20_000):
        line = "".join(r.choice('""",,a ') for _ in range(r.randint(0, 9)))
        for quoted in (False, True):
            assert cells.end(line, split_text.State(quoted)).quoted == ends(line, quoted), (line, quoted)


def test_long_lines_take_linear_time():
    cells = split_text.Cells(",")
    for line in ('"' * 500_001, '",' * 300_000, 'a"' * 300_000, ',"a' * 300_000, '"' + "a," * 300_000):
        cells.end(line, split_text.State())
        cells.end(line, split_text.State(True))


VALUES = [1, None, "plain", 'q"uote', "b{r]a}c[e", "\\", "\\\"}", "new\nline", {"k": [1, {"z": "}"}]}, [{"a": 1}, "]"], True, 2.5, "é"]


def objects(seed, n=60):
    r = random.Random(seed)
    return [{"id": i, "a": r.choice(VALUES), "b": r.choice(VALUES)} | ({"rare": "x"} if i % 50 == 7 else {}) for i in range(n)]


@pytest.mark.parametrize("split_bytes", ["400"], indirect=True)
@pytest.mark.parametrize("layout", [{}, {"indent": 2}, {"separators": (",", ":")}])
@pytest.mark.parametrize("wrapped", [False, True])
def test_arrays_of_records(spark, tmp_path, split_bytes, layout, wrapped):
    rows = objects(split_bytes)
    whole = {"meta": {"x": {"id": "no"}, "list": {"records": [{"id": "no"}]}}, "note": "\"records\": [{", "records": rows, "after": {"y": {"id": "no"}}} if wrapped else rows
    path = put(tmp_path, "a.json", json.dumps(whole, ensure_ascii=False, **layout))
    got = readers.read_json(spark, path, split=True)
    want = readers.read_json(spark, path, split=False)
    assert sorted(got.columns) == sorted(want.columns)
    # Cells of mixed kinds keep the layout of their text.
    bare = lambda cell: "".join(cell.split()) if cell[:1] in "[{" else cell
    key = lambda df: sorted(tuple(map(bare, r)) for r in df.select(*sorted(df.columns)).collect())
    assert key(got) == key(want) and got.count() == len(rows)
    if split_bytes == 400:
        assert split_text.pieces(spark, path, "}").rdd.getNumPartitions() > 4


@pytest.mark.parametrize("split_bytes", ["400"], indirect=True)
def test_named_array_of_several(spark, tmp_path, split_bytes):
    whole = {"a": [{"x": i} for i in range(60)], "b": [{"y": i, "x": -1} for i in range(60)], "n": [1, 2]}
    path = put(tmp_path, "two.json", json.dumps(whole))
    for name in "ab":
        got = readers.read_json(spark, path, records_field=name, split=True)
        assert sorted(int(r.x) for r in got.collect()) == ([-1] * 60 if name == "b" else list(range(60)))


@pytest.mark.parametrize("text,code", [
    ("[1, 2, 3]", "PARSE_FAILED"), ('[{"a": 1}, 2]', "PARSE_FAILED"), ('[{"a": 1}, [{"a": 2}]]', "PARSE_FAILED"), ('[{"a": 1}, "}"]', "PARSE_FAILED"),
    ('{"a": [{"x": 1}], "b": [{"y": 1}]}', "PARSE_FAILED"), ('{"count": 5}', "PARSE_FAILED"), ('{"values": [1, 2]}', "PARSE_FAILED"),
    ('[{"a": bad}]', "PARSE_FAILED"), ("[]", "NO_ROWS"), ("  \n", "EMPTY_FILE")])
def test_what_is_no_array_of_records(spark, tmp_path, text, code):
    with pytest.raises(readers.IngestError) as error:
        readers.read_json(spark, put(tmp_path, "bad.json", text), split=True)
    assert error.value.code == code
