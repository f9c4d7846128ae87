"""Readers for delimited, JSON and Parquet tables, with typed errors.

Every text table comes back with all columns as strings and trimmed headers.
"""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.operators.profile import as_text
from sumtrail.session import shared_folder
from sumtrail.sources import split_text

DELIMITERS = [",", "\t", ";", "|"]


class IngestError(ValueError):
    """A source that cannot become a table; ``code`` says why.

    EMPTY_FILE, NO_ROWS or PARSE_FAILED.
    """

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


def normalise_headers(df: DataFrame) -> DataFrame:
    """Trim header names; two names that become equal are an error."""
    names = [c.strip() for c in df.columns]
    if len(set(names)) < len(names):
        raise IngestError("PARSE_FAILED", "two headers are equal after trimming")
    return df.toDF(*names)


def _blank_for_missing(df: DataFrame) -> DataFrame:
    return df.na.fill("")


def _guarded(df: DataFrame) -> DataFrame:
    if not df.columns:
        raise IngestError("NO_ROWS", "no columns were found")
    if df.isEmpty():
        raise IngestError("NO_ROWS", "no data rows were found")
    return df


def _first_line(spark: SparkSession, path: str) -> str:
    lines = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    if not lines:
        raise IngestError("EMPTY_FILE", f"{path} is empty")
    return lines[0].value


def sniff_delimiter(header: str) -> str:
    """The candidate that occurs most often in the header line."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


#: Quotes as two in a row, cells that keep their line breaks and spaces.
_CSV = {"quote": '"', "escape": '"', "multiLine": "true"}


def _open_quotes(spark: SparkSession, path: str) -> bool:
    """True if a line holds an odd number of quotes, so that a cell may hold a line break."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def csv_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, value, first): the records of delimited files as text, first being a file's header."""
    found = split_text.pieces(spark, path, "\n")
    whole, _ = split_text.records(found, split_text.scanned(found, split_text.Cells(sep)))
    return whole.withColumn("value", F.regexp_replace("value", r"\r?\n?$", ""))


def read_csv(spark: SparkSession, path: str, sep: str | None = None, quoted_newlines: bool = True,
             ragged: str | None = None) -> DataFrame:
    """Delimited text with a header line.

    Files are split between tasks, also where cells hold line breaks: if a line
    has an odd number of quotes, quotes are followed over the splits of each file
    and the records written once to the shared folder. ``quoted_newlines=False``
    spares that look at the text and takes every line for a record. ``ragged``
    names a column for the text of records with more or fewer cells than headers;
    it is null for all others. Surplus cells are in no column otherwise, and
    missing cells are blank.
    """
    header = _first_line(spark, path)
    sep = sep or sniff_delimiter(header)
    if quoted_newlines and len(sep) == 1 and (ragged or _open_quotes(spark, path)):
        lines = csv_records(spark, path, sep)
        header = lines.where("first").limit(1).collect()
        names = _header_names(header[0].value if header else "", sep)
        value = lines.where("not first").select("value")
    else:
        names = _header_names(header, sep)
        value = None
    if len({n.strip() for n in names}) < len(names):
        raise IngestError("PARSE_FAILED", "two headers are equal")
    if value is None and ragged is None:
        df = (
            spark.read.option("header", True).option("inferSchema", False)
            .option("sep", sep).option("quote", '"').option("escape", '"')
            .option("multiLine", quoted_newlines and len(sep) > 1).csv(path))
        return _guarded(_blank_for_missing(normalise_headers(df)))
    if value is None:
        raise ValueError("ragged needs quoted_newlines and a delimiter of one character")
    taken = ragged or "_ragged"
    if taken in [n.strip() for n in names]:
        raise ValueError(f"{taken} is a column of the file; name another column for ragged records")
    # Positions instead of names inside the parser: a header may be any text.
    kind = T.StructType([*[T.StructField(f"c{i}", T.StringType()) for i in range(len(names))], T.StructField("ragged", T.StringType())])
    options = {**_CSV, "sep": sep, "columnNameOfCorruptRecord": "ragged"}
    cells = value.select(F.from_csv("value", kind.simpleString(), options).alias("r"))
    columns = [F.coalesce(F.col(f"r.c{i}"), F.lit("")).alias(n.strip()) for i, n in enumerate(names)]
    return _guarded(cells.select(*columns, *([F.col("r.ragged").alias(ragged)] if ragged else [])))


def _header_names(header: str, sep: str) -> list[str]:
    return next(csv.reader([header], delimiter=sep), [])


def read_tsv(spark: SparkSession, path: str, quoted_newlines: bool = True, ragged: str | None = None) -> DataFrame:
    return read_csv(spark, path, sep="\t", quoted_newlines=quoted_newlines, ragged=ragged)


def _cell(field: T.StructField) -> F.Column:
    c = F.col(f"`{field.name}`")
    nested = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
    return (F.to_json(c) if nested else c.cast("string")).alias(field.name)


def _is_records(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def json_records(spark: SparkSession, path: str, records_field: str | None = None) -> str:
    """Folder of JSON Lines with the records of an array, or of the array in an object, that files hold.

    Brackets and strings are followed over the splits of each file, so many tasks
    read a file, whether or not it has line ends.
    """
    found = split_text.pieces(spark, path, split_text.Objects.separator)
    first = found.where(F.col("value").rlike(r"\S")).limit(1).collect()
    if not first:
        raise IngestError("EMPTY_FILE", f"{path} is empty")
    wrapped = first[0].value.lstrip()[:1] == "{"
    scan = split_text.scanned(found, split_text.Objects(None, wrapped))
    names = None
    if wrapped:
        every, names = split_text.names_of(found, scan)
        chosen = records_field or (every[0] if len(every) == 1 else None)
        if chosen not in every:
            raise IngestError("PARSE_FAILED", "expected one array of records; name it with records_field")
        scan.scanner = split_text.Objects(chosen, True)
    rows, odd = split_text.records(found, scan, names)
    if not odd.isEmpty():
        raise IngestError("PARSE_FAILED", "the array holds something else than records")
    if rows.isEmpty():
        raise IngestError("NO_ROWS", "the array is empty")
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    # Line ends cannot stand inside a JSON string, so they are only layout.
    rows.select(F.translate("value", "\r\n", "  ")).write.text(folder)
    return folder


def read_json(spark: SparkSession, path: str, records_field: str | None = None,
              lines: bool = False, split: bool | None = None) -> DataFrame:
    """A JSON array of objects, an object holding one, or JSON Lines.

    Nested values stay JSON text and absent keys are blank. ``records_field``
    names the array when an object has several. ``lines=True`` reads one
    object per line. Arrays that fill more than one split are read by many tasks;
    ``split`` says so or not without looking.
    """
    if not lines and split is None:
        split = split_text.pieces(spark, path, split_text.Objects.separator).rdd.getNumPartitions() > 1
    if split and not lines:
        path, lines = json_records(spark, path, records_field), True
        start = "{"
    else:
        start = _first_line(spark, path).lstrip()[:1]
    df = spark.read.option("multiLine", not lines).option("primitivesAsString", True).json(path)
    if "_corrupt_record" in df.columns or not df.columns:
        raise IngestError("PARSE_FAILED", "not valid JSON records")
    if start == "{" and not lines:
        arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
        chosen = records_field or (arrays[0] if len(arrays) == 1 else None)
        if chosen is None or not _is_records(df.schema[chosen].dataType):
            raise IngestError("PARSE_FAILED", "expected one array of records; name it with records_field")
        df = df.select(F.inline(F.col(f"`{chosen}`")))
    return _guarded(_blank_for_missing(normalise_headers(df.select(*[_cell(f) for f in df.schema.fields]))))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, lines=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A typed table; its types are kept."""
    return normalise_headers(spark.read.parquet(path))


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Reader by file extension."""
    extension = path.rstrip("/").rsplit(".", 1)[-1].lower()
    readers = {
        "tsv": read_tsv, "json": read_json, "jsonl": read_json_lines, "ndjson": read_json_lines, "parquet": read_parquet,
    }
    return readers.get(extension, read_csv)(spark, path, **options)


def read_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame]:
    """Several tables as text; one failure fails all."""
    return {name: as_text(read_table(spark, path)) for name, path in paths.items()}
