"""What distinct texts look like: the short ways give what the patterns alone would give."""

import random
import re

from pyspark.sql import functions as F

from sumtrail.functions import fixed_values as fixed
from sumtrail.functions.values import looks_like_date, strip, to_day, to_number
from sumtrail.operators import profile as pf

WORDS = ["12", "-7", "1.50", "-0", "+3", ".5", "£1,200.50", "12%", "% ", "1e5", "1e999", "9" * 400, "NaN", "n/a", "-", "", "true", "YES",
         "n", "0", "1", "2024-01-05", "2024-1-5x", "2024/3/4", "3/4/2024", "13.4.2024", "3/4/2024 10:30", "4 May 2021", "May 4, 21",
         "a@b.co", "SW1A 1AA", "sw1a1aa", "ABC123", "ABCDEFGHIJKLM", "12345", "1234567890123", "12 ", "true ", "ABCD\u0085", "١٢", "€5", "x"]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choice(" 0123456789.,-/+%£@aeMyYT ﻿\t") for _ in range(rng.randint(0, 9))) for _ in range(3_000)]
    return sorted({*WORDS, *made, *(f" {w} " for w in WORDS)})


def test_texts_are_tested_as_by_all_patterns(spark):
    raw = spark.createDataFrame([(t,) for t in texts()], "raw string")
    plain = F.trim(F.col("raw"), F.lit(fixed.BLANKS))
    assert raw.where(~strip(F.col("raw")).eqNullSafe(plain)).count() == 0
    counts = raw.select(F.lit("d").alias("dataset"), F.lit("c").alias("column_name"), plain.alias("value"), F.lit(1).alias("n"), F.lit(1).alias("chars")).distinct()
    v = F.col("value")
    present = ~F.lower(v).isin(fixed.MISSING_MARKERS)
    slow = {
        "present": present, "number": F.when(present, to_number(v)), "day": F.when(present, to_day(v)),
        "is_date": present & looks_like_date(v) & ~v.rlike(fixed.PLAIN_NUMBER),
        "is_date_shaped": present & v.rlike(f"{fixed.ISO_DAY}|{fixed.SLASH_DAY}"),
        **{name: present & v.rlike(pattern) for name, pattern in {
            "is_boolean": fixed.BOOLEAN_WORD, "is_bit": fixed.BOOLEAN_WORD_OR_BIT, "is_padded_iso": fixed.PADDED_ISO_DAY,
            "is_plain": fixed.PLAIN_NUMBER, "has_currency": fixed.CURRENCY_SIGN, "has_percent": fixed.PERCENT_SIGN,
            "is_email": fixed.EMAIL, "is_postcode": fixed.POSTCODE, "is_item_code": fixed.ITEM_CODE}.items()},
    }
    wanted = {r.value: r for r in counts.select("value", *[c.alias(n) for n, c in slow.items()]).collect()}
    found = {r.value: r for r in pf._tested(counts, False).collect()}
    assert found.keys() == wanted.keys()
    for value, row in wanted.items():
        assert [str(found[value][n]) for n in slow] == [str(row[n]) for n in slow], value


def test_plain_numbers_meet_few_patterns(spark, tmp_path):
    """They are most of a large table, and each pattern takes time for each of them."""
    counts = spark.createDataFrame([("d", "c", "12", 1, 2)], "dataset string, column_name string, value string, n long, chars long")
    counts.write.parquet(f"{tmp_path}/counts")
    plan = pf._tested(spark.read.parquet(f"{tmp_path}/counts"), False)._jdf.queryExecution().optimizedPlan().toString()
    plain, other = re.split(r"\n\+- Project|\n:- Project", plan)[1:]
    assert 0 < plain.count("RLIKE") <= 4 < other.count("RLIKE")
