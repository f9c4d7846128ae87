"""Measures against plain counting, and the line rules."""

import random
import re

from sumtrail.llm import line_quality


def plain(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, dup = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_measures():
    rng = random.Random(8)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "é", " ", "\n", "|", "#", "\t", "\u00a0", "\x1c", "\r", "𝒳"]) for _ in range(rng.randint(0, 120)))
        assert line_quality.judge(text)[:5] == plain(text), text


CLEAN = "This is a plain sentence of a clean text, with enough words to say a thing."


def test_line_rules():
    good = [CLEAN, "Short line", "He said: stop! And then 5 > 3 held.", "A. B. C. D. E.", "Is it 50% off? Yes & no, more or less."]
    bad = ["Home | News | Sport | Contact us", "one | two |", "Licensed under the Apache License, Version 2.0.", "THIS IS ALL IN CAPITALS HERE",
           "This*** is%%% a### bad$$$ line&&& of*** text", "WOW!! GREAT!! STUFF!! HERE!!", " ".join(["spam"] * 20), "All rights reserved. 2020"]
    for line in good:
        assert not line_quality.bad_line(line, line.encode().split()), line
    for line in bad:
        assert line_quality.bad_line(line, line.encode().split()), line


def test_a_mention_is_no_boilerplate():
    """A clean document of one line that mentions a phrase stays whole; lines made of phrases go."""
    text = words(200) + " Our privacy policy was discussed, " + words(200, 200)
    assert line_quality.judge(text)[-2:] == (True, text)
    phrase = "all rights reserved"
    for n, bad in ((171, True), (172, False)):  # 19 of 190 characters, 19 of 191
        line = phrase + " " + "x" * (n - 1)
        assert line_quality.bad_line("  " + line + "\t" * 50, line.encode().split()) is bad
    mentions = ". ".join(f"Read our {p} please" for p in line_quality.BOILERPLATE)
    assert line_quality.bad_line(mentions, mentions.encode().split())


def words(n, start=0):
    return " ".join(f"word{k}" for k in range(start, start + n)) + "."


def test_verdicts():
    keep = lambda t: line_quality.judge(t)[-2:]
    assert keep(words(60)) == (True, words(60))
    assert keep(words(49))[0] is False
    assert keep("Home | News | Sport | Contact\n" + words(60)) == (True, words(60))
    assert keep("\n".join(["SHOUTED WORDS STAND HERE ALONE"] * 1 + ["Home | News | Sport | Contact " + words(70)] + [words(60)]))[0] is False
    assert keep((words(20) + "\n") * 5)[0] is False  # repeated windows


def test_rows(spark):
    text = "Home | News | Sport | Contact\n" + words(60)
    rows = [(1, None, 1, True), (2, "", 1, True), (None, text, 9, None), (4, text, 9, None), (4, text, 9, None), (5, words(50_000), 9, None), (6, " \n\t", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, kept boolean")
    got = [(r.doc_id, r.n_words, r.kept) for r in line_quality.measured(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, False), (2, 0, False), (None, 67, True), (4, 67, True), (4, 67, True), (5, 50_000, True), (6, 0, False)], key=str)
    clean = line_quality.cleaned(df)
    assert clean.dtypes == df.dtypes
    assert sorted(((r.doc_id, r.n_chars) for r in clean.collect()), key=str) == sorted(
        [(None, len(words(60))), (4, len(words(60))), (4, len(words(60))), (5, len(words(50_000)))], key=str)
    assert line_quality.measured(df.limit(0)).count() == 0
    assert line_quality.cleaned(df.limit(0)).count() == 0


def test_labels_agree(spark, sf):
    """What people called bad goes; what they called good goes only where the fixed limits say so."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = line_quality.measured(docs).join(labels, "doc_id").collect()
    assert not [r for r in rows if r.quality == 0 and r.kept]
    assert not [r for r in rows if r.quality == 1 and not r.kept and not r.base_failed]
