"""Quality rules, line first: bad lines go, then documents that lose too much.

Every line is judged alone by punctuation, navigation, boilerplate and
repetition rules. A boilerplate phrase fails a line only if such phrases make up
``phrase_share`` of it, so a paragraph that mentions one stays. Lines that fail are removed, and a document is rejected when
the removed lines held more than ``max_lost`` of its word characters, or when a
measure of the whole document fails.

A null text counts as a text without words. Work is row by row, so copies,
ties, hot sources and very long texts need no special care; extra columns are
kept. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import BLANKS, arrow_schema, map_arrow, per_row, words

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Phrases of lines that belong to a site or a licence, not to a text.
BOILERPLATE = [
    "licensed under the", "is licensed under", "all rights reserved", "privacy policy", "terms of service",
    "terms of use", "cookie policy", "we use cookies", "enable javascript", "subscribe to our newsletter",
    "click here to", "sign in to", "log in to", "powered by", "skip to content", "back to top", "copyright (c)",
]

#: What stands between the items of a navigation line.
SEPARATORS = [" | ", " » ", " > ", " • "]

_BOILERPLATE = re.compile("|".join(re.escape(p) for p in BOILERPLATE), re.IGNORECASE)
_ENDS = re.compile(rb"[#*$%&|<>!]\Z")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are of the words of the line or text, of its characters for phrases."""

    min_words: int = 50
    max_repeat_share: float = 0.5
    max_lost: float = 0.5
    symbol_words: float = 0.3
    shouted_words: float = 0.6
    phrase_share: float = 0.1
    separators: int = 3
    same_word: float = 0.34
    judged_words: int = 4


RULES = Rules()

MEASURES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()), T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()), T.StructField("n_lines", T.LongType()),
    T.StructField("n_bad_lines", T.LongType()), T.StructField("lost_chars", T.LongType()),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()),
    T.StructField("clean_text", T.StringType()),
])


def repeated_words(tokens: list, n: int = 3) -> int:
    """Words that lie in an n-word window found at least twice, first included."""
    if len(tokens) <= n:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in tokens), np.int64, len(tokens))
    key = ids[: len(ids) - n + 1].copy()
    for k in range(1, n):
        # Each step renumbers the windows, so keys stay below (number of windows) x (number of words).
        key = np.unique(key, return_inverse=True)[1].reshape(-1) * len(seen) + ids[k : len(ids) - n + 1 + k]
    _, where, counts = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[where.reshape(-1)] >= 2)
    covered = np.zeros(len(ids), bool)
    for k in range(n):
        covered[starts + k] = True
    return int(covered.sum())


def bad_line(line: str, tokens: list[bytes], rules: Rules = RULES) -> bool:
    """True where one of the line rules fails; ``tokens`` are the line's words."""
    n = len(tokens)
    # Boilerplate: phrases of a site or licence that are more than a mention within the line.
    if _BOILERPLATE.search(line):
        whole = line.strip(BLANKS)
        if len(whole) - len(_BOILERPLATE.sub("", whole)) >= rules.phrase_share * len(whole):
            return True
    # Navigation: items set apart by bars, arrows or bullets.
    if sum(line.count(s) for s in SEPARATORS) >= rules.separators or line.rstrip(BLANKS).endswith(" |"):
        return True
    if n < rules.judged_words:
        return False
    # Punctuation: words that end in symbols or exclamation marks.
    marked = sum(1 for w in tokens if len(w) > 1 and _ENDS.search(w))
    if marked > rules.symbol_words * n:
        return True
    # Shouting: of the words of three characters or more whose letters have case, most are in capitals.
    plain = [w.decode("utf-8", "surrogatepass") for w in tokens]
    cased = [w for w in plain if len(w) > 2 and w.lower() != w.upper()]
    if sum(1 for w in cased if w == w.upper()) > rules.shouted_words * len(cased):
        return True
    return n >= 3 * rules.judged_words and len(set(tokens)) < rules.same_word * n and _runs(tokens) > 0.5


def _runs(tokens: list[bytes]) -> float:
    """Share of words equal to the word before."""
    return sum(a == b for a, b in zip(tokens, tokens[1:])) / max(1, len(tokens) - 1)


def judge(text: str | None, rules: Rules = RULES) -> tuple:
    """All measures of one text, in the order of ``MEASURES``."""
    text = text or ""
    tokens = words(text)
    word_chars = len(text) - sum(text.count(c) for c in BLANKS)
    n_symbols = sum(text.count(c) for c in SYMBOLS)
    repeats = repeated_words(tokens)
    seen: set[str] = set()
    good: list[str] = []
    n_lines = n_dup = n_bad = lost = 0
    for line in text.split("\n"):
        in_line = words(line)
        if not in_line:
            good.append(line)
            continue
        n_lines += 1
        n_dup += line in seen
        seen.add(line)
        if bad_line(line, in_line, rules):
            n_bad += 1
            lost += len(line) - sum(line.count(c) for c in BLANKS)
        else:
            good.append(line)
    failed = len(tokens) < rules.min_words or 100 * repeats > 100 * rules.max_repeat_share * len(tokens)
    kept = not failed and lost <= rules.max_lost * word_chars
    clean = "\n".join(good).strip("\n") if n_bad else text
    return len(tokens), word_chars, n_symbols, n_dup, repeats, n_lines, n_bad, lost, failed, kept, clean


def measured(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """doc_id with the measures, the verdict and the cleaned text of every row."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *MEASURES])
    return per_row(docs, ["doc_id", "text"], schema, lambda doc_id, text: (doc_id, *judge(text, rules)))


def cleaned(docs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """``docs`` without rejected rows and bad lines; columns and extra columns stay.

    n_chars, where there is one, follows the cleaned text.
    """
    import pyarrow as pa

    schema = docs.schema
    target = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            verdicts = [judge(t, rules) for t in batch.column("text").to_pylist()]
            keep = pa.array([v[-2] for v in verdicts], pa.bool_())
            text = pa.array([v[-1] for v in verdicts], target.field("text").type)
            columns = [text if f.name == "text" else batch.column(f.name) for f in target]
            yield pa.RecordBatch.from_arrays(columns, schema=target).filter(keep)

    out = docs.transform(map_arrow, run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
