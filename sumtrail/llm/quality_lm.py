"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

* Model: word 3-grams of the trusted texts, counted, estimated and asked in
  sharded joins, slice by slice (``word_lm``). Its tables grow with the trusted texts.
* Thresholds: a quantile of the perplexities per language of trusted texts the
  model has not seen: a fifth of them, by a hash of the text so that copies stay
  together. A language with fewer than ``least`` of these takes the quantile
  over all. Is there nothing to hold out, or nothing left to learn from, all
  trusted texts do both.

Perplexity is over all words of the whole text. Null texts and texts without
words have no perplexity and are not kept. A null language is a language of its
own. With no trusted text at all nothing can be judged: perplexities are null
and nothing is kept.

The model over characters below (``grams`` to ``scorer``) has a fixed size and
folds rare scripts together. ``classified`` does not use it.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm import word_lm
from sumtrail.llm.common import map_arrow, small
from sumtrail.session import release, written

SYMBOLS = 64


@dataclass(frozen=True)
class Model:
    """Length of the character n-grams, the quantile of trusted perplexities that still passes, and what is held out for it."""

    order: int = 4
    quantile: float = 0.99
    slack: float = 1.05
    chunk: int = 2_000_000
    broadcast_rows: int = 2_000_000
    folds: int = 5
    least: int = 20


MODEL = Model()


def _alphabet() -> np.ndarray:
    """Symbol of every character of the basic plane; others share the last class."""
    out = np.zeros(1 << 16, np.uint8)
    own = {c: 27 + k for k, c in enumerate(".,;:!?'\"()-/|#*$%&<>[]{}=_@+~")}
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isspace():
            out[cp] = 0
        elif c in own:
            out[cp] = own[c]
        elif c.isdigit():
            out[cp] = 57
        elif c.isalpha():
            plain = unicodedata.normalize("NFD", c)[0].lower()
            accented = cp >= 128 and "a" <= plain <= "z"
            # Accented letters: two more classes, so that languages stay apart.
            out[cp] = (58 + cp % 2) if accented else 1 + ord(plain) - 97 if "a" <= plain <= "z" else 60 + cp % 2
        else:
            out[cp] = 62
    return out


_ALPHABET = _alphabet()
_CAPITAL = np.array([chr(c).isupper() for c in range(1 << 16)])


def symbols(text: str) -> np.ndarray:
    """The text's symbols, with a space on either side; a capital after a capital is symbol 63."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    points = np.minimum(points, (1 << 16) - 1)
    out = _ALPHABET[points].astype(np.int64)
    capital = _CAPITAL[points]
    out[1:][capital[1:] & capital[:-1]] = 63
    return out


def grams(text: str, order: int) -> np.ndarray:
    """The n-grams of a text in order, as whole numbers."""
    s = symbols(text)
    n = len(s) - order + 1
    if n <= 0:
        return np.empty(0, np.int64)
    code = s[:n].copy()
    for k in range(1, order):
        code = code * SYMBOLS + s[k : k + n]
    return code


def counted(texts: DataFrame, model: Model = MODEL) -> DataFrame:
    """(gram, n) of all texts; sums of each task are shuffled by gram."""
    schema = T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        part: list[np.ndarray] = []

        def add() -> None:
            nonlocal codes, sums
            new, n = np.unique(np.concatenate([*part, np.empty(0, np.int64)]), return_counts=True)
            part.clear()
            codes, where = np.unique(np.concatenate([codes, new]), return_inverse=True)
            sums = np.bincount(where.reshape(-1), np.concatenate([sums, n]), len(codes)).astype(np.int64)

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    part.append(grams(text, model.order))
                    if len(part) >= 1_000 or len(part[-1]) >= model.chunk:
                        add()
        add()
        for at in range(0, len(codes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + 100_000]), pa.array(sums[at : at + 100_000])], names=["gram", "n"])

    return texts.select("text").transform(map_arrow, run, schema).groupBy("gram").agg(F.sum("n").alias("n"))


def _discounts(counts: DataFrame | tuple) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more, of a table or of how often 1 to 4 occur."""
    if isinstance(counts, DataFrame):
        c = [F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]
        counts = counts.agg(*[x.alias(f"n{k}") for k, x in enumerate(c)]).first()
    n1, n2, n3, n4 = (x or 0 for x in counts)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in ((d1, 1), (d2, 2), (d3, 3)))


def estimated(counts: DataFrame, model: Model = MODEL) -> list[DataFrame]:
    """Per order from 1: (gram, p, weight), p interpolated, weight that of the context in the next order.

    Orders below the highest count how many different symbols come before.
    ``weight`` belongs to the gram as a context: what is left for the lower order.
    """
    by_order = {model.order: counts}
    for k in range(model.order - 1, 0, -1):
        by_order[k] = written(
            by_order[k + 1].groupBy(F.pmod("gram", F.lit(SYMBOLS**k)).alias("gram")).agg(F.count("*").cast("long").alias("n")))
    out: list[DataFrame] = []
    weights = None
    lower = None
    for k in range(1, model.order + 1):
        d1, d2, d3 = _discounts(by_order[k])
        drop: Column = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        grams_ = by_order[k].withColumn("context", F.floor(F.col("gram") / SYMBOLS)).withColumn("drop", drop)
        contexts = grams_.groupBy("context").agg(F.sum("n").alias("total"), F.sum("drop").alias("dropped")).withColumn(
            "weight", F.col("dropped") / F.col("total"))
        joined = grams_.join(contexts, "context")
        if lower is None:
            below = F.lit(1.0 / SYMBOLS)
        else:
            joined = joined.withColumn("tail", F.pmod("gram", F.lit(SYMBOLS ** (k - 1)))).join(
                lower.select(F.col("gram").alias("tail"), F.col("p").alias("p_low")), "tail")
            below = F.col("p_low")
        lower = written(joined.select("gram", ((F.col("n") - F.col("drop")) / F.col("total") + F.col("weight") * below).alias("p")))
        weights = written(contexts.select("context", "weight"))
        out += [lower, weights]
    return out


@dataclass
class Scorer:
    """log2 of p for every n-gram of the highest order, seen or not."""

    order: int
    log2: np.ndarray

    def perplexity(self, text: str | None) -> tuple[int, float | None]:
        codes = grams(text or "", self.order) if text else np.empty(0, np.int64)
        if not len(codes) or not len(self.log2):
            return len(codes), None
        return len(codes), float(2.0 ** -self.log2[codes].mean(dtype=np.float64))


def scorer(tables: list[DataFrame], model: Model = MODEL) -> Scorer:
    """Fill the bounded table of all n-grams from the estimated tables of each order.

    What an order has not seen takes the lower order's p times the context's weight.
    """
    dense = np.full(1, 1.0 / SYMBOLS, np.float32)
    for k in range(1, model.order + 1):
        seen = tables[2 * k - 2].toArrow()
        weights = tables[2 * k - 1].toArrow()
        if k == 1 and not seen.num_rows:
            return Scorer(model.order, np.empty(0))
        rest = np.ones(SYMBOLS ** (k - 1), np.float32)
        rest[weights["context"].to_numpy()] = weights["weight"].to_numpy()
        low = np.full(SYMBOLS, 1.0 / SYMBOLS, np.float32) if k == 1 else dense
        # gram = context * 64 + symbol; its tail (without the first symbol) is gram modulo 64^(k-1).
        full = np.tile(low, SYMBOLS if k > 1 else 1).reshape(-1)
        full.reshape(-1, SYMBOLS)[:] *= rest[:, None]
        full[seen["gram"].to_numpy()] = seen["p"].to_numpy()
        dense = full
    return Scorer(model.order, np.log2(np.maximum(dense, np.float32(1e-12))))


def classified(docs: DataFrame, trusted_ids: DataFrame, model: Model = MODEL) -> DataFrame:
    """Judge every document against a model of the trusted ones.

    ``trusted_ids`` has the doc_id of trusted texts. Returns doc_id, lang,
    trusted, n_grams, perplexity, threshold and kept.
    """
    ids = small(written(trusted_ids.select(F.col("doc_id").alias("t")).where("t is not null").distinct()), model.broadcast_rows)
    rows = word_lm.described(docs)
    fold = F.pmod(F.xxhash64("text"), F.lit(model.folds)) == 0
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("t"), "left_semi").withColumn("out", fold)
    known = rows.join(ids, F.col("doc_id") == F.col("t"), "left_semi").withColumn("out", F.pmod("id", F.lit(model.folds)) == 0)
    sides = {r["out"]: r["n"] for r in known.where("some").groupBy("out").agg(F.sum("chars").alias("n")).collect()}
    learnt, chars = (texts.where("not out"), sides[False]) if len(sides) == 2 else (texts, sum(sides.values()))
    n = word_lm.slices(rows.agg(F.sum("chars").alias("n")).first()["n"] or 0, chars)
    pieces = word_lm.pieces(math.ceil(chars / n))
    estimates = word_lm.estimated([word_lm.counted(learnt, part=(k, n), parts=pieces) for k in range(n)], _discounts, pieces)
    found = written(word_lm.scored(docs, estimates, rows=rows))
    if estimates is not None:
        release(estimates.words)
    out = known.where("out") if len(sides) == 2 else known
    held = small(written(out.select(F.col("doc_id").alias("h")).distinct()), model.broadcast_rows)
    release(rows)
    result = found.join(ids, F.col("doc_id") == F.col("t"), "left").withColumn("trusted", F.col("t").isNotNull()).drop("t")
    trusted = found.where("perplexity is not null").join(held, F.col("doc_id") == F.col("h"), "left_semi")
    cut = F.percentile_approx("perplexity", model.quantile, 10_000)
    by_lang = written(trusted.groupBy("lang").agg(F.when(F.count("*") >= model.least, cut).alias("own")))
    overall = trusted.agg(cut.alias("all")).first()["all"]
    near = by_lang.withColumnRenamed("lang", "l")
    threshold = F.coalesce("own", F.lit(overall).cast("double")) * model.slack
    return (
        result.join(near, F.col("lang").eqNullSafe(F.col("l")), "left")
        .withColumn("threshold", threshold)
        .withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))
        .select("doc_id", "lang", "trusted", "n_grams", "perplexity", "threshold", "kept")
    )
