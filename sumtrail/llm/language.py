"""Language identification with a string kernel.

The kernel of two texts compares which n-grams of 1 to 3 letters they hold,
however often: K(x, y) = common n-grams / sqrt(n-grams of x * n-grams of y).
Landmarks taken from the training texts turn it into vectors (Nyström): the
kernel values against all landmarks, multiplied by the inverse root of the
landmarks' own kernel matrix. One ridge regression per language separates it
from the rest. Predictions come in batches: presence matrix times landmark
matrix, divided by norms, times weights.

Letters are folded to 128 symbols by a fixed rule, so that the n-grams of a
text fit a bitmap of 128^3 cells, whole texts of any length included; anything
but a letter is a boundary, of which a run counts once.

The model is fitted on at most ``per_language`` training texts of each
language, the ones with the smallest hashes, and holds at most ``landmarks``
texts; all other work is row by row. Learning sees text and language only.

A null text, or one without a letter, gives ``und`` with score 0; so does every
text when there is nothing to learn from. Ties go to the language that sorts
first. Repeated rows get equal predictions; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow

BITS = 7
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    """Training texts per language, landmarks in all, ridge, and texts per matrix product."""

    per_language: int = 400
    landmarks: int = 256
    ridge: float = 1e-3
    batch: int = 512


SETTINGS = Settings()


def _symbols() -> np.ndarray:
    """Symbol of every character of the basic plane: 0 for what is no letter."""
    out = np.zeros(1 << 16, np.uint8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            if 97 <= low <= 122:
                out[cp] = low - 96
            elif 223 <= low <= 255:
                out[cp] = low - 196  # 27 to 59
            else:
                out[cp] = 60 + low % 68
    return out


_SYMBOLS = _symbols()


def present(text: str) -> np.ndarray:
    """The distinct 1-, 2- and 3-grams of a text, sorted, as whole numbers; empty without a letter."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    s = _SYMBOLS[np.minimum(points, (1 << 16) - 1)].astype(np.int32)
    if len(points) and points.max() >= 1 << 16:  # letters beyond the basic plane
        far = [k for k in np.flatnonzero(points >= 1 << 16) if chr(points[k]).isalpha()]
        s[far] = 60 + points[far].astype(np.int64) % 68
    if not s.any():
        return np.empty(0, np.int32)
    s = s[np.concatenate([[True], (s[1:] > 0) | (s[:-1] > 0)])]  # a run of boundaries counts once
    two = (s[:-1] << BITS) | s[1:]
    three = (two[:-1] << BITS) | s[2:]
    cells = np.zeros(1 << (3 * BITS), bool)
    # A boundary is symbol 0, so shorter n-grams are told apart by an offset below the longer ones' cells.
    cells[three] = True
    found = [np.flatnonzero(cells).astype(np.int32) + (1 << (2 * BITS + 1))]
    cells[three] = False
    cells[two] = True
    found.append(np.flatnonzero(cells[: 1 << (2 * BITS)]).astype(np.int32) + (1 << (BITS + 1)))
    found.append(np.unique(s).astype(np.int32))
    return np.concatenate(found[::-1])


@dataclass
class Model:
    languages: list[str]
    #: Distinct n-grams of all landmarks, sorted; per landmark a row of the matrix says which it holds.
    grams: np.ndarray
    matrix: np.ndarray
    norms: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        held = np.zeros((len(texts), len(self.grams)), np.float32)
        for row, found in zip(held, texts):
            at = np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)
            row[at[self.grams[at] == found]] = 1
        norms = np.sqrt(np.array([len(t) for t in texts], np.float32))
        return (held @ self.matrix.T) / (norms[:, None] * self.norms[None, :])

    def predict(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and a score from 0 to 1 for each text."""
        scores = self.kernel(texts) @ self.weights
        best = scores.argmax(axis=1)
        return best, np.clip((scores[np.arange(len(texts)), best] + 1) / 2, 0, 1)


def trained(rows: list[tuple[np.ndarray, str]], settings: Settings = SETTINGS) -> Model | None:
    """Nyström features of the rows' presence kernel, and one ridge regression per language."""
    rows = [r for r in rows if len(r[0])]
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    by_language = {k: [t for t, lang in rows if lang == k] for k in languages}
    share = max(1, settings.landmarks // len(languages))
    landmarks = [t for k in languages for t in by_language[k][:share]]
    grams = np.unique(np.concatenate(landmarks))
    matrix = np.zeros((len(landmarks), len(grams)), np.float32)
    for row, found in zip(matrix, landmarks):
        row[np.searchsorted(grams, found)] = 1
    norms = np.sqrt(np.array([len(t) for t in landmarks], np.float32))
    model = Model(languages, grams, matrix, norms, np.empty(0))
    values, vectors = np.linalg.eigh(model.kernel(landmarks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    squares, sums = np.zeros((good.sum(), good.sum())), np.zeros((good.sum(), len(languages)))
    for at in range(0, len(rows), settings.batch):
        part = rows[at : at + settings.batch]
        features = model.kernel([t for t, _ in part]) @ root
        signs = np.array([[1.0 if lang == k else -1.0 for k in languages] for _, lang in part])
        squares += features.T @ features
        sums += features.T @ signs
    ridge = settings.ridge * len(rows)
    model.weights = (root @ np.linalg.solve(squares + ridge * np.eye(len(squares)), sums)).astype(np.float32)
    return model


def fit(labelled: DataFrame, settings: Settings = SETTINGS) -> Model | None:
    """Learn from ``labelled`` (text, lang), rows without a language left out.

    Hashes choose the texts first, so that only chosen texts are brought together.
    """
    known = labelled.where("lang is not null and text is not null").select("text", "lang", F.xxhash64("text").alias("hash"))
    least = Window.partitionBy("lang").orderBy("hash")
    # The limit of a rank is taken before the shuffle: a language sends few hashes per task.
    cut = (
        known.select("lang", "hash").distinct().withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= settings.per_language)
        .groupBy("lang").agg(F.max("hash").alias("cut"))
    )
    schema = T.StructType([T.StructField("grams", T.ArrayType(T.IntegerType())), T.StructField("lang", T.StringType()),
                           T.StructField("hash", T.LongType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [present(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, target.field("grams").type), batch.column("lang"), batch.column("hash")], schema=target)

    cuts = {r["lang"]: r["cut"] for r in cut.collect()}  # one row per language
    if not cuts:
        return None
    limit: Column = F.element_at(F.create_map(*[F.lit(x) for kv in cuts.items() for x in kv]), F.col("lang"))
    chosen = known.where(F.col("hash") <= limit).dropDuplicates(["lang", "hash"]).transform(map_arrow, run, schema)
    rows = sorted(((r["lang"], r["hash"], r["grams"]) for r in chosen.collect()), key=lambda r: r[:2])
    return trained([(np.array(g, np.int32), lang) for lang, _, g in rows], settings)


def identified(docs: DataFrame, model: Model | None, settings: Settings = SETTINGS) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, settings.batch):
                part = batch.slice(at, settings.batch)
                found = [present(t or "") for t in part.column("text").to_pylist()]
                langs, scores = [UNKNOWN] * len(found), [0.0] * len(found)
                usable = [k for k, f in enumerate(found) if len(f)] if m else []
                if usable:
                    best, score = m.predict([found[k] for k in usable])
                    for k, b, s in zip(usable, best, score):
                        langs[k], scores[k] = m.languages[b], float(s)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=target)

    return docs.select("doc_id", "text").transform(map_arrow, run, schema)
