"""Interpolated modified Kneser-Ney model of word 3-grams, estimated and asked in slices and shards.

Words are runs of letters and digits, runs of marks, and single characters of
scripts written without spaces; each is a 64-bit hash, so no script is folded
into another. Every text has two starts before it and an end behind it.

* Slices: the middle word of a triple decides its slice. All counts that a triple
  needs (of itself, its two pairs and its middle word) lie in its slice, so slices
  are estimated and asked one after the other, and what one has shuffled is
  deleted before the next. Texts are read anew for each; there are as many slices
  as the share of the texts that is learnt from needs.
* Arrays: Spark moves arrays of hashes and counts, a row per block and group, and
  numpy adds, joins and looks up. Groups are ranges of hashes of pairs, words or
  n-grams, never of one word's triples, so that a frequent word spreads.
* Estimating: a first round counts for each slice how often single words follow
  and what the discounts need, and answers each group of triples what it asks of
  its words. In the second, triples are counted again, meet these answers where
  their last pair is and then the triples of their first pair.
* Asking: log2 of a triple's probability is a sum of values that belong to single
  n-grams: what its last word has, what the middle word and the first pair leave
  to lower orders, and corrections of the last pair and of the triple, 0 if not
  seen. So a document's sum needs no answer per n-gram: texts send their keys to
  shards by the top bits, where the values of a slice lie in buckets, and one
  number per document and shard comes back. Texts ask in chunks, by their hash.

Documents are told apart by a 64-bit hash of their text: sums and lengths of
copies are added up, which leaves their mean as it is.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow, ship
from sumtrail.session import release, shared_folder, written

#: Scripts without spaces between words, whose characters are words.
_ALONE = "฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_ALONE}]|[^\W{_ALONE}]+|[^\w\s]+")
START, END = 1, 2
#: Told apart by order, so that n-grams of different orders share one table.
_SALT = {1: 0, 2: 0x2545F4914F6CDD1D, 3: 0x5851F42D4C957F2D}


#: Told apart from the key of the same pair as a context.
_AS_PAIR = 0x14057B7EF767814F
#: Characters that are split at a time.
CACHED = 1 << 16
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Sizes:
    """Words of a block; characters of text behind a group, at most, and how many groups there should be; least characters of a
    slice or chunk; slices if all texts were learnt from; in how many rounds, slices times chunks of texts, all is asked."""

    block: int = 1_000_000
    shard_chars: int = 8_000_000
    groups: int = 24
    slice_chars: int = 4_000_000
    slices: int = 17
    asks: int = 15


SIZES = Sizes()


class _Hashes(dict):
    """Hash of every word met, forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        return h


def words(text: str | None, known: _Hashes) -> np.ndarray:
    """Hashes of a text's words between two starts and an end; empty without words."""
    found = _WORD.findall(text) if text else []
    return np.array([START, START, *[known[w] for w in found], END] if found else [], np.int64)


@cache
def _classes() -> np.ndarray:
    """Of every code point: 0 blank, 1 word, 2 mark, 3 and 4 word and mark that stand alone."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for k, pattern in ((1, r"\w+"), (2, r"[^\w\s]+")):
        for m in re.finditer(pattern, every):
            out[m.start() : m.end()] = k
    for m in re.finditer(f"[{_ALONE}]+", every):
        part = out[m.start() : m.end()]
        part[:] = np.where(part == 1, 3, np.where(part == 2, 4, 0))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    """The mixing of splitmix64, in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def split(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text's between two starts and an end, and their number per text.

    The words are those of :func:`words`; a hash is a polynomial of one number per
    character, read off running sums over all texts, and mixed.
    """
    texts = [t or "" for t in texts]
    # In groups that stay in the processor's cache.
    group = np.cumsum([len(t) for t in texts]) // CACHED
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    parts = [_split(texts[a:b]) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@cache
def _letters() -> np.ndarray:
    """A number for every code point."""
    return _mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 2^bits powers of a number, and those of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C13
    out = [np.full(1 << bits, x, np.uint64) for x in (base, pow(base, -1, 1 << 64))]
    for x in out:
        x[0] = 1
        np.multiply.accumulate(x, out=x)
    return out[0], out[1]


def _split(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.zeros(len(texts), np.int64)
    every = "\n".join([*texts, ""])
    points = np.frombuffer(every.encode(), np.uint8) if every.isascii() else np.frombuffer(every.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.empty(0, np.int64), sizes
    points = points.astype(np.intp)
    kind = np.take(_classes(), points, mode="clip")
    alone = kind == 4
    if alone.any():  # behind a mark these go on with its run
        place = np.arange(len(points))
        mark = np.maximum.accumulate(np.where(kind == 2, place, -1))
        kind[alone & (mark > np.maximum.accumulate(np.where((kind == 2) | alone, -1, place)))] = 2
    # Every text ends with a blank, and so every word before another place where something begins.
    begins = kind >= 3
    begins[0] = True
    begins[1:] |= kind[1:] != kind[:-1]
    begins = np.flatnonzero(begins)
    word = np.flatnonzero(kind[begins] > 0)
    if not len(word):
        return np.empty(0, np.int64), sizes
    starts, behind = begins[word], begins[word + 1]
    powers, inverse = _powers(max(len(points), CACHED).bit_length())
    sums = np.empty(len(points) + 1, np.uint64)
    sums[0] = 0
    letters = np.take(_letters(), points, mode="clip")
    letters *= inverse[: len(points)]
    np.cumsum(letters, out=sums[1:])
    hashes = _mixed((sums[behind] - sums[starts]) * powers[starts]).view(np.int64)
    found = np.diff(np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
    sizes = np.where(found > 0, found + 3, 0)
    out = np.full(sizes.sum(), START, np.int64)
    ends = np.cumsum(sizes)[found > 0]
    words_ = np.ones(len(out), bool)
    words_[ends - 1] = False
    out[ends - 1] = END
    for k in (0, 1):
        words_[np.append(0, ends[:-1]) + k] = False
    out[words_] = hashes
    return out, sizes


def _turned(x: np.ndarray, k: int) -> np.ndarray:
    u = x.view(np.uint64)
    return ((u << np.uint64(k)) | (u >> np.uint64(64 - k)))


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _turned(a, 21) ^ b.view(np.uint64) ^ np.uint64(_SALT[2])


def triple_key(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return _turned(a, 42) ^ _turned(b, 21) ^ c.view(np.uint64) ^ np.uint64(_SALT[3])


def range_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64 bits each key lies in."""
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def slice_of(word: np.ndarray, slices: int) -> np.ndarray:
    """By the lower bits, so that a slice has words of all ranges."""
    return ((word.view(np.uint64) & np.uint64(0xFFFFFFFF)) * np.uint64(slices)) >> np.uint64(32)


def middles(flat: np.ndarray, sizes: np.ndarray, part: tuple[int, int]) -> np.ndarray:
    """Where the triples of texts begin whose middle word is in one slice of so many."""
    if len(flat) < 3:
        return np.empty(0, np.int64)
    first, behind = (-(-(k << 32) // part[1]) for k in (part[0], part[0] + 1))
    own = flat.view("<u4")[2:-2:2] - np.uint32(first) <= np.uint32(behind - first - 1)
    ends = np.cumsum(sizes)[sizes > 0][:-1]
    own[ends - 1] = own[ends - 2] = False
    return np.flatnonzero(own)


def triples(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where the triples of texts begin."""
    begins = np.ones(len(flat), bool)
    ends = np.cumsum(sizes)[sizes > 0]
    begins[ends - 1] = begins[ends - 2] = False
    return np.flatnonzero(begins)


def pieces(chars: int, sizes: Sizes = SIZES) -> int:
    """Into how many groups what comes of so much text is dealt: some for all cores, and none too large."""
    return max(1, min(sizes.groups, math.ceil(chars * sizes.groups / sizes.shard_chars)), math.ceil(chars / sizes.shard_chars))


def slices(chars: int, learnt: int, sizes: Sizes = SIZES) -> int:
    """How many slices the model is estimated and asked in: by the share of the characters it learns from."""
    return max(1, min(math.ceil(chars / sizes.slice_chars), math.ceil(sizes.slices * min(1.0, learnt / max(1, chars)))))


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _dealt(group: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Each group that occurs, and its part of every column, in the order there was."""
    order = np.argsort(group.astype(np.uint16 if n <= 1 << 16 else np.int64), kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(group.astype(np.int64), minlength=n)))
    columns = [c[order] for c in columns]
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        yield k, [c[cuts[k] : cuts[k + 1]] for c in columns]


def _fields(numbers: tuple[str, ...], blobs: tuple[str, ...]) -> T.StructType:
    return T.StructType([*[T.StructField(c, T.LongType()) for c in numbers], *[T.StructField(c, T.BinaryType()) for c in blobs]])


def _batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    """Rows of numbers and arrays; arrays become their bytes."""
    cells = [[x.tobytes() if isinstance(x, np.ndarray) else x for x in r] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in cells], f.type) for k, f in enumerate(target)], schema=target)


def _table(rows: list[tuple], target: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([_batch(rows, target)], schema=target)


def _read(rows: pa.Table, column: str, kind: type) -> np.ndarray:
    """The arrays of all rows of a column, one behind the other."""
    blobs = [x for x in rows[column].to_pylist() if x is not None]
    return np.frombuffer(blobs[0] if len(blobs) == 1 else b"".join(blobs), kind)


_TRIPLES = _fields(("part",), ("w1", "w2", "w3", "n"))
_TIMES = tuple(f"{c}{k}" for c in "tp" for k in (1, 2, 3, 4))
_WORDS = _fields(("shard", "part", *_TIMES), ("last", "times", "middle", "sums"))
_ONES = _fields(("n1", "n2", "n3", "n4", "total", "words", "ends", *_TIMES), ())
_ANSWERS = _fields(("shard", "part"), ("a", "b", "c"))
_CONTEXTS = _fields(("shard",), ("contexts", "triples", "times", "p2", "grams", "values"))
_VALUES = _fields(("shard",), ("grams", "values"))
_QUESTIONS = _fields(("shard",), ("texts", "sizes", "grams", "lengths"))


def counted(texts: DataFrame, sizes: Sizes = SIZES, part: tuple[int, int] = (0, 1), parts: int = 1) -> DataFrame:
    """The word triples of the texts in one slice of so many, as arrays by parts; blocks of a task are summed before the shuffle.

    A part holds all triples of its pairs (w2, w3), and belongs to one slice: its number modulo the slices.
    """
    target = arrow_schema(_TRIPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def summed() -> pa.RecordBatch:
            every = np.concatenate(held, axis=1)
            held.clear()
            key = triple_key(*every)
            order = np.argsort(key)
            at = _begins(key[order])
            n = np.diff(np.append(at, len(order))).astype(np.uint32)
            w1, w2, w3 = every[:, order[at]]
            return _batch([(k * part[1] + part[0], *c) for k, c in _dealt(range_of(pair_key(w2, w3), parts), parts, w1, w2, w3, n)], target)

        size = 0
        for batch in batches:
            flat, lengths = split(batch.column("text").to_pylist())
            at = middles(flat, lengths, part)
            held.append(np.stack([flat[at], flat[at + 1], flat[at + 2]]))
            size += len(at)
            if size >= sizes.block:
                yield summed()
                size = 0
        if size:
            yield summed()

    return map_arrow(texts.select("text"), run, _TRIPLES)


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Inside, what a finished job has shuffled is deleted at once."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@dataclass
class Model:
    """The counts of each slice, not computed yet, the discounts of order 3, what parts ask of their words and words add, p of a word never seen, what an end adds."""

    counts: list[DataFrame]
    two: tuple[float, float, float]
    three: tuple[float, float, float]
    words: DataFrame
    unseen: float
    end: float
    pieces: int


def _drop(n: np.ndarray, discounts: tuple[float, float, float]) -> np.ndarray:
    return np.array(discounts)[np.minimum(n, 3) - 1]


def _merged(rows: pa.Table) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of a part: its triples with their counts, and its pairs with how many different words stand before them and how many triples they have."""
    w1, w2, w3 = (_read(rows, c, np.int64) for c in ("w1", "w2", "w3"))
    n = _read(rows, "n", np.uint32)
    pair = pair_key(w2, w3)
    order = np.lexsort((w1, pair))
    at = _begins(pair[order], w1[order])
    n = np.add.reduceat(n[order].astype(np.int64), at)
    order = order[at]
    w1, w2, w3, pair = w1[order], w2[order], w3[order], pair[order]
    at = _begins(pair)
    size = np.diff(np.append(at, len(pair)))
    # A pair at the start of a text has only one possible word before it: its own count is kept.
    before = np.where(w2[at] == START, np.add.reduceat(n, at), size)
    return (w1, w2, w3, n), (w2[at], w3[at], before, size)


def _times(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, 5), minlength=6)[1:5].tolist()


def _words(pairs: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The last words and the middle words of pairs in order, each with the place of every pair's."""
    return *np.unique(pairs[1].view(np.uint64), return_inverse=True), *np.unique(pairs[0].view(np.uint64), return_inverse=True)


def _asking(n: int):
    """What a part knows of its words, for each of n ranges of words: times as the last of a pair; as the first, sums for context."""
    target = arrow_schema(_WORDS)

    def run(rows: pa.Table) -> pa.Table:
        (*_, times), pairs = _merged(rows)
        before = pairs[2]
        last, to_last, middle, to_middle = _words(pairs)
        ends = np.bincount(to_last, minlength=len(last))
        sums = [np.bincount(to_middle, x, len(middle)).astype(np.int64) for x in (before, before == 1, before == 2, before >= 3)]
        found, more = [], _times(times) + _times(before)
        cuts = [np.searchsorted(range_of(x, n), np.arange(n + 1, dtype=np.uint64)) for x in (last, middle)]
        for k in range(n):
            (a, b), (c, d) = ((x[k], x[k + 1]) for x in cuts)
            if a < b or c < d:
                found.append((k, rows["part"][0].as_py(), *more, last[a:b], ends[a:b], middle[c:d], np.stack([x[c:d] for x in sums], axis=1)))
                more = [0] * len(more)
        return _table(found, target)

    return run


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys in order, the rows of n added up by key, and where each key given is."""
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.stack([np.bincount(at, x, len(keys)) for x in n.T], axis=1).astype(np.int64), at


def _counting(rows: pa.Table) -> pa.Table:
    words_, n, _ = _added(_read(rows, "last", np.uint64), _read(rows, "times", np.int64).reshape(-1, 1))
    n = n[:, 0]
    return _table([(*_times(n), int(n.sum()), len(n), int(n[words_ == END].sum()), *[sum(rows[c].to_pylist()) for c in _TIMES])], arrow_schema(_ONES))


def _answering(one: tuple, two: tuple, total: int, unseen: float):
    """Of a range of words: p, sum and weight for each part that asked, and what single words add to log2 of a probability."""
    target = arrow_schema(_ANSWERS)

    def run(rows: pa.Table) -> pa.Table:
        last, n, to_last = _added(_read(rows, "last", np.uint64), _read(rows, "times", np.int64).reshape(-1, 1))
        middle, sums, to_middle = _added(_read(rows, "middle", np.uint64), _read(rows, "sums", np.int64).reshape(-1, 4))
        p = (n[:, 0] - _drop(n[:, 0], one)) / total + unseen
        weight = sums[:, 1:] @ np.array(two) / sums[:, 0]
        shard, found, a, c = rows["shard"][0].as_py(), [], 0, 0
        for part, x, y in zip(*(rows[k].to_pylist() for k in ("part", "last", "middle"))):
            b, d = a + len(x) // 8, c + len(y) // 8
            found.append((shard, part, p[to_last[a:b]], sums[to_middle[c:d], 0], weight[to_middle[c:d]]))
            a, c = b, d
        grams, to = np.unique(np.concatenate([last, middle]), return_inverse=True)
        values = np.bincount(to, np.concatenate([np.log2(p) - math.log2(unseen), np.log2(weight)]), len(grams))
        return _table([*found, (shard, None, grams, values, None)], target)

    return run


def estimated(counts: DataFrame | list[DataFrame], discounts, pieces: int = 1) -> Model | None:
    """The model of counts, or of the counts of all slices in order; None without any text.

    ``discounts`` gives those of the numbers of n-grams counted 1 to 4 times;
    ``pieces`` is how many groups words and triples are dealt to.
    """
    counts = counts if isinstance(counts, list) else [counts]
    with _cleaned(counts[0].sparkSession):
        parts = [written(c.groupBy("part").applyInArrow(_asking(pieces), _WORDS)) for c in counts]
        every = reduce(DataFrame.union, parts)
        ones = every.groupBy("shard").applyInArrow(_counting, _ONES)
        n = ones.agg(*[F.sum(c).alias(c) for c in ones.columns]).first()
        if not n["words"]:
            return None
        one, two, three = (discounts(tuple(n[f"{c}{k}"] for k in (1, 2, 3, 4))) for c in "npt")
        dropped = n["n1"] * one[0] + n["n2"] * one[1] + (n["words"] - n["n1"] - n["n2"]) * one[2]
        unseen = dropped / n["total"] / (n["words"] + 1)
        words_ = written(every.groupBy("shard").applyInArrow(_answering(one, two, n["total"], unseen), _ANSWERS))
        for part in parts:
            release(part)
    end = (n["ends"] - one[min(n["ends"], 3) - 1]) / n["total"] + unseen
    return Model(counts, two, three, words_, unseen, math.log2(end) - math.log2(unseen), pieces)


def _interpolating(model: Model):
    """Triples of a part with p of their last pair, by ranges of their first, and what last pairs add to log2 of a probability."""
    target, n, two = arrow_schema(_CONTEXTS), model.pieces, model.two

    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return target.empty_table()
        (w1, w2, w3, times), pairs = _merged(rows)
        answers = answers.sort_by("shard")
        last, to_last, middle, to_middle = _words(pairs)
        p, total, weight = _read(answers, "a", np.float64), _read(answers, "b", np.int64), _read(answers, "c", np.float64)
        assert len(p) == len(last) and len(total) == len(middle)
        rest = weight[to_middle] * p[to_last]
        p2 = (pairs[2] - _drop(pairs[2], two)) / total[to_middle] + rest
        context, gram = pair_key(w1, w2), pair_key(pairs[0], pairs[1]) ^ np.uint64(_AS_PAIR)
        found = {k: [*c, None, None] for k, c in _dealt(
            range_of(context, n), n, context, triple_key(w1, w2, w3), times, np.repeat(p2, pairs[3]))}
        for k, c in _dealt(range_of(gram, n), n, gram, np.log2(p2) - np.log2(rest)):
            found.setdefault(k, [None] * 6)[4:] = c
        return _table([(k, *c) for k, c in found.items()], target)

    return run


def _valuing(three: tuple, shards: int):
    """What triples and first pairs of a range add, and what it was told of last pairs, by shards of n-grams."""
    target = arrow_schema(_VALUES)

    def run(rows: pa.Table) -> pa.Table:
        context, grams, p2 = _read(rows, "contexts", np.uint64), _read(rows, "triples", np.uint64), _read(rows, "p2", np.float64)
        n = _read(rows, "times", np.int64)
        order = np.argsort(context)
        context, grams, n, p2 = context[order], grams[order], n[order], p2[order]
        at = _begins(context)
        total, drop = np.empty(0, np.int64), _drop(n, three)
        weight = np.empty(0)
        if len(at):
            total = np.add.reduceat(n, at)
            weight = np.add.reduceat(drop, at) / total
        size = np.diff(np.append(at, len(context)))
        rest = np.repeat(weight, size) * p2
        values = np.log2((n - drop) / np.repeat(total, size) + rest) - np.log2(rest)
        grams = np.concatenate([grams, context[at], _read(rows, "grams", np.uint64)])
        values = np.concatenate([values, np.log2(weight), _read(rows, "values", np.float64)])
        return _table([(k, *c) for k, c in _dealt(range_of(grams, shards), shards, grams, values)], target)

    return run


def valued(model: Model, part: tuple[int, int], shards: int) -> tuple[DataFrame, str]:
    """What the n-grams of a slice add to log2 of a probability, by shards, and the name of its table."""
    target = arrow_schema(_VALUES)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                grams, values = np.frombuffer(a, np.uint64), np.frombuffer(b, np.float64)
                own = slice_of(grams, part[1]) == part[0]
                yield _batch([(k, *c) for k, c in _dealt(range_of(grams[own], shards), shards, grams[own], values[own])], target)

    spark = model.words.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    answers = model.words.where((F.col("part") % part[1]) == part[0])
    three = model.counts[part[0]].groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_interpolating(model), _CONTEXTS)
    # Written, so that what brought the triples together is deleted before their values are shuffled.
    contexts, name = _bucketed(three.repartition(max(model.pieces, least), "shard"), max(model.pieces, least))
    every = contexts.groupBy("shard").applyInArrow(_valuing(model.three, shards), _VALUES).union(
        map_arrow(model.words.where("part is null").select("a", "b"), single, _VALUES))
    buckets = max(shards, least)
    out = _bucketed(every.repartition(buckets, "shard").groupBy("shard").applyInArrow(_ordered, _VALUES), buckets)
    _dropped(spark, name)
    return out


def asked(docs: DataFrame, shards: int, part: tuple[int, int], sizes: Sizes = SIZES) -> DataFrame:
    """The questions of a slice, one row per block and shard: texts by their hash, how many n-grams each has there, the n-grams.

    One row more per block has how many triples of the slice its texts have.
    """
    target = arrow_schema(_QUESTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []

        def questions() -> pa.RecordBatch:
            a, b, c, owner = (np.concatenate(x) for x in zip(*held))
            ids = np.concatenate(texts)
            held.clear()
            texts.clear()
            grams = np.empty((len(a), 4), np.uint64)
            grams[:, 0], grams[:, 1] = triple_key(a, b, c), pair_key(b, c) ^ np.uint64(_AS_PAIR)
            grams[:, 2], grams[:, 3] = pair_key(a, b), b.view(np.uint64)
            grams = grams.reshape(-1)
            rows = []
            for k, (own, ask) in _dealt(range_of(grams, shards), shards, np.repeat(owner, 4), grams):
                at = _begins(own)
                rows.append((k, ids[own[at]], np.diff(np.append(at, len(own))).astype(np.uint32), ask, None))
            lengths = np.bincount(owner, minlength=len(ids))
            some = np.flatnonzero(lengths)
            if len(some):
                rows.append((int(ids[some[0]]) % shards, ids[some], np.zeros(len(some), np.uint32), None, lengths[some]))
            return _batch(rows, target)

        size = n = 0
        for batch in batches:
            flat, lengths = split(batch.column("text").to_pylist())
            owner = np.repeat(np.arange(n, n + len(lengths), dtype=np.int32), lengths)
            at = middles(flat, lengths, part)
            held.append((flat[at], flat[at + 1], flat[at + 2], owner[at]))
            texts.append(batch.column("id").to_numpy())
            n += len(lengths)
            size += len(at)
            if size >= sizes.block:
                yield questions()
                size = n = 0
        if held:
            yield questions()

    return map_arrow(docs.select("id", "text"), run, _QUESTIONS)


def _ordered(rows: pa.Table) -> pa.Table:
    """The n-grams of a shard in order, and one more, so that there is always a next one."""
    grams, values = _read(rows, "grams", np.uint64), _read(rows, "values", np.float64)
    order = np.argsort(grams)
    last = np.uint64(0xFFFFFFFFFFFFFFFF), 0.0
    return _table([(rows["shard"][0].as_py(), np.append(grams[order], last[0]), np.append(values[order], last[1]))], arrow_schema(_VALUES))


def found(grams: np.ndarray, values: np.ndarray, ask: np.ndarray, shards: int) -> np.ndarray:
    """The values of the n-grams asked for, 0 for others; ``grams``, of one of so many shards, are in order with one more behind."""
    if not len(grams):
        return np.zeros(len(ask))
    bits = min(32, len(grams).bit_length())

    def place(keys: np.ndarray) -> np.ndarray:
        return ((((keys >> np.uint64(32)) * np.uint64(shards)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).view(np.int64)

    begins = np.cumsum(np.bincount(place(grams[:-1]) + 1, minlength=(1 << bits) + 1))
    at = begins[place(ask)]
    there = grams[at]
    out = np.where(there == ask, values[at], 0.0)
    left = np.flatnonzero(there < ask)
    while len(left):
        at[left] += 1
        there = grams[at[left]]
        hit = left[there == ask[left]]
        out[hit] = values[at[hit]]
        left = left[there < ask[left]]
    return out


def _sums(docs: DataFrame, values: DataFrame, shards: int, part: tuple[int, int], sizes: Sizes) -> DataFrame:
    """(id, total, n): the values of one slice added up for each text, and its triples there."""
    answer = T.StructType([T.StructField("id", T.LongType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    target = arrow_schema(answer)

    def met(questions: pa.Table, shard: pa.Table) -> pa.Table:
        ask = _read(questions, "grams", np.uint64)
        got = found(_read(shard, "grams", np.uint64), _read(shard, "values", np.float64), ask, shards)
        ids, counts = _read(questions, "texts", np.int64), _read(questions, "sizes", np.uint32)
        totals = np.bincount(np.repeat(np.arange(len(ids)), counts), got, len(ids))
        lengths = [np.zeros(len(x) // 8, np.int64) if y is None else np.frombuffer(y, np.int64)
                   for x, y in zip(questions["texts"].to_pylist(), questions["lengths"].to_pylist())]
        ids, to = np.unique(ids, return_inverse=True)
        return pa.Table.from_arrays([
            pa.array(ids), pa.array(np.bincount(to, totals, len(ids)) * 1.0),
            pa.array(np.bincount(to, np.concatenate([np.empty(0, np.int64), *lengths]), len(ids)).astype(np.int64))], schema=target)

    rows = asked(docs, shards, part, sizes).groupBy("shard").cogroup(values.groupBy("shard")).applyInArrow(met, answer)
    return written(rows.groupBy("id").agg(F.sum("total").alias("total"), F.sum("n").alias("n")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the hash of the text and n_grams of every row."""
    rows = docs.select("doc_id", "lang", F.xxhash64("text").alias("id"), "text")
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in ("doc_id", "lang", "id")] + [T.StructField("n_grams", T.LongType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, lengths = split(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "id")), pa.array(np.maximum(lengths - 2, 0))], schema=target)

    return map_arrow(rows, run, schema)


def described(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the hash of the text, its characters and whether any is not a space, of every row, written."""
    return written(docs.select(
        "doc_id", "lang", F.xxhash64("text").alias("id"), F.length("text").alias("chars"), (F.trim("text") != "").alias("some")))


def scored(docs: DataFrame, model: Model | None, sizes: Sizes = SIZES, rows: DataFrame | None = None) -> DataFrame:
    """doc_id, lang, n_grams, perplexity of every row; ``rows`` are the documents ``described``."""
    if model is None:
        return sized(docs).select("doc_id", "lang", "n_grams", F.lit(None).cast("double").alias("perplexity"))
    ship(docs.sparkSession)
    spark, n = docs.sparkSession, len(model.counts)
    rows = described(docs) if rows is None else rows
    chars = rows.agg(F.sum("chars").alias("n")).first()["n"] or 0
    chunks = max(1, min(math.ceil(sizes.asks / n), math.ceil(chars / n / sizes.slice_chars)))
    shards = pieces(math.ceil(chars / n / chunks), sizes)
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("id"), "text")
    totals = []
    with _cleaned(spark):
        for k in range(n):
            values, name = valued(model, (k, n), shards)
            for chunk in range(chunks):
                part = texts.where(F.pmod("id", F.lit(chunks)) == chunk) if chunks > 1 else texts
                totals.append(_sums(part, values, shards, (k, n), sizes))
            _dropped(spark, name)
        # Of copies, sums and lengths are added up.
        copies = rows.where("chars is not null").select("id", F.lit(0.0), F.lit(0), F.lit(1))
        added = reduce(DataFrame.union, [t.withColumn("copies", F.lit(0)) for t in totals] + [copies])
        sums = written(added.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("total", "n", "copies")]))
        for t in totals:
            release(t)
    level = math.log2(model.unseen)
    mean = (F.col("total") + F.col("copies") * model.end) / F.col("n")
    return rows.select("doc_id", "lang", "id").join(sums, "id", "left").select(
        "doc_id", "lang", F.expr("coalesce(n div copies, 0)").alias("n_grams"),
        F.when(F.col("n") > 0, F.pow(F.lit(2.0), -(mean + level))).alias("perplexity"))


def _bucketed(df: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """``df``, dealt by shard already, in the shared folder in as many buckets, and the name of the table: it is not shuffled again."""
    spark = df.sparkSession
    name = f"word_lm_{uuid.uuid4().hex}"
    (df.write.bucketBy(buckets, "shard").format("parquet")
     .option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name))
    return spark.table(name), name


def _dropped(spark: SparkSession, name: str) -> None:
    """Forget the table and delete its files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
