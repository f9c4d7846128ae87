"""Lines that several documents share: only the first document keeps them.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased.
Keys of ``MIN_CHARS`` code points or more that two documents hold lose their
lines everywhere but in the smallest doc_id that holds them.

1. Blocks of documents write the digests of their keys, once per document, with
   no text: some 20 bytes a line.
2. Two Bloom filters, for hashes seen once and seen twice, are cut into shards
   by the first bits of the hash. Each block sends each shard the filter
   positions of its keys and which of them it holds twice itself; a shard sets a
   position in the second filter when another block has set it in the first.
   What goes back is one bit a key: all its positions are in the second filter.
3. Keys with that bit are suspected repeats. They alone are shuffled by digest;
   least and largest doc_id confirm a repeat and name its first document.
4. Documents meet the list of their own lost keys, and drop those lines.

A shard holds a bounded number of hashes and a block a bounded number of lines,
whatever the size of the corpus, and nothing is broadcast. A line in a third of
all documents is one position per block, and one partial minimum per task.
Digests have 128 bits.

A null text stays null and counts as one empty line; an empty text is one empty
line. Repeated lines of one document are no repeat. Rows that share a doc_id are
one document. Rows without doc_id keep all lines and repeat nobody's. Extra
columns stay, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow, ship
from sumtrail.session import written

MIN_CHARS = 10
#: Most keys of a block (one document more or less) and, about, of a shard.
BLOCK, SHARD = 1 << 18, 1 << 20
#: Least number of shards, and bits of each filter per key.
LEAST_SHARDS, BITS = 64, 16

_ENDS = b" \t\n\x0b\x0c\r"


def digest(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """16 bytes that stand for the line's key; None if the key is too short to count."""
    key = line.strip(_ENDS).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return blake2b(key, digest_size=16).digest()


def digests(text: str | None, min_chars: int = MIN_CHARS) -> set[bytes]:
    found = {digest(line, min_chars) for line in set((text or "").encode("utf-8", "surrogatepass").split(b"\n"))}
    found.discard(None)
    return found


def stripped(text: str | None, lost: set[bytes], min_chars: int = MIN_CHARS) -> tuple[str | None, int, int]:
    """The text without the lines whose keys are ``lost``; lines before, lines dropped."""
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    if not lost:
        return text, len(lines), 0
    kept = [line for line in lines if digest(line, min_chars) not in lost]
    return b"\n".join(kept).decode("utf-8", "surrogatepass"), len(lines), len(lines) - len(kept)


# -- blocks -------------------------------------------------------------------


def blocks(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per block: ids of its documents, digests in order with the index of their document, distinct digests."""
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("digests", T.BinaryType()),
        T.StructField("owners", T.BinaryType()), T.StructField("n", T.LongType())])
    target = arrow_schema(schema)

    def closed(number: int, ids: list, held: list[bytes], sizes: list[int]) -> pa.RecordBatch:
        owners = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        pairs = np.frombuffer(b"".join(held), ">u8").reshape(-1, 2)
        order = np.lexsort((owners, pairs[:, 1], pairs[:, 0]))
        pairs, owners = pairs[order], owners[order]
        values = [[number], [ids], [pairs.tobytes()], [owners.tobytes()], [int(first_of_run(pairs).sum())]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, held, sizes = [], [], []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                own = digests(text.as_py(), min_chars)
                if own:
                    ids.append(doc_id)
                    held += own
                    sizes.append(len(own))
                if len(held) >= BLOCK:
                    yield closed(number, ids, held, sizes)
                    number, ids, held, sizes = number + 1, [], [], []
        if held:
            yield closed(number, ids, held, sizes)

    return map_arrow(docs.where("doc_id is not null").select("doc_id", "text"), run, schema)


def first_of_run(pairs: np.ndarray) -> np.ndarray:
    """True at the first of equal digests; ``pairs`` is in order."""
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]).any(axis=1)
    return new


def shards_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    """Start of every shard's part of ``pairs``, and the end."""
    cuts = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(pairs[:, 0].astype(np.uint64), cuts), [len(pairs)]]).astype(np.int64)


# -- filters ------------------------------------------------------------------


def sizes(n: int) -> tuple[int, int]:
    """Number of shards and positions of a filter in each, powers of two, for ``n`` keys."""
    shards = max(LEAST_SHARDS, 1 << math.ceil(math.log2(max(1, n / SHARD))))
    return shards, 1 << math.ceil(math.log2(max(1024, BITS * n / shards)))


_ASKED = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType()),
    T.StructField("places", T.BinaryType()), T.StructField("twice", T.BinaryType())])
_FLAGS = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("flags", T.BinaryType())])


def asked(blocks: DataFrame, shards: int, width: int) -> DataFrame:
    """For each block and shard: two filter positions for every key, and whether the block itself holds the key twice."""
    target = arrow_schema(_ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, raw in zip(batch.column("block").to_pylist(), batch.column("digests")):
                pairs = np.frombuffer(raw.as_py(), ">u8").reshape(-1, 2)
                starts = np.flatnonzero(first_of_run(pairs))
                twice = np.diff(np.append(starts, len(pairs))) > 1
                pairs = pairs[starts]
                # The shard takes the first bits; positions come from the last bits of both halves.
                places = (pairs & np.uint64(width - 1)).astype(np.uint32)
                edges = shards_of(pairs, shards)
                full = np.flatnonzero(np.diff(edges)).tolist()
                cut = [slice(edges[s], edges[s + 1]) for s in full]
                values = [[number] * len(full), full, [places[c].tobytes() for c in cut], [np.packbits(twice[c]).tobytes() for c in cut]]
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, target)], schema=target)

    return map_arrow(blocks.select("block", "digests"), run, _ASKED)


def suspicions(asked: DataFrame, width: int) -> DataFrame:
    """One bit for every key of a block and shard: the second filter has all its positions."""
    ship(asked.sparkSession)
    target = arrow_schema(_FLAGS)

    def shard(table: pa.Table) -> pa.Table:
        once, twice = np.zeros(width, bool), np.zeros(width, bool)
        rows = [np.frombuffer(p.as_py(), np.uint32).reshape(-1, 2) for p in table["places"]]
        for places, bits in zip(rows, table["twice"]):
            own = np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(places)).astype(bool)
            twice[places[once[places]]] = True
            twice[places[own].ravel()] = True
            once[places.ravel()] = True
        flags = [np.packbits(twice[p].all(axis=1)).tobytes() for p in rows]
        return pa.Table.from_arrays([table["block"], table["shard"], pa.array(flags, pa.binary())], schema=target)

    return asked.groupBy("shard").applyInArrow(shard, _FLAGS)


def suspects(blocks: DataFrame, flags: DataFrame, shards: int) -> DataFrame:
    """(doc_id, digest) of every key that may be a repeat."""
    schema = T.StructType([T.StructField("doc_id", blocks.schema["ids"].dataType.elementType), T.StructField("digest", T.BinaryType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, raw, owners, flags in zip(*(batch.column(c) for c in ("ids", "digests", "owners", "flags"))):
                pairs = np.frombuffer(raw.as_py(), ">u8").reshape(-1, 2)
                new = first_of_run(pairs)
                counts = np.diff(shards_of(pairs[new], shards))
                bits = [np.unpackbits(np.frombuffer(f["flags"], np.uint8), count=counts[f["shard"]]) for f in flags.as_py()]
                hit = np.flatnonzero(np.concatenate(bits)[np.cumsum(new) - 1])
                owner = np.frombuffer(owners.as_py(), np.int32)[hit]
                values = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(hit), [None, pa.py_buffer(pairs[hit].tobytes())])
                yield pa.RecordBatch.from_arrays([ids.values.take(pa.array(owner)).cast(target[0].type), values.cast(pa.binary())], schema=target)

    answers = flags.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "flags"))).alias("flags"))
    return map_arrow(blocks.join(answers, "block").select("ids", "digests", "owners", "flags"), run, schema)


# -- result -------------------------------------------------------------------


def lost_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, lost): digests of the keys that a document loses to a smaller doc_id; documents that lose none are absent."""
    held = written(blocks(docs, min_chars))
    shards, width = sizes(held.agg(F.sum("n")).first()[0] or 0)
    seen = written(suspects(held, suspicions(asked(held, shards, width), width), shards))
    firsts = written(
        seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last").select("digest", "first"))
    return (
        seen.join(firsts, "digest").where("doc_id > first")
        .groupBy("doc_id").agg(F.collect_set("digest").alias("lost")))


def _applied(docs: DataFrame, schema: T.StructType, min_chars: int, finish) -> DataFrame:
    """``docs`` with their lost keys, through ``finish(batch, results)``; results are those of ``stripped``."""
    name = "lost"
    while name in docs.columns:
        name += "_"
    lost = lost_keys(docs, min_chars).withColumnRenamed("lost", name)
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [stripped(t.as_py(), set(lost or ()), min_chars) for t, lost in zip(batch.column("text"), batch.column(name).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(finish(batch, out), target)], schema=target)

    known = docs.where("doc_id is not null").join(lost.hint("shuffle_hash"), "doc_id", "left")
    nameless = docs.where("doc_id is null").withColumn(name, F.lit(None).cast("array<binary>"))
    return map_arrow(known.unionByName(nameless), run, schema)


def report(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines before dropping, n_dropped and the text that is left, of every row."""
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()), T.StructField("text", T.StringType())])
    return _applied(docs.select("doc_id", "text"), schema, min_chars, lambda batch, out: [
        batch.column("doc_id"), [n for _, n, _ in out], [d for _, _, d in out], [t for t, _, _ in out]])


def cleaned(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``; all other columns stay as they are."""
    columns = docs.columns
    return _applied(docs, docs.schema, min_chars, lambda batch, out: [
        [t for t, _, _ in out] if c == "text" else batch.column(c) for c in columns])
