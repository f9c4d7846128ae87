"""Records that span lines, read from text files that are split between tasks.

Spark cuts a large text file into splits at line ends, but whether a line starts
a record depends on all the text before it: a quote may be open, or brackets. A
scanner is a small automaton over lines (pieces between separators) that knows
two modes, in quotes or not, and counts open brackets.

1. Each split reports, for either mode it might start in, the mode it ends in and
   the change of depth: one row per split.
2. Windows over the splits of a file compose these: a split's starting mode is
   that of the last split that ends in one mode whatever it started in, swapped
   by the splits since that swap the mode. Depth is a running sum.
3. Knowing how it starts, each split writes its whole records, and the fragments
   of records that cross its ends. Only fragments are shuffled, to be joined.

The result is a table in the shared folder, so later reads need no Python and do
not depend on how files are split then. A record is read by one task, so it must
fit in memory; a file of any size need not. Compressed files are one split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumtrail.session import ship, written


@dataclass(frozen=True)
class State:
    """Where a scanner stands: in quotes or not, open brackets, name of the open outermost array."""

    quoted: bool = False
    depth: int = 0
    name: str | None = None


class Cells:
    """Delimited text with cells in double quotes; a record ends at a line end outside quotes.

    A quote opens a cell only as its first character; elsewhere in an unquoted
    cell it is text. In a quoted cell two quotes are one, and what follows the
    closing quote up to the delimiter does not count.
    """

    separator = "\n"

    def __init__(self, delimiter: str):
        d = re.escape(delimiter)
        body = r'[^"]*+(?:""[^"]*+)*+'
        cell = rf'(?:"{body}"[^{d}]*+|[^"{d}][^{d}]*+)?+'
        self.open = re.compile(rf'(?:{cell}{d})*+"{body}\Z')
        self.close = re.compile(rf'{body}"[^{d}]*+({d})?+')

    def _ends_quoted(self, line: str, quoted: bool) -> bool:
        at = 0
        if quoted:
            closed = self.close.match(line)
            if closed is None:
                return True
            if closed[1] is None:
                return False
            at = closed.end()
        return line.find('"', at) >= 0 and self.open.match(line, at) is not None

    def moved(self, line: str, quoted: bool, depth: int) -> tuple[bool, int]:
        """Mode and depth after the line."""
        return self._ends_quoted(line, quoted), depth

    def end(self, line: str, state: State) -> State:
        return State(self._ends_quoted(line, state.quoted))

    def records(self, line: str, state: State) -> tuple[State, int | None, bool, bool]:
        """State after the line, where a record starts in it, whether it ends one, whether it is out of place."""
        after = self.end(line, state)
        return after, None if state.quoted else 0, not after.quoted, False


class Objects:
    """JSON objects in an array: the outermost one, or the one called ``name`` of the outermost object.

    Pieces are cut at closing braces, so a record always ends with a piece.
    """

    separator = "}"
    _token = re.compile(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(\s*+:\s*+\[)?+|[{}\[\]"]', re.S)
    _string = re.compile(r'[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
    _between = re.compile(r"[\s,]*+\Z")
    _whole = re.compile(r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', re.S)
    _opening = re.compile(r"[\s,]*+\{")

    def __init__(self, name: str | None = None, wrapped: bool = False):
        self.name, self.level = name, 2 if wrapped else 1

    def _outside(self, piece: str, quoted: bool) -> tuple[bool, str | None]:
        """Mode after the piece and what of it and its brace stands outside strings; None if nothing does."""
        piece += "}"
        if quoted:
            closed = self._string.match(piece)
            if closed is None:
                return True, None
            piece = piece[closed.end():]
        rest = self._whole.sub("", piece) if '"' in piece else piece
        at = rest.find('"')
        return (False, rest) if at < 0 else (True, rest[:at])

    def moved(self, piece: str, quoted: bool, depth: int) -> tuple[bool, int]:
        """Mode and depth after the piece."""
        quoted, rest = self._outside(piece, quoted)
        if rest is None:
            return True, depth
        return quoted, depth + rest.count("{") + rest.count("[") - rest.count("}") - rest.count("]")

    def _within(self, piece: str, state: State) -> State | None:
        """State after a piece that neither leaves the array of records nor closes another; None for any other piece.

        A piece holds no closing brace but its last character, so depth only
        grows before that, and the outermost array stays the same.
        """
        if state.depth < self.level or self.level == 1 and state.name is not None:
            return None
        quoted, rest = self._outside(piece, state.quoted)
        if rest is None:
            return state
        if "]" in rest:
            return None
        depth = state.depth + rest.count("{") + rest.count("[") - rest.count("}")
        return State(quoted, depth, state.name) if depth >= self.level else None

    def _walk(self, piece: str, state: State) -> Iterator[tuple[str, int, State]]:
        """Brackets outside strings with their place and the state after them; last, the end."""
        piece, at = piece + "}", 0
        if state.quoted:
            closed = self._string.match(piece)
            if closed is None:
                yield "", len(piece), state
                return
            at, state = closed.end(), replace(state, quoted=False)
        for m in self._token.finditer(piece, at):
            mark, place = piece[m.start()], m.start()
            if mark in "{[":
                state = replace(state, depth=state.depth + 1)
            elif mark in "}]":
                state = replace(state, depth=state.depth - 1, name=state.name if state.depth > 2 else None)
            elif m[1] is None:
                yield "", len(piece), replace(state, quoted=True)
                return
            elif m[2] is not None:
                name = m[1] if state.depth == 1 else state.name
                state = replace(state, depth=state.depth + 1, name=name)
                mark, place = "[", m.end() - 1
            else:
                continue
            yield mark, place, state
        yield "", len(piece), state

    def end(self, piece: str, state: State) -> State:
        if state.depth >= 2 and (after := self._within(piece, state)) is not None:
            return after
        for _, _, state in self._walk(piece, state):
            pass
        return state

    def arrays(self, piece: str, state: State) -> list[str]:
        """Names of arrays that the piece opens directly in the outermost object."""
        if state.depth >= 2 and self._within(piece, state) is not None:
            return []
        return [s.name for mark, _, s in self._walk(piece, state) if mark == "[" and s.depth == 2]

    def _inside(self, state: State) -> bool:
        return self.level == 1 or self.name is None or state.name == self.name

    def records(self, piece: str, state: State) -> tuple[State, int | None, bool, bool]:
        open_ = state.depth > self.level and self._inside(state)
        opening = None if open_ or state.quoted or not self._inside(state) else self._opening.match(piece)
        if (open_ or opening) and (after := self._within(piece, state)) is not None:
            # Most pieces: inside a record, or the start of one with nothing but commas before it.
            return after, None if open_ else opening.end() - 1, after.depth == self.level and not after.quoted, False
        start, odd = None, False
        # Where text directly in the array began, to see that only commas stand there.
        since = 0 if state.depth == self.level and self._inside(state) and not state.quoted else None
        for mark, at, after in self._walk(piece, state):
            inside = self._inside(after)
            if mark and state.depth == self.level and since is not None:
                odd |= not self._between.match(piece, since, at) or mark == "["
            if mark == "{" and after.depth == self.level + 1 and inside and not open_:
                start, open_ = at, True
            since = (at + 1 if mark else since) if after.depth == self.level and inside else None
            if not mark and since is not None and not after.quoted and at > len(piece):
                odd |= not self._between.match(piece, since)
            elif after.quoted and after.depth == self.level and inside:
                odd = True
            state = after
        ends = open_ and state.depth == self.level and not state.quoted
        return state, start, ends, odd


def pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(value, file, start): text between separators, with the split it was read in."""
    return spark.read.option("lineSep", separator).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """The pieces of each split in turn; a task may read several splits one after the other."""
    from itertools import groupby

    def runs():
        for batch in batches:
            if not batch.num_rows:
                continue
            names, values = [batch.column(c) for c in ("file", "start")], batch.column("value").to_pylist()
            if all(len(c.unique()) == 1 for c in names):
                yield tuple(c[0].as_py() for c in names), values
                continue
            for key, group in groupby(zip(*(c.to_pylist() for c in names), values), key=lambda r: r[:2]):
                yield key, [value for *_, value in group]

    for (file, start), group in groupby(runs(), key=lambda r: r[0]):
        yield file, start, (value for _, values in group for value in values)


_ENDS = "file string, start long, from_plain boolean, from_quoted boolean, deeper long, deeper_quoted long, texts long"


def _ends(found: DataFrame, scanner) -> DataFrame:
    """Step 1: one row per split."""

    def run(batches):
        for file, start, values in _splits(batches):
            plain, quoted, texts = (False, 0), (True, 0), 0
            for value in values:
                # Once the modes agree, both go the same way from then on.
                apart = quoted[1] - plain[1] if plain[0] == quoted[0] else None
                plain = scanner.moved(value, *plain)
                quoted = scanner.moved(value, *quoted) if apart is None else (plain[0], plain[1] + apart)
                texts += not value.isspace() and value != ""
            yield pa.RecordBatch.from_pydict({
                "file": [file], "start": [start], "from_plain": [plain[0]], "from_quoted": [quoted[0]],
                "deeper": [plain[1]], "deeper_quoted": [quoted[1]], "texts": [texts]})

    return found.mapInArrow(run, _ENDS)


def _starts(ends: DataFrame) -> DataFrame:
    """Step 2: mode and depth at the start of each split, and whether text stands before it in the file."""
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_plain") == F.col("from_quoted")
    swaps = F.sum((F.col("from_plain") & ~F.col("from_quoted")).cast("long")).over(order)
    known = ends.withColumn("swaps", swaps).withColumn(
        "last", F.last(F.when(fixed, F.struct("from_plain", "swaps")), ignorenulls=True).over(before))
    since = F.coalesce(F.lag("swaps").over(order), F.lit(0)) - F.coalesce(F.col("last.swaps"), F.lit(0))
    quoted = (F.coalesce(F.col("last.from_plain"), F.lit(False)).cast("long") + since) % 2 == 1
    deeper = F.when(F.col("quoted"), F.col("deeper_quoted")).otherwise(F.col("deeper"))
    return known.withColumn("quoted", quoted).select(
        "file", "start", "quoted", F.coalesce(F.sum(deeper).over(before), F.lit(0)).alias("depth"),
        (F.coalesce(F.sum("texts").over(before), F.lit(0)) == 0).alias("first"))


def _by_split(rows: DataFrame) -> dict[tuple[str, int], tuple]:
    return {(r.file, r.start): tuple(r)[2:] for r in rows.collect()}


@dataclass
class Scan:
    """What steps 1 and 2 found: how splits start that do not start plainly at depth 0."""

    scanner: object
    starts: dict[tuple[str, int], tuple[bool, int, bool]]
    splits: int

    def state(self, file: str, start: int, names: dict) -> State:
        quoted, depth, _ = self.starts.get((file, start), (False, 0, False))
        return State(quoted, depth, names.get((file, start), (None,))[0])


def scanned(found: DataFrame, scanner) -> Scan:
    """Steps 1 and 2. One row per split that starts within a record, and one per file, come to the driver."""
    ship(found.sparkSession)
    ends = written(_ends(found, scanner))
    starts = _by_split(_starts(ends).where("quoted or depth <> 0 or first"))
    return Scan(scanner, starts, ends.count())


def names_of(found: DataFrame, scan: Scan) -> tuple[list[str], dict[tuple[str, int], tuple[str]]]:
    """Names of the arrays in the outermost object, and the one that is open at the start of each split."""
    unknown = "\0"

    def run(batches):
        for file, start, values in _splits(batches):
            state = replace(scan.state(file, start, {}), name=unknown)
            opened: dict[str, None] = {}
            for value in values:
                opened.update(dict.fromkeys(scan.scanner.arrays(value, state)))
                state = scan.scanner.end(value, state)
            # "" is no array at all; a split in which nothing opens or ends leaves things as they were.
            last = None if state.name == unknown else state.name or ""
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([start], pa.int64()), pa.array([last], pa.string()), pa.array([list(opened)], pa.list_(pa.string()))],
                names=["file", "start", "last", "opened"])

    ends = written(found.mapInArrow(run, "file string, start long, last string, opened array<string>"))
    every = sorted(r.name for r in ends.select(F.explode("opened").alias("name")).distinct().collect())
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    open_ = ends.select("file", "start", F.last("last", ignorenulls=True).over(before).alias("name"))
    return every, _by_split(open_.where("name <> ''"))


#: What a row of step 3 holds: a whole record; the first, a middle or the last fragment of one; text that is out of place.
WHOLE, FIRST, MIDDLE, LAST, ODD = range(5)


def records(found: DataFrame, scan: Scan, names: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Step 3: (file, value, first) of all records, first if it is the file's first text; and (file, value) of text out of place."""
    scanner, names = scan.scanner, names or {}
    joint = scanner.separator
    # JSON records keep their closing brace; lines lose their end.
    tail = joint if joint == "}" else ""

    def run(batches):
        for file, start, values in _splits(batches):
            state = scan.state(file, start, names)
            before = scan.starts.get((file, start), (False, 0, False))[2]
            out: list[tuple[str, int, bool]] = []
            size = 0
            inside = isinstance(scanner, Cells) and state.quoted or isinstance(scanner, Objects) and state.depth > scanner.level and scanner._inside(state)
            kind, held = (MIDDLE, []) if inside else (WHOLE, None)
            for value in values:
                state, at, ends, odd = scanner.records(value, state)
                if odd:
                    out.append((value, ODD, False))
                if at is not None and held is None:
                    kind, held, value = WHOLE, [], value[at:]
                if held is None:
                    continue
                held.append(value)
                if ends:
                    text = joint.join(held) + tail
                    if kind == MIDDLE or text.strip():
                        out.append((text, LAST if kind == MIDDLE else WHOLE, before))
                        size += len(text)
                        before = False
                    held = None
                if size > 1 << 22:
                    yield from _batch(file, start, out)
                    out, size = [], 0
            if held is not None:
                # A fragment ends with the separator that cut its last piece off.
                out.append((joint.join(held) + joint, MIDDLE if kind == MIDDLE else FIRST, before))
            yield from _batch(file, start, out)

    kinds = "file string, start long, value string, kind int, first boolean"
    table = written(found.mapInArrow(run, kinds))
    order = Window.partitionBy("file").orderBy("start", F.col("kind") != LAST)
    cut = table.where(F.col("kind").isin(FIRST, MIDDLE, LAST)).withColumn(
        "number", F.sum((F.col("kind") == FIRST).cast("long")).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "value", "first")))
    joined = cut.groupBy("file", "number").agg(parts.alias("parts")).select(
        "file", F.array_join("parts.value", "").alias("value"), F.col("parts.first")[0].alias("first"))
    whole = table.where(F.col("kind") == WHOLE).select("file", "value", "first")
    return whole.unionByName(joined), table.where(F.col("kind") == ODD).select("file", "value")


def _batch(file: str, start: int, out: list[tuple[str, int, bool]]) -> Iterator[pa.RecordBatch]:
    if out:
        text, kind, first = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [pa.array([file] * len(out)), pa.array([start] * len(out), pa.int64()), pa.array(text, pa.string()), pa.array(kind, pa.int32()), pa.array(first, pa.bool_())],
            names=["file", "start", "value", "kind", "first"])
