"""BPE encoding and decoding by speculation and verification.

For a word, greedy longest match proposes tokens; all words of a batch walk down
the trie of the tokens side by side. A sequence of tokens is the
one that merging would give exactly when every adjacent pair of it is: so all
adjacent pairs of all new words of a batch are tested in one vectorised pass,
and only words with a failing pair are merged step by step, one merge in each of
these words at a time.

A boundary between two tokens survives when, among all pairs of pieces that
ever touch it while both tokens are being built, none has a merge that comes
before both pieces have moved on. That test follows the right edge of the left
token and the left edge of the right token through their merges, for all pairs
side by side.

The vocabulary file is a parameter: a JSON file in the format of the public
``tokenizers`` library, with lower-casing, NFC, white space dropped and an
end-of-word suffix. It is read on the driver once and shared as a broadcast, so
workers need no local file; its size does not depend on the data.

Null texts count as empty: no tokens and an empty decoded text. Rows are
independent, so copies, ties and hot keys need no care; a word of any length is
handled (long ones alone, merging with a heap), and a bounded cache keeps the ids
of words seen.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow

#: Rank of what is never merged.
NEVER = np.int64(1) << 40
#: Most bytes of a word that is proposed and merged side by side with others.
SHORT = 48
#: What follows the bytes of a word, as a symbol of the trie.
STOP = 256

ENCODED = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()),
    T.StructField("decoded", T.StringType()),
])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = [chr(b) for b in range(256)]
    for k, b in enumerate(b for b in range(256) if b not in shown):
        out[b] = chr(256 + k)
    return out


#: A character beyond the basic plane.
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@cache
def plane_pattern(split: str) -> re.Pattern | None:
    r"""``split`` for the faster ``re`` and texts of the basic plane; None if it has other classes than \p{L}, \p{N} and \s in brackets.

    The classes are written out as ``regex`` has them, so both find the same words.
    """
    if "\\" in re.sub(r"\[[^\]]*\]", "", split):
        return None
    plane = "".join(map(chr, range(1 << 16)))
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        runs = regex.finditer(f"{name}+", plane)
        split = split.replace(name, "".join(f"\\u{m.start():04x}-\\u{m.end() - 1:04x}" for m in runs))
    return None if re.search(r"\\[^u]", split) else re.compile(split)


@dataclass
class Vocabulary:
    """What encoding needs, as plain arrays and dictionaries."""

    ids: dict[str, int]
    texts: list[str]
    suffix: str
    split: str
    special: list[tuple[str, int]]
    rank: dict[tuple[int, int], tuple[int, int]]
    left: np.ndarray
    right: np.ndarray
    made: np.ndarray
    pair_keys: np.ndarray
    pair_ranks: np.ndarray
    longest: int
    made_by: np.ndarray
    single: np.ndarray
    trie: tuple[np.ndarray, np.ndarray, np.ndarray]
    symbols: list[str] = field(default_factory=byte_symbols)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        special = [(a["content"], a["id"]) for a in spec["added_tokens"]]
        size = max([*ids.values(), *(i for _, i in special)]) + 1
        texts = [""] * size
        for token, i in ids.items():
            texts[i] = token
        for token, i in special:
            texts[i] = token
        left = np.full(size, -1, np.int64)
        right = np.full(size, -1, np.int64)
        made = np.full(size, -1, np.int64)  # rank of the merge that makes the token, -1: a single symbol
        rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = ids[a], ids[b], ids[a + b]
            rank[x, y] = (r, z)
            if made[z] < 0:
                left[z], right[z], made[z] = x, y, r
        keys = np.array([x * size + y for x, y in rank], np.int64)
        ranks = np.array([r for r, _ in rank.values()], np.int64)
        order = np.argsort(keys)
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        suffix = model["end_of_word_suffix"] or ""
        made_by = np.full(len(model["merges"]), -1, np.int64)  # token that the merge of a rank makes
        for r, z in rank.values():
            made_by[r] = z
        # Tokens of single bytes: inside a word, and as its last.
        single = np.array([[ids.get(c, -1), ids.get(c + suffix, -1)] for c in byte_symbols()], np.int64)
        return cls(ids, texts, suffix, pattern, special, rank, left, right, made, keys[order], ranks[order],
                   max(len(t) for t in ids), made_by, single, trie(ids, suffix))


def trie(ids: dict[str, int], suffix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (node and symbol) of all edges, the nodes they lead to, and the token that ends at a node or -1."""
    byte = {c: b for b, c in enumerate(byte_symbols())}
    edges: dict[int, int] = {}
    ends = {}
    for token, i in ids.items():
        last = bool(suffix) and token.endswith(suffix)
        path = [byte.get(c) for c in (token[: len(token) - len(suffix)] if last else token)]
        if not path or None in path:
            continue
        # Without any suffix a token may stand at either place.
        for way in [[*path, STOP]] if last else [path] if suffix else [path, [*path, STOP]]:
            node = 0
            for symbol in way:
                node = edges.setdefault(node * (STOP + 1) + symbol, len(edges) + 1)
            ends[node] = i
    keys = np.array(list(edges), np.int64)
    nodes = np.array(list(edges.values()), np.int64)
    tokens = np.full(len(edges) + 1, -1, np.int64)
    tokens[list(ends)] = list(ends.values())
    order = np.argsort(keys)
    return keys[order], nodes[order], tokens


class Encoder:
    """Words to ids; keeps the ids of words it has seen, up to ``cache`` words."""

    def __init__(self, vocabulary: Vocabulary, cache: int = 200_000):
        self.v, self.limit = vocabulary, cache
        self.known: dict[str, tuple[int, bytes]] = {}
        self.tokens = np.array(vocabulary.texts, object)
        self.words = regex.compile(vocabulary.split)
        self.plane_words = plane_pattern(vocabulary.split)
        self.special = regex.compile("|".join(regex.escape(s) for s, _ in vocabulary.special)) if vocabulary.special else None
        self.special_ids = dict(vocabulary.special)
        self.to_symbols = dict(enumerate(vocabulary.symbols))

    # -- text to words ----------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order; special tokens keep a leading NUL."""
        if self.special is None:
            return self.split(self.normal(text))
        out: list[str] = []
        end = 0
        for m in self.special.finditer(text):
            out += self.split(self.normal(text[end : m.start()]))
            out.append("\0" + m.group())
            end = m.end()
        return out + self.split(self.normal(text[end:] if end else text))

    def split(self, text: str) -> list[str]:
        """The words of a normal text."""
        quick = self.plane_words if _BEYOND.search(text) is None else None
        return (quick or self.words).findall(text)

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then each character lower-cased on its own.

        White space needs no care: the split drops every run of it.
        """
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # str.lower() looks at the neighbours of this one only
                text = text.replace("Σ", "σ")
        return text.lower()

    def start(self, word: str) -> list[str]:
        """The single symbols of a word; the last one carries the suffix."""
        shown = [self.v.symbols[b] for b in word.encode("utf-8", "surrogatepass")]
        shown[-1] += self.v.suffix
        return shown

    # -- words to ids -----------------------------------------------------

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the suffix counts as part of the last symbol."""
        ids, suffix, longest = self.v.ids, self.v.suffix, self.v.longest
        shown = word if word.isascii() and word.isprintable() else "".join(
            self.v.symbols[b] for b in word.encode("utf-8", "surrogatepass"))
        n, at, out = len(shown), 0, []
        while at < n:
            token = None
            if n - at <= longest:
                token = ids.get(shown[at:] + suffix)
                end = n
            if token is None:
                for end in range(min(n - 1, at + longest), at, -1):
                    token = ids.get(shown[at:end])
                    if token is not None:
                        break
                else:
                    return []
            out.append(token)
            at = end
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: do they stay apart when their texts are merged together?"""
        v, size = self.v, len(self.v.texts)
        left, right = a.astype(np.int64), b.astype(np.int64)
        until_left = np.full(len(a), NEVER)  # rank at which the piece at the boundary moves on
        until_right = np.full(len(a), NEVER)
        apart = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        while len(open_):
            x, y = left[open_], right[open_]
            key = x * size + y
            at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
            merge = np.where(v.pair_keys[at] == key, v.pair_ranks[at], NEVER)
            # Of equal ranks the leftmost goes first: the left token's own merge before this one,
            # this one before the right token's own.
            clash = (merge < until_left[open_]) & (merge <= until_right[open_]) & (merge < NEVER)
            apart[open_[clash]] = False
            made_x, made_y = v.made[x], v.made[y]
            done = clash | ((made_x < 0) & (made_y < 0))
            # Go back in time: undo the later of the two merges.
            back_x = ~done & (made_x >= made_y)
            back_y = ~done & ~back_x
            ix, iy = open_[back_x], open_[back_y]
            until_left[ix], left[ix] = made_x[back_x], v.right[x[back_x]]
            until_right[iy], right[iy] = made_y[back_y], v.left[y[back_y]]
            open_ = open_[~done]
        return apart

    def merged(self, word: str) -> list[int]:
        """The ids of a word by merging, lowest rank first, then leftmost."""
        ids = [self.v.ids[s] for s in self.start(word)]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            if (m := self.v.rank.get((ids[i], ids[i + 1]))):
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, x, y, z = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != x or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = z, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q < n and (m := self.v.rank.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (m[0], p, ids[p], ids[q], m[1]))
        return [t for t, on in zip(ids, alive) if on]

    def propose_short(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of short words side by side: all tokens, and their number per word (0: none fits)."""
        keys, nodes, tokens = self.v.trie
        sizes = np.array([len(d) for d in data], np.int64)
        stops = np.cumsum(sizes + 1)
        symbols = np.full(stops[-1], STOP, np.int64)
        symbols[np.arange(sizes.sum()) + np.repeat(np.arange(len(data)), sizes)] = np.frombuffer(b"".join(data), np.uint8)
        at, open_ = stops - sizes - 1, np.arange(len(data))
        owners, found = [], []
        bad = np.zeros(len(data), bool)
        while len(open_):
            end, stop = at[open_], stops[open_]
            node = np.zeros(len(open_), np.int64)
            token, token_end = np.full(len(open_), -1), np.zeros(len(open_), np.int64)
            walks = np.arange(len(open_))
            while len(walks):
                key = node[walks] * (STOP + 1) + symbols[end[walks]]
                where = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ok = keys[where] == key
                walks = walks[ok]
                node[walks] = nodes[where[ok]]
                end[walks] += 1
                new = tokens[node[walks]]
                fits = (new >= 0) & (end[walks] != stop[walks] - 1)  # the last symbol carries the suffix
                token[walks[fits]], token_end[walks[fits]] = new[fits], end[walks[fits]]
                walks = walks[end[walks] < stop[walks]]
            fits = token >= 0
            bad[open_[~fits]] = True
            open_ = open_[fits]
            owners.append(open_)
            found.append(token[fits])
            at[open_] = token_end[fits]
            open_ = open_[at[open_] < stops[open_]]
        owner, flat = np.concatenate(owners), np.concatenate(found)
        order = np.argsort(owner, kind="stable")
        order = order[~bad[owner[order]]]
        return flat[order], np.bincount(owner[order], minlength=len(data))

    def ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The ranks of the merges of pairs of tokens."""
        key = x * len(self.v.texts) + y
        at = np.minimum(np.searchsorted(self.v.pair_keys, key), len(self.v.pair_keys) - 1)
        return np.where(self.v.pair_keys[at] == key, self.v.pair_ranks[at], NEVER)

    def merged_short(self, data: list[bytes]) -> list[list[int]]:
        """The ids of short words by merging; each round makes one merge in every word that has one left."""
        sizes = np.array([len(d) for d in data], np.int64)
        last = np.zeros(sizes.sum(), np.int64)
        last[np.cumsum(sizes) - 1] = 1
        ids = self.v.single[np.frombuffer(b"".join(data), np.uint8), last]
        owner = np.repeat(np.arange(len(data)), sizes)
        ranks = np.full(len(ids), NEVER)  # of a token and the next one of its word
        inner = np.flatnonzero(last == 0)
        ranks[inner] = self.ranks(ids[inner], ids[inner + 1])
        out: list[list[int]] = [[]] * len(data)
        while len(ids):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(ids)))
            least = np.minimum.reduceat(ranks, starts)
            ended = least == NEVER
            if ended.any():
                plain = ids.tolist()
                for a, n, w in zip(starts[ended].tolist(), sizes[ended].tolist(), owner[starts[ended]].tolist()):
                    out[w] = plain[a : a + n]
                going = np.repeat(~ended, sizes)
                ids, owner, ranks = ids[going], owner[going], ranks[going]
                least, sizes = least[~ended], sizes[~ended]
                if not len(ids):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, sizes))
            at = at[np.append(True, owner[at[1:]] != owner[at[:-1]])]  # the leftmost of each word
            ids[at] = self.v.made_by[least]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at -= np.arange(len(at))  # one token left of it is gone in every word before
            ids, owner, ranks = ids[stays], owner[stays], ranks[stays]
            for left in (at, at[at > 0] - 1):
                pair = left[left + 1 < len(ids)]
                pair = pair[owner[pair] == owner[pair + 1]]
                ranks[left] = NEVER
                ranks[pair] = self.ranks(ids[pair], ids[pair + 1])
        return out

    def learn(self, new: list[str]) -> None:
        """Encode words not seen before: propose, verify all pairs at once, merge what failed."""
        coded = [w.encode("utf-8", "surrogatepass") for w in new]
        short = [k for k, d in enumerate(coded) if len(d) <= SHORT]
        long = [k for k, d in enumerate(coded) if len(d) > SHORT]
        order = short + long
        proposed = [self.propose(new[k]) for k in long]
        flat, sizes = self.propose_short([coded[k] for k in short]) if short else (np.empty(0, np.int64), np.empty(0, np.int64))
        flat = np.concatenate([flat, np.array([t for p in proposed for t in p], np.int64)])
        sizes = np.concatenate([sizes, np.array([len(p) for p in proposed], np.int64)])
        ends = np.cumsum(sizes)
        good = sizes > 0
        if len(flat) > 1:
            inner = np.ones(len(flat) - 1, bool)  # pairs that lie inside one word
            cuts = ends[:-1] - 1
            inner[cuts[(cuts >= 0) & (cuts < len(inner))]] = False
            key, where = np.unique(flat[:-1][inner] * len(self.v.texts) + flat[1:][inner], return_inverse=True)
            ok = self.fits(key // len(self.v.texts), key % len(self.v.texts))[where.reshape(-1)]
            owner = np.repeat(np.arange(len(order)), sizes)[:-1][inner]
            good[owner[~ok]] = False
        data = flat.astype("<u4").tobytes()
        for k, a, b, fine in zip(order, (ends - sizes).tolist(), ends.tolist(), good.tolist()):
            if fine:
                self.known[new[k]] = (b - a, data[4 * a : 4 * b])
        failed = [k for k, fine in zip(order, good.tolist()) if not fine]
        side = [k for k in failed if len(coded[k]) <= SHORT]
        alone = [k for k in failed if len(coded[k]) > SHORT]
        tokens = self.merged_short([coded[k] for k in side]) if side else []
        for k, t in zip(side + alone, tokens + [self.merged(new[k]) for k in alone]):
            self.known[new[k]] = (len(t), np.array(t, "<u4").tobytes())

    def encode(self, texts: list[str]) -> list[tuple[int, bytes, str]]:
        """For every text: number of tokens, ids as little-endian 32-bit integers, the text these ids decode to."""
        split = [self.pieces(t) for t in texts]
        if len(self.known) > self.limit:
            self.known.clear()
        new = set().union(*split).difference(self.known)
        for w in [w for w in new if w[0] == "\0" and w[1:] in self.special_ids]:
            new.discard(w)
            token = self.special_ids[w[1:]]
            self.known[w] = (1, np.array([token], "<u4").tobytes())
        if new:
            self.learn(list(new))
        ids = [b"".join(map(itemgetter(1), map(self.known.__getitem__, p))) for p in split]
        return list(zip([len(i) // 4 for i in ids], ids, self.decode(ids)))

    def decode(self, encoded: list[bytes]) -> list[str]:
        """The texts of encoded ids, looked up in the token table for all texts at once.

        Tokens are joined by spaces, as the file names no decoder. An id outside the
        table raises an error.
        """
        tokens = self.tokens[np.frombuffer(b"".join(encoded), "<u4")].tolist()
        ends = np.cumsum([0, *(len(e) // 4 for e in encoded)]).tolist()
        return [" ".join(tokens[a:b]) for a, b in zip(ends, ends[1:])]


def decode(vocabulary: Vocabulary, ids: bytes) -> str:
    """The text of the ids of one text."""
    return Encoder(vocabulary).decode([ids])[0]


def encoded(docs: DataFrame, path: str, digests: bool = False, chunk: int = 1 << 21) -> DataFrame:
    """All columns of ``docs`` with n_tokens, ids and decoded (or their SHA-256) added.

    ``chunk`` bounds the characters encoded at a time. Columns of ``docs`` with a
    clashing name are replaced.
    """
    fields = [ENCODED["n_tokens"], *(
        [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        if digests else [ENCODED["ids"], ENCODED["decoded"]])]
    added = {f.name for f in fields}
    kept = [c for c in docs.columns if c not in added]
    schema = T.StructType([*(docs.schema[c] for c in kept), *fields])
    target = arrow_schema(schema)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))

    def chunks(texts: list[str | None]) -> Iterator[list[str]]:
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if size >= chunk:
                yield group
                group, size = [], 0
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            at = 0
            for group in chunks(batch.column("text").to_pylist()):
                rows = []
                for n, ids, text in encoder.encode(group):
                    rows.append((n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
                                if digests else (n, ids, text))
                part = batch.slice(at, len(group))
                at += len(group)
                values = [part.column(c) for c in kept] + [pa.array(v, type=target.field(f.name).type) for v, f in zip(zip(*rows), fields)]
                yield pa.RecordBatch.from_arrays(values, schema=target)

    return docs.select(*kept).transform(map_arrow, run, schema)
