"""Personal data: generators propose spans, boosted trees choose among them.

Fixed patterns find the base spans, which always stay. Generators of high recall
propose further, overlapping spans for the same kinds: addresses written out with
"at" and "dot", telephone numbers without a country code, card numbers with
uncommon separators, internet addresses with written-out dots. Gradient-boosted
trees score every proposal by its format and context, a threshold per kind,
calibrated on held-out proposals, selects redactions, and of overlapping ones
the best stays.

The trees are trained here, on the proposals of all rows, together with the
written-out examples below. Strict checks (Luhn, octets, digits and country code,
a known top-level domain) label what the texts hold; rules make the rest from
their base spans: written-out forms in the same place, and look-alikes (ordinary
words around "at", numbers that fail a check, years, sums) elsewhere in the text.
Proposals of equal features and label are counted together and weigh as many as
they are. A fifth of all features, chosen by their hash, is kept from the trees
and sets the thresholds alone. Model and thresholds depend on nothing else, so
reruns agree.

Null texts have no spans. Work is row by row, so copies, hot sources and long
texts need no care; every pattern takes time in proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow
from sumtrail.session import written

KINDS = ["email", "ip", "card", "phone"]

#: The base patterns. Look-behinds only skip starts that cannot match.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The generators' patterns.
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|@)\s?[\])}>]\s?|\s(?:at|AT)\s|\s@\s)"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s|\.)"
_SPELLED = re.compile(rf"{_AT}[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}")
_SPELLED_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:\s?[\[({{]\s?(?:dot|\.)\s?[\])}}]\s?|\sdot\s)[0-9]{{1,3}}){{3}}(?![0-9])")
_GROUPED = re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_ -]{1,3}[0-9]{3,6}){2,4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9+.])(?:\(?0?[0-9]{2,4}\)?[\x20./-]{1,2}){1,3}[0-9]{3,4}[\x20./-]{0,1}[0-9]{3,4}(?![0-9])|(?<![0-9])00[1-9][0-9\x20()./-]{7,18}[0-9](?![0-9])")
_ANY = re.compile(r"[0-9@]|\b(?:at|AT)\b")

#: What a text must hold for the slower patterns to match anywhere in it.
_RUN = re.compile(r"[0-9][0-9\x20()./_-]{5,}[0-9]")
_MAY_SPELL = re.compile(r"@|(?:at|AT)[\s\])}>]{1,3}[A-Za-z0-9-]{1,63}(?:\s?[\[({<]\s?(?:dot|DOT|\.)|\s(?:dot|DOT)\s|\.)")
_MAY_SPELL_IP = re.compile(r"[0-9](?:\s?[\[({]\s?(?:dot|\.)|\sdot\s)")

#: Words that announce a kind, and common top-level domains.
CUES = {
    "email": ["mail", "e-mail", "email", "contact", "write", "kontakt", "correo", "courriel"],
    "ip": ["ip", "host", "server", "address", "login", "from", "adresse"],
    "card": ["card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"],
    "phone": ["tel", "phone", "call", "mobile", "fax", "telefon", "fono", "ring", "whatsapp"],
}
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "co", "uk", "de", "fr", "es", "info", "eu", "us", "ca"]

#: Written-out training examples, the span between the braces, and its label.
EXAMPLES = [
    ("email", "write to {jane.roe at example dot com} today", 1), ("email", "mail {j.roe [at] mail5.example [dot] org}", 1),
    ("email", "contact {info (at) example (dot) net} now", 1), ("email", "is {ines.19@mail5.example.com} here", 1),
    ("email", "e-mail: {max@example.de}.", 1), ("email", "he was {there at noon.The} end", 0),
    ("email", "looked {up at him.She} left", 0), ("email", "we met {friends at home.It} was late", 0),
    ("email", "arrive {there at ten dot it} goes", 0), ("email", "the {price @ 3.50} each", 0), ("email", "over {a@b.c} then", 0),
    ("ip", "from {10 dot 0 dot 0 dot 7} came", 1), ("ip", "host {192[.]168[.]4[.]20} is down", 1),
    ("ip", "server {154.127.37.204} the", 1), ("ip", "of {8.196.197.208} ach", 1), ("ip", "version {1.20.300.4000} is", 0),
    ("ip", "section {400.1.2.999} says", 0), ("ip", "see {10 dot 900 dot 3 dot 1} or", 0), ("ip", "at {999.12.31.2024} and", 0),
    ("card", "card {4111.1111.1111.1111} expires", 1), ("card", "visa {5500/0000/0000/0004} paid", 1),
    ("card", "pay {4994226020900891} there", 0), ("card", "to {4111 1111 1111 1111} was", 1), ("card", "this {4012888888881881} is", 1),
    ("card", "code {2123 4656 5978 9240} of", 0), ("card", "order {2000.1234.5678} shipped", 0), ("card", "serial {4757.9653.0066.9737} and", 0),
    ("card", "part {1234_5678_9012_3456} fits", 0),
    ("phone", "call {(743) 555-3824} now", 1), ("phone", "tel {030 5550 1234} today", 1), ("phone", "phone: {0152 555 8590}", 1),
    ("phone", "fax {0044 20 7946 0958} or", 1), ("phone", "en {+1 (743) 555-3824} eux", 1), ("phone", "mobile {663-555-6869}", 1),
    ("phone", "from {1999-2000 2001} on", 0), ("phone", "pages {100-200 300-4000}", 0), ("phone", "sum {12 345 678 900} total", 0),
    ("phone", "on {12-11-2024 1030} at", 0), ("phone", "won {21 2000 1500} points", 0), ("phone", "rows {400 500 6000} of", 0),
    ("phone", "table {10 20 30 4000} shows", 0), ("phone", "isbn {978-0-306-40615-7}", 0),
]

#: Ways to write "at" and "dot" out.
SPELLINGS = [(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", "."), ("(at)", "(dot)"), (" AT ", " DOT ")]
IP_DOTS = [" dot ", "[.]", " (dot) "]
CARD_GAPS = [".", "/", "_", "  "]

FEATURES = [
    *(f"is_{k}" for k in KINDS), "length", "digits", "digit_share", "separators", "luhn", "octets", "spelled", "domain",
    "plus", "bracket", "leading_zero", "cue", "before_digit", "after_digit", "before_letter", "after_letter",
    "groups", "longest_group", "caps", "year_like",
]


@dataclass(frozen=True)
class Settings:
    """Size of the model, precision aimed at per kind, and what an example weighs: so much, or that share of all proposals."""

    rounds: int = 12
    depth: int = 4
    precision: float = 0.95
    least: float = 0.6
    example_weight: int = 5
    example_share: float = 0.000_25


SETTINGS = Settings()


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    values = [int(c) for c in reversed(digits)]
    return sum(values[0::2] + [double[v] for v in values[1::2]]) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans, by kind and then start."""
    out: list[tuple[str, int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            out.append(("email", start, match.end()))
            end = match.end()
        at = text.find("@", max(at + 1, end))
    if not _RUN.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans of high recall, base patterns without their checks among them."""
    out = set()
    for m in _SPELLED.finditer(text) if _MAY_SPELL.search(text) else ():
        start, low = m.start(), max(0, m.start() - 64)
        while start > low and _LOCAL.match(text[start - 1]):
            start -= 1
        if start < m.start():
            out.add(("email", start, m.end()))
    if _MAY_SPELL_IP.search(text):
        out |= {("ip", m.start(), m.end()) for m in _SPELLED_IP.finditer(text) if m.end() - m.start() <= 60}
    if not _RUN.search(text):
        return sorted(out)
    out |= {("ip", m.start(), m.end()) for m in _IP.finditer(text) if m.end() - m.start() <= 60}
    for p in (_CARD, _GROUPED):
        out |= {("card", m.start(), m.end()) for m in p.finditer(text) if 12 <= m.end() - m.start() <= 60 and len(_digits(m.group())) >= 12}
    for p in (_PHONE, _NATIONAL):
        out |= {("phone", m.start(), m.end()) for m in p.finditer(text) if 8 <= len(_digits(m.group())) <= 17}
    return sorted(out)


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    digits = _digits(span)
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    near = text[max(0, start - 24) : start].lower()
    groups = re.findall("[0-9]+", span)
    octets = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    last = re.split(r"[^A-Za-z0-9-]+", span.rstrip(")]}> "))[-1].lower()
    return [
        *(float(kind == k) for k in KINDS), len(span), len(digits), len(digits) / max(1, len(span)),
        sum(not c.isalnum() for c in span), float(12 <= len(digits) <= 19 and luhn(digits)), float(octets),
        float(bool(re.search(r"\b(?:dot|DOT)\b", span)) or "[.]" in span or "(.)" in span), float(last in DOMAINS),
        float(span[:1] == "+"), float("(" in span or "[" in span), float(span[:1] == "0"),
        float(any(c in near for c in CUES[kind])), float(before.isdigit()), float(after.isdigit()),
        float(before.isalpha()), float(after.isalpha()), len(groups), max((len(g) for g in groups), default=0),
        float(span != span.lower()), float(any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)),
    ]


def strict(text: str, kind: str, start: int, end: int) -> float | None:
    """1 or 0 where strict checks decide a proposal, None where they can't."""
    span = text[start:end]
    digits = _digits(span)
    if kind == "email":
        return 1.0 if _DOMAIN.search(span) and features(text, kind, start, end)[FEATURES.index("domain")] else None
    if kind == "ip":
        return features(text, kind, start, end)[FEATURES.index("octets")]
    if kind == "card":
        return float(16 <= len(digits) <= 19 and luhn(digits))
    return 1.0 if span[:1] == "+" and 8 <= len(digits) <= 15 else None


def variants(text: str, kind: str, start: int, end: int) -> Iterator[tuple[str, int, int, float]]:
    """Written-out forms of a base span (label 1) and look-alikes of its kind (label 0), as text, start, end, label.

    A form stands where the span stood, a look-alike at another place nearby. Which
    ones are made depends on the span alone.
    """
    span = text[start:end]
    digits = _digits(span)
    pick = zlib.crc32(span.encode("utf-8", "surrogatepass"))
    before, after = text[max(0, start - 1_000) : start], text[end : end + 1_000]
    yes, no = [], []
    if kind == "email":
        name, host = span.split("@")
        at, dot = SPELLINGS[pick % len(SPELLINGS)]
        yes = [name + at + host.replace(".", dot)]
        around = re.findall(r"[^\W\d_]+", before + " " + after)
        if len(around) >= 3:
            k = pick % (len(around) - 2)
            a, b, c = around[k : k + 3]
            if c.lower() not in DOMAINS:
                no = [f"{a} at {b}.{c.capitalize()}", f"{a} at {b} dot {c}", f"{a} @ {b}.{c}"]
    elif kind == "ip":
        parts, dot = span.split("."), IP_DOTS[pick % len(IP_DOTS)]
        wrong = [str(256 + pick % 744) if k == pick % 4 else p for k, p in enumerate(parts)]
        yes, no = [dot.join(parts)], [dot.join(wrong), ".".join(wrong)]
    elif kind == "card":
        gap = CARD_GAPS[pick % len(CARD_GAPS)]
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + pick % 9) % 10)
        right, other = ([d[k : k + 4] for k in range(0, len(d), 4)] for d in (digits, wrong))
        yes, no = [gap.join(right)], [gap.join(other), wrong]
    else:
        n, year = digits[-10:].rjust(10, "5"), 1900 + pick % 120
        yes = [[f"({n[:3]}) {n[3:6]}-{n[6:]}", f"{n[:3]}-{n[3:6]}-{n[6:]}", f"0{n[:3]} {n[3:6]} {n[6:]}", f"00{digits[:2]} {digits[2:]}"][pick % 4]]
        no = [f"{year}-{year + 1} {year + 2}", f"{n[1:3]} {n[3:6]} {n[6:9]} 000", f"00{n}{n[2:6]}", f"{1 + pick % 28}-{1 + pick % 12}-{year} {n[:4]}"]
    for form in yes:
        yield before + form + after, len(before), len(before) + len(form), 1.0
    rest = before + " " + after
    spot = rest.find(" ", (pick >> 7) % len(rest)) + 1
    for form in no:
        yield rest[:spot] + form + " " + rest[spot:], spot, spot + len(form), 0.0


@dataclass
class Trees:
    """Boosted trees as arrays: feature (-1: leaf), threshold, children, value, one row per tree."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cut: dict[str, float]

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.zeros(len(x))
        for k in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            while (inner := self.feature[k][node] >= 0).any():
                f = np.maximum(self.feature[k][node], 0)
                goes = x[np.arange(len(x)), f] <= self.threshold[k][node]
                node = np.where(inner, np.where(goes, self.left[k][node], self.right[k][node]), node)
            margin += self.value[k][node]
        return np.round(1 / (1 + np.exp(-2 * np.clip(margin, -30, 30))), 4)


def _exported(model) -> Trees:
    rows = []
    for tree, weight in zip(model.trees, model.treeWeights):
        nodes: list[list] = []

        def add(node) -> int:
            k = len(nodes)
            nodes.append([-1, 0.0, 0, 0, 0.0])
            if node.numDescendants():
                split = node.split()
                nodes[k][:2] = [split.featureIndex(), split.threshold()]
                nodes[k][2], nodes[k][3] = add(node.leftChild()), add(node.rightChild())
            else:
                nodes[k][4] = weight * node.prediction()
            return k

        add(tree._call_java("rootNode"))
        rows.append(nodes)
    size = max(map(len, rows))
    full = np.array([r + [[-1, 0.0, 0, 0, 0.0]] * (size - len(r)) for r in rows])
    return Trees(full[:, :, 0].astype(int), full[:, :, 1], full[:, :, 2].astype(int), full[:, :, 3].astype(int), full[:, :, 4], {})


LABELLED = "x array<double>, y double, n double, held boolean"

#: Distinct features that one task of the training takes; two tasks at least.
TASK_ROWS = 200_000


@dataclass(frozen=True)
class Column:
    """Values of a labelled table that are read from it as they are wanted."""

    frame: DataFrame
    value: Callable

    def __iter__(self) -> Iterator:
        return map(self.value, self.frame.toLocalIterator())


def training(docs: DataFrame, settings: Settings = SETTINGS) -> tuple[Iterable[tuple[np.ndarray, float, float]], Iterable[bool]]:
    """Features, label and weight of every kind of labelled proposal in all rows, and which of them are held out."""
    schema = T._parse_datatype_string(LABELLED)
    target = arrow_schema(schema)

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Bounded by a batch of rows; equal ones of other batches meet below.
            seen: Counter = Counter()
            for text in batch.column("text").to_pylist():
                if text and _ANY.search(text):
                    base = base_spans(text)
                    for kind, start, end in proposals(text) + base:
                        if (y := strict(text, kind, start, end)) is not None:
                            seen[tuple(map(float, features(text, kind, start, end))), y] += 1
                    for span in base:
                        for changed, start, end, y in variants(text, *span):
                            seen[tuple(map(float, features(changed, span[0], start, end))), y] += 1
            rows = [(x, y, float(n), held_out(x)) for (x, y), n in seen.items()]
            columns = list(zip(*rows)) or [()] * len(target)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    found = written(docs.select("text").transform(map_arrow, labelled, schema).groupBy("x", "y", "held").agg(F.sum("n").alias("n")))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0.0))).first()[0]
    weight = max(float(settings.example_weight), settings.example_share * total)
    examples = []
    for kind, marked, y in EXAMPLES:
        start, end = marked.index("{"), marked.index("}") - 1
        x = [float(v) for v in features(marked.replace("{", "").replace("}", ""), kind, start, end)]
        examples.append((x, float(y), weight, held_out(x)))
    written_out = docs.sparkSession.createDataFrame(examples, LABELLED).groupBy("x", "y", "held").agg(F.sum("n").alias("n"))
    both = written(written_out.unionByName(found).groupBy("x", "y", "held").agg(F.sum("n").alias("n")).select("x", "y", "n", "held"))
    return Column(both, lambda r: (np.array(r.x), r.y, r.n)), Column(both, lambda r: r.held)


def held_out(x: np.ndarray) -> bool:
    """True for a fifth of all feature vectors: they set thresholds and never reach the trees."""
    return int(hashlib.sha256(np.asarray(x, float).tobytes()).hexdigest()[:8], 16) % 5 == 0


def fit(docs: DataFrame, settings: Settings = SETTINGS) -> Trees:
    """Trees from the proposals of all ``docs`` and the written-out examples, thresholds from the held-out fifth."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    data, held = training(docs, settings)
    if isinstance(data, Column):
        table = data.frame
    else:
        table = docs.sparkSession.createDataFrame([(x.tolist(), y, float(n), bool(out)) for (x, y, n), out in zip(data, held)], LABELLED)
    learned = table.where("not held")
    # The same rows in the same order in every run, whatever order tasks ended in.
    ordered = learned.repartition(max(2, learned.count() // TASK_ROWS), "x", "y").sortWithinPartitions("x", "y", "n")
    frame = ordered.select(array_to_vector("x").alias("features"), F.col("y").alias("label"), F.col("n").alias("weight"))
    model = GBTClassifier(maxIter=settings.rounds, maxDepth=settings.depth, stepSize=0.3, seed=7, weightCol="weight").fit(frame)
    trees = _exported(model)
    trees.cut = _calibrated(table.where("held"), trees, settings)
    return trees


def _calibrated(held: DataFrame, trees: Trees, settings: Settings) -> dict[str, float]:
    """Thresholds from counts of all held-out proposals by kind and score: scores have four digits, so the counts are few."""
    schema = T._parse_datatype_string("kind int, score double, y double, n double")
    target = arrow_schema(schema)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[:, : len(KINDS)].argmax(axis=1), pa.int32()), pa.array(trees.score(x)), batch.column("y"), batch.column("n")], schema=target)

    counts = held.select("x", "y", "n").transform(map_arrow, scored, schema).groupBy("kind", "score", "y").agg(F.sum("n").alias("n"))
    rows = counts.collect()
    x = np.eye(len(FEATURES))[[r.kind for r in rows]] if rows else np.zeros((0, len(FEATURES)))
    return thresholds(x, np.array([r.y for r in rows]), np.array([r.score for r in rows]), settings, np.array([r.n for r in rows]))


def thresholds(x: np.ndarray, y: np.ndarray, scores: np.ndarray, settings: Settings = SETTINGS, n: np.ndarray | None = None) -> dict[str, float]:
    """Per kind the lowest score from which on proposals, ``n`` of each, are as precise as asked; 2 where there is none."""
    cut, n = {}, np.ones(len(y)) if n is None else n
    for k, kind in enumerate(KINDS):
        mine = x[:, k] == 1
        by_score = np.argsort(-scores[mine], kind="stable")
        s, many = scores[mine][by_score], n[mine][by_score]
        right, all_ = np.cumsum(y[mine][by_score] * many), np.cumsum(many)
        # Equal scores are taken or left together.
        last = np.append(s[1:] < s[:-1], True) if len(s) else np.zeros(0, bool)
        good = np.flatnonzero(last & (right / all_ >= settings.precision))
        cut[kind] = max(settings.least, float(s[good[-1]])) if len(good) else 2.0
    return cut


def find(texts: list[str | None], trees: Trees) -> list[tuple[list, list]]:
    """For every text its base spans and all its spans, each by kind and then start."""
    rows, x, owner = [], [], []
    for i, text in enumerate(texts):
        base = base_spans(text) if text and _ANY.search(text) else []
        rows.append((base, list(base)))
        if text and _ANY.search(text):
            for p in proposals(text):
                if p not in base:
                    x.append(features(text, *p))
                    owner.append((i, p))
    if x:
        scores = trees.score(np.array(x))
        for k in np.argsort(-scores, kind="stable"):
            i, (kind, start, end) = owner[k]
            if scores[k] >= trees.cut[kind] and not any(s < end and start < e for _, s, e in rows[i][1]):
                rows[i][1].append((kind, start, end))
        for _, spans in rows:
            spans.sort(key=lambda s: (KINDS.index(s[0]), *s[1:]))
    return rows


def written_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, end = [], 0
    for kind, s, e in sorted(spans, key=lambda s: (s[1], -s[2])):
        if s >= end:
            out += [text[end:s], f"[{kind.upper()}]"]
        end = max(end, e)
    return "".join(out) + text[end:]


REPORT = T.StructType([
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_spans", T.StringType()),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType()),
    T.StructField("redacted", T.StringType()),
])


def reported(docs: DataFrame, settings: Settings = SETTINGS, trees: Trees | None = None) -> DataFrame:
    """doc_id, counts of base spans, base and all spans, and the redacted text of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(trees or fit(docs, settings))
    schema = T.StructType([docs.schema["doc_id"], *REPORT])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows = []
            for text, (base, spans) in zip(texts, find(texts, shared.value)):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                plain = written_spans(base)
                rows.append((*counts, plain, hashlib.sha256(plain.encode()).hexdigest(), written_spans(spans),
                             len(spans) - len(base), redact(text, spans) if text is not None else None))
            values = list(zip(*rows)) or [()] * len(REPORT)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v, type=target.field(f.name).type) for v, f in zip(values, REPORT))], schema=target)

    return docs.select("doc_id", "text").transform(map_arrow, run, schema)


def redacted(docs: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """``docs`` with all spans redacted; every row and column stays, n_chars follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, settings))
    target = arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            new = [t if t is None else redact(t, spans) for t, (_, spans) in zip(texts, find(texts, shared.value))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(new, type=f.type) if f.name == "text" else batch.column(f.name) for f in target], schema=target)

    out = docs.transform(map_arrow, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
