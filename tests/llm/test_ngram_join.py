"""The join against brute force over all pairs."""

import random
import re

import numpy as np

from sumtrail.llm import ngram_join
from sumtrail.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width=5):
    """doc_id to (set size, smallest reachable doc_id)."""
    sets = {}
    for i, text in rows:
        ws = tuple(re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)))
        sets[i] = set() if not ws else {ws[k : k + width] for k in range(max(1, len(ws) - width + 1))}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def made():
    """Copies, chains of near copies, shared passages, short texts and borderline sizes."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    line = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = ["", None, "  ", "one", "one", "One", "one two three", "a b c d e", "a b c d e f", "A B C D E F"]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append("\n".join([" ".join(base[: len(base) // 2]), " ".join(base[len(base) // 2 :])]))
        if rng.random() < 0.5:
            texts.append(line + " " + " ".join(rng.choice(vocabulary) for _ in range(40)))
    core = [rng.choice(vocabulary) for _ in range(300)]
    for _ in range(40):  # a large group of near copies
        near = list(core)
        for _ in range(rng.randint(0, 7)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    texts += [" ".join(f"s{k}" for k in range(n)) for n in range(5, 40)]  # sizes around the bound
    order = list(range(100, 100 + len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts))


def test_against_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    for settings in (ngram_join.JOIN, ngram_join.Join(broadcast_rows=0, broadcast_bytes=0, frequent=2)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.grouped(df, settings).collect()}
        assert got == want
    assert len({c for _, c in want.values()}) < len(want)
    kept = {r.doc_id for r in ngram_join.deduplicated(df).collect()}
    assert kept == {c for _, c in want.values()}


def test_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again"
    rows = [(None, text, 1, 1, "a"), (4, text, 2, 2, "b"), (3, text.upper(), 3, 3, "c"), (3, text.upper(), 3, 3, "c"), (9, None, 1, 1, None),
            (8, "", 1, 1, None), (8, "", 1, 1, None), (7, "word " * 100_000, 1, 1, None), (2, "word " * 90_000, 1, 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, node int, token string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.grouped(df).collect()), key=str)
    assert got == sorted([(None, 6, None), (4, 6, 3), (3, 6, 3), (3, 6, 3), (9, 0, 9), (8, 0, 8), (8, 0, 8), (7, 1, 2), (2, 1, 2)], key=str)
    kept = ngram_join.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 8, 9, None]
    assert ngram_join.grouped(df.limit(0)).count() == 0
    assert ngram_join.deduplicated(df.limit(0)).count() == 0


def test_rows_that_share_a_doc_id_keep_their_texts(spark):
    text = lambda s: " ".join(f"{s}{k}" for k in range(12))
    rows = [(3, text("a")), (5, text("a")), (5, text("b")), (5, text("c")), (5, text("c").upper()), (5, text("c")), (5, None), (6, text("b"))]
    kept = [(r.doc_id, (r.text or "").lower()) for r in ngram_join.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(kept) == [(3, text("a")), (5, ""), (5, text("b")), (5, text("c"))]


def test_frequent_shingles_are_counted_over_all_texts(spark):
    texts = [" ".join(f"d{d}w{k}" for k in range(30)) + " one passage of five words" for d in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    shingler = ngram_join.Shingler()
    head = [ngram_join.prefix_size(len(s), 80) * 2 for s in map(shingler, texts)]
    seen = {}
    for t, n in zip(texts, head):
        for token in shingler(t)[:n]:
            seen[token] = seen.get(token, 0) + 1
    for least in (1, 2, 8):
        got = ngram_join.frequent_shingles(df, ngram_join.Join(frequent=least))
        assert list(got) == sorted(k for k, n in seen.items() if n >= least)
    assert len(ngram_join.frequent_shingles(df, ngram_join.Join(frequent=1, frequent_bytes=80))) <= 10


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.7, 1)], rng.integers(-(2**62), 2**62, n // 8)]))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 80 * (len(a) + len(b) - both):
            wide = [ngram_join.bitmap(x, max(512, 1 << (len(x) - 1).bit_length())) for x in (a, b)]
            assert ngram_join.bounded(len(a), len(b), wide[0].tobytes(), wide[1].tobytes(), 80)
            frequent = np.sort(np.concatenate([a[::7], b[::5]]))
            heads = [ngram_join.first_shingles(x, frequent, ngram_join.prefix_size(len(x), 80)) for x in (a, b)]
            assert len(np.intersect1d(*heads))
            first = next(i for i, token in enumerate(heads[0]) if token in heads[1])
            left = [len(a) - first, len(b) - int(np.flatnonzero(heads[1] == heads[0][first])[0])]
            assert 100 * min(left) >= 80 * (len(a) + len(b) - min(left))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 470)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}


def test_only_hashes_of_several_sets_become_rows(spark):
    rng = random.Random(8)
    texts = [" ".join(f"t{k}x{j}" for j in range(rng.randint(20, 60))) for k in range(60)]
    texts += [f"{t} and some more" for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    join = ngram_join.Join(block=100, shard=20)
    shingler, frequent = ngram_join.Shingler(), ngram_join.frequent_shingles(df, join)
    owners = {}
    for s in map(shingler, texts):
        for k, token in enumerate(ngram_join.first_shingles(s, frequent, ngram_join.prefix_size(len(s), 80)).tolist()):
            owners.setdefault(token, set()).add((ngram_join.identity(s), len(s) - k))
    every, blocks = ngram_join.sets(df, join)
    assert every.count() == len(texts) and blocks.count() > 3
    got = {}
    for r in ngram_join.members(blocks, join).collect():
        got.setdefault(r.token, set()).add((r.node, r.left))
    assert got == {t: o for t, o in owners.items() if len(o) > 1}
    assert 0 < len(got) < len(owners) / 2
