"""Word model against the textbook, and scripts that a fixed alphabet folds together."""

from collections import Counter, defaultdict

import os
import random

import numpy as np

from sumtrail import session
from sumtrail.llm import quality_lm, word_lm


def textbook(texts):
    """p(word | two words before) of modified Kneser-Ney over words as they are written."""
    words = [["<s>", "<s>", *t.split(), "</s>"] for t in texts if t and t.split()]
    c3 = Counter(g for w in words for g in zip(w, w[1:], w[2:]))
    c2, c1 = Counter(), Counter()
    for (a, b, c), n in c3.items():
        c2[b, c] += n if b == "<s>" else 1
    for _, c in c2:
        c1[c,] += 1

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return 0.5, 0.75, 0.9
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return tuple(min(max(v, 0.05), k - 0.05) for v, k in zip(d, (1, 2, 3)))

    def p(gram):
        if not gram:
            return 1 / (len(c1) + 1)
        c = (c1, c2, c3)[len(gram) - 1]
        d, total, dropped = discounts(c), defaultdict(int), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            dropped[g[:-1]] += d[min(n, 3) - 1]
        if not total[gram[:-1]]:
            return p(gram[1:])
        n = c[gram]
        return (n - d[min(n, 3) - 1] if n else 0) / total[gram[:-1]] + dropped[gram[:-1]] / total[gram[:-1]] * p(gram[1:])

    return p


def test_perplexity_is_kneser_ney(spark):
    texts = ["the cat sat on the mat", "a dog and a cat sat", "the end the end the end", "слова и снова слова", "x", None, " "]
    asked = [*texts, "the dog sat on nothing", "и слова", "unknown only", "the the the"]
    model = word_lm.estimated(word_lm.counted(spark.createDataFrame([(t,) for t in texts], "text string")), quality_lm._discounts)
    docs = spark.createDataFrame([(k, "l", t) for k, t in enumerate(asked)], "doc_id long, lang string, text string")
    p = textbook(texts)
    for sizes in (word_lm.SIZES, word_lm.Sizes(block=3, shard_chars=4)):
        got = {r.doc_id: r for r in word_lm.scored(docs, model, sizes).collect()}
        assert len(got) == len(asked)
        for k, t in enumerate(asked):
            w = ["<s>", "<s>", *(t or "").split(), "</s>"]
            if len(w) == 3:
                assert (got[k].n_grams, got[k].perplexity) == (0, None)
                continue
            grams = list(zip(w, w[1:], w[2:]))
            assert got[k].n_grams == len(grams)
            assert np.isclose(got[k].perplexity, 2 ** -np.mean([np.log2(p(g)) for g in grams]), rtol=1e-9)


def test_scripts_are_not_folded(spark):
    good = ["кот сидит на окне и смотрит на двор", "собака лежит на дворе и смотрит на кота", "кот и собака сидят на окне"]
    # Letters two places on: other words, which are the same to an alphabet of code point parities.
    odd = "".join(chr(ord(c) + 2) if c.isalpha() else c for c in good[0])
    rows = [(k, "ru", t) for k, t in enumerate(good * 20)] + [(100, "ru", odd)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    kept = {r.doc_id: r.kept for r in quality_lm.classified(docs, docs.where("doc_id < 60").select("doc_id")).collect()}
    assert all(kept[k] for k in range(60)) and not kept[100]


def test_scripts_without_spaces():
    found = word_lm.words("猫が好き, ok", word_lm._Hashes())
    assert len(found) == 3 + 4 + 2


def test_words_of_all_texts_at_once():
    """The same words as one text at a time, also where marks and letters stand alone, and beyond the basic plane."""
    texts = ["the cat's 12 ab_c", None, "", " \n", "!฿฿ ฿!ก ั!", "猫が好き, ok 𠀀𠀁x", "a\x1cb\x85c...", "\ud800 x", "é é", "ab ba", "x" * 3_000]
    known = word_lm._Hashes()
    flat, sizes = word_lm.split(texts)
    other = np.concatenate([word_lm.words(t, known) for t in texts])
    assert sizes.tolist() == [len(word_lm.words(t, known)) for t in texts]
    pairs = set(zip(flat.tolist(), other.tolist()))
    assert len(pairs) == len(set(flat.tolist())) == len(set(other.tolist()))
    at = word_lm.triples(flat, sizes)
    assert len(at) == sum(max(0, n - 2) for n in sizes)


def test_slices_add_up(spark):
    """Any number of slices gives the same perplexities, copies and nulls included."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(40)] + ["a b c", "a b c", None, "unseen words"]
    df = spark.createDataFrame([(t,) for t in texts[:30]], "text string")
    docs = spark.createDataFrame([(k, "l", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    found = []
    for n in (1, 5):
        model = word_lm.estimated([word_lm.counted(df, part=(k, n)) for k in range(n)], quality_lm._discounts)
        found.append({r.doc_id: r for r in word_lm.scored(docs, model).collect()})
    assert len(found[0]) == len(texts)
    for k, r in found[0].items():
        assert found[1][k].n_grams == r.n_grams
        assert (r.perplexity is None) == (found[1][k].perplexity is None) == (r.n_grams == 0)
        assert r.perplexity is None or np.isclose(found[1][k].perplexity, r.perplexity, rtol=1e-9)


def test_little_stays_on_disk(spark):
    """What is written for the n-grams of the texts is gone when the perplexities are known."""
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(300)) for _ in range(400)) for _ in range(60)]
    docs = spark.createDataFrame([(k, "l", t) for k, t in enumerate(texts)], "doc_id long, lang string, text string")
    folder = session.shared_folder(spark).removeprefix("file://")

    def stored():
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)

    before = stored()
    assert quality_lm.classified(docs, docs.where("doc_id < 30").select("doc_id")).count() == 60
    assert stored() - before < 0.5 * sum(map(len, texts))


def test_counts_travel_as_arrays(spark):
    """Triples and values are a row per block and group, not a row each, which took most of the time."""
    rng = random.Random(5)
    texts = [" ".join(str(rng.randrange(200)) for _ in range(300)) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    counts = [word_lm.counted(df, part=(k, 2), parts=3) for k in range(2)]
    assert all(c.count() <= 2 * 3 for c in counts)
    model = word_lm.estimated(counts, quality_lm._discounts, 3)
    for k in range(2):
        values, name = word_lm.valued(model, (k, 2), 5)
        rows = values.collect()
        word_lm._dropped(spark, name)
        assert sorted(r.shard for r in rows) == list(range(5))
        for r in rows:
            grams = np.frombuffer(r.grams, np.uint64)
            assert (np.diff(grams.astype(object)) > 0).all() and set(word_lm.range_of(grams[:-1], 5)) == {r.shard}


def test_texts_are_split_a_few_times():
    """The slices are as many as the share that is learnt from needs; each splits all texts once."""
    assert word_lm.slices(50_000_000_000, 11_500_000_000) == word_lm.slices(800_000_000, 184_000_000) <= 4
    assert word_lm.slices(1_000_000_000, 1_000_000_000) == 17
    assert word_lm.slices(1_000, 1_000) == word_lm.slices(0, 0) == 1


def test_texts_in_chunks(spark):
    """Chunks of texts, blocks, groups and shards of any size give the same, copies and nulls included."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) for _ in range(60)] + ["a b c", "a b c", None, None, "", " "]
    df = spark.createDataFrame([(t,) for t in texts[:30]], "text string").repartition(3)
    docs = spark.createDataFrame([(k, "l", t) for k, t in enumerate(texts * 2)], "doc_id long, lang string, text string").repartition(3)
    found = []
    for n, parts, sizes in ((1, 1, word_lm.SIZES), (3, 7, word_lm.Sizes(block=5, shard_chars=50, slice_chars=20, asks=12))):
        model = word_lm.estimated([word_lm.counted(df, sizes, (k, n), parts) for k in range(n)], quality_lm._discounts, parts)
        found.append({r.doc_id: r for r in word_lm.scored(docs, model, sizes).collect()})
    assert len(found[0]) == len(found[1]) == 2 * len(texts)
    for k, r in found[0].items():
        n = len((texts * 2)[k].split()) if (texts * 2)[k] else 0
        assert r.n_grams == found[1][k].n_grams == (n + 1 if n else 0)
        assert (r.perplexity is None) == (found[1][k].perplexity is None) == (n == 0)
        assert n == 0 or np.isclose(found[1][k].perplexity, r.perplexity, rtol=1e-9)


def test_triples_of_a_slice():
    rng = np.random.default_rng(8)
    texts = [" ".join(map(str, rng.integers(0, 50, n))) for n in (3, 0, 1, 200, 0)]
    for some in (texts, [""], texts[2:3], []):
        flat, sizes = word_lm.split(some) if some else (np.empty(0, np.int64), np.zeros(0, np.int64))
        every = word_lm.triples(flat, sizes)
        for n in (1, 3, 7):
            own = word_lm.slice_of(flat[every + 1], n)
            assert all(word_lm.middles(flat, sizes, (k, n)).tolist() == every[own == k].tolist() for k in range(n))


def test_values_found():
    rng = np.random.default_rng(7)
    for shards, shard, n in ((1, 0, 1000), (7, 3, 500), (24, 23, 3), (5, 0, 0)):
        every = rng.integers(0, 2**64, 200_000, dtype=np.uint64)
        # Neighbours, and both ends.
        every = np.unique(np.concatenate([every, every[:500] + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)]))
        own = every[word_lm.range_of(every, shards) == shard]
        grams = np.sort(rng.choice(own, n, replace=False)) if n else own[:0]
        values = rng.random(n)
        known = dict(zip(grams.tolist(), values.tolist()))
        got = word_lm.found(np.append(grams, np.uint64(2**64 - 1)), np.append(values, 0.0), own, shards)
        assert got.tolist() == [known.get(g, 0.0) for g in own.tolist()]
    assert word_lm.found(own[:0], values[:0], own, 5).tolist() == [0.0] * len(own)
