"""BPE against the public library, and on hostile texts."""

import hashlib
import random

import pytest

tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from sumtrail.llm import bpe  # noqa: E402

PATH = corpus_pipeline.vocabulary()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load(PATH))


def texts():
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzABC!?.0é ß'"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))) for _ in range(60)]
    return made + [
        "", "  \n", "Hello  World's 12 Été", "a<|endoftext|>B <|startoftext|>", "ΑΣ Σς xİ ﬁ é", "🙂!! 日本語 x\x85y \x1c\x00z",
        "a" * 3_000, "ab" * 2_000 + "!" * 500, "''s 're've 'lla", "don't DON'T", "﻿x​y",
    ]


def want(library, text):
    made = library.encode(text, add_special_tokens=False)
    return made.ids, library.decode(made.ids, skip_special_tokens=False)


def test_same_as_library(library, encoder):
    cases = texts()
    for text, (n, ids, decoded) in zip(cases, encoder.encode(cases)):
        expected, plain = want(library, text)
        assert list(bpe.np.frombuffer(ids, "<u4")) == expected, text
        assert (n, decoded) == (len(expected), plain)
        assert bpe.decode(encoder.v, ids) == plain


def test_speculation_agrees_with_merging(encoder):
    rng = random.Random(9)
    found = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 16))) for _ in range(3_000)]
    encoder.encode([" ".join(found)])
    right = sum(encoder.propose(w) == encoder.merged(w) for w in found)
    assert 0 < right < len(found)  # both ways occur
    for w in found:
        assert list(bpe.np.frombuffer(encoder.known[w][1], "<u4")) == encoder.merged(w)


def test_text_comes_from_the_ids(library):
    """A wrong id must show in the decoded text, whatever word it stands for."""
    encoder = bpe.Encoder(bpe.Vocabulary.load(PATH))
    encoder.encode(["plain words"])
    other = encoder.encode(["strange"])[0]
    word = next(w for w in encoder.known if w.startswith("plain"))
    encoder.known[word] = other[:2]
    (n, ids, text), = encoder.encode(["plain words"])
    assert text == library.decode(list(bpe.np.frombuffer(ids, "<u4")), skip_special_tokens=False)
    assert text.startswith(other[2]) and "plain" not in text
    assert encoder.decode([b"", ids, b""]) == ["", text, ""]
    with pytest.raises(IndexError):
        encoder.decode([bpe.np.array([len(encoder.v.texts)], "<u4").tobytes()])


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "Same text", None), (5, "Same text", "y"), (6, "word " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.encoded(df, PATH, digests=True)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"]
    out = got.collect()
    assert len(out) == 6
    for r in out:
        ids, plain = want(library, r.text or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()
    assert bpe.encoded(df.limit(0), PATH).count() == 0


def test_short_words_are_encoded_side_by_side(library):
    """No call per word, however many new words a text has."""
    encoder = bpe.Encoder(bpe.Vocabulary.load(PATH))
    rng = random.Random(12)
    words = ["".join(rng.choice("aeinorstzé日'!0") for _ in range(rng.randint(1, 14))) for _ in range(2_000)]

    def alone(word):
        raise AssertionError(word)

    encoder.propose = encoder.merged = alone
    text = " ".join(words)
    (n, ids, decoded), = encoder.encode([text])
    expected, plain = want(library, text)
    assert list(bpe.np.frombuffer(ids, "<u4")) == expected
    assert (n, decoded) == (len(expected), plain)


def test_side_by_side_is_the_same_as_alone(encoder):
    rng = random.Random(13)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 40))) for _ in range(500)] + ["a", "aaaa", "a" * 48, "zq"]
    data = [w.encode() for w in words]
    assert encoder.merged_short(data) == [encoder.merged(w) for w in words]
    flat, sizes = encoder.propose_short(data)
    ends = bpe.np.cumsum(sizes)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes)] == [encoder.propose(w) for w in words]


def test_quick_split_is_the_same(encoder):
    plane = "".join(map(chr, range(1 << 16)))
    assert encoder.plane_words is not None
    assert encoder.split(plane) == encoder.words.findall(plane)
    for text in ("a🙂b \x1c\x85 c", "d'll١२3x", " "):
        assert encoder.split(text) == encoder.words.findall(text)
    assert bpe.plane_pattern(r"[\p{Lu}]+") is None
    assert bpe.plane_pattern(r"\s+|[\p{L}]+") is None
