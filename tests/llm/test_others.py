"""Quality model, url filter, code search, page texts and language."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumtrail.llm import hamming_search, html_wrapper, language, quality_lm, url_filter

# -- quality model ------------------------------------------------------------


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def plain_kneser_ney(texts, order=3):
    """p(symbol | context) by the textbook, for all n-grams of the highest order."""
    from collections import Counter, defaultdict

    counts = {order: Counter(g for t in texts for g in quality_lm.grams(t, order).tolist())}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g % 64**k for g in counts[k + 1])

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not n[0] or not n[1]:
            return 0.5, 0.75, 0.9
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        return tuple(min(max(v, 0.05), k - 0.05) for v, k in zip(d, (1, 2, 3)))

    p = None
    for k in range(1, order + 1):
        d = discounts(counts[k])
        total, dropped = defaultdict(int), defaultdict(float)
        for g, n in counts[k].items():
            total[g // 64] += n
            dropped[g // 64] += d[min(n, 3) - 1]
        low, p = p, None

        def prob(g, k=k, d=d, total=total, dropped=dropped, low=low):
            below = 1 / 64 if low is None else low(g % 64 ** (k - 1))
            c = g // 64
            if not total[c]:
                return below
            n = counts[k][g]
            return (n - d[min(n, 3) - 1] if n else 0) / total[c] + dropped[c] / total[c] * below

        p = prob
    return p


def test_model_is_kneser_ney(spark):
    texts = ["the cat sat on the mat.", "a dog and a cat", "the end; the beginning", "Wörter über Wörter", "x"]
    model = quality_lm.Model(order=3)
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string")
    scorer = quality_lm.scorer(quality_lm.estimated(quality_lm.counted(df, model), model), model)
    p = plain_kneser_ney(texts)
    rng = random.Random(1)
    for g in [g for t in texts for g in quality_lm.grams(t, 3).tolist()] + [rng.randrange(64**3) for _ in range(500)]:
        assert np.isclose(2.0 ** float(scorer.log2[g]), p(g), rtol=1e-4)
    sums = (2.0 ** scorer.log2.astype(float)).reshape(-1, 64).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-3)


def test_classifier(spark, docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_lm.classified(docs, labels.where("quality = 1 and toxic = 0")).join(labels, "doc_id").toPandas()
    assert rows[(rows.quality == 1)].kept.mean() > 0.95
    assert rows[(rows.quality == 0)].kept.mean() < 0.3


def test_classifier_edges(spark):
    rows = [(1, "good text of words and more words", "en", 1), (2, None, "en", 1), (3, "", None, 1), (None, "good text", None, 1), (5, "§§§", "xx", 1),
            (6, "word " * 50_000, "en", 1), (1, "good text of words and more words", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    ids = spark.createDataFrame([(1, 0), (1, 0), (None, 0)], "doc_id long, n int")
    got = quality_lm.classified(df, ids).collect()
    assert len(got) == 7
    assert {r.doc_id for r in got if r.kept} >= {1}
    assert not [r for r in got if r.doc_id in (2, 3, 5) and r.kept]
    assert not [r for r in quality_lm.classified(df, ids.limit(0)).collect() if r.kept]
    assert quality_lm.classified(df.limit(0), ids).count() == 0


# -- url filter ---------------------------------------------------------------


def test_urls(spark):
    cases = {
        "http://WWW.Example.com/en/x?q#f": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://m.example.com/en/": ("m.example.com", "/en/", "example.com/en/", "block"),
        "https://example.com/english": ("example.com", "/english", "com/", "allow"),
        "https://example.com": ("example.com", "", None, "allow"),
        "https://a.net/es/1": ("a.net", "/es/1", "net/es/", "block"),
        "https://planet/es/1": ("planet", "/es/1", None, "allow"),
        "http://x.org?casino": ("x.org", "", None, "block"),
        "http://x.org/casinos": ("x.org", "/casinos", None, "allow"),
        "http://cheap.org/free-loan": ("cheap.org", "/free-loan", None, "block"),
        "http://x.org/free": ("x.org", "/free", None, "allow"),
        "http://x.org/free/free-free": ("x.org", "/free/free-free", None, "allow"),
        "x://y://z/a": ("y:", "//z/a", None, "allow"),
        "no scheme.com/": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://É.com/\ncasino": ("É.com", "/\ncasino", "com/", "allow"),
        "http://a.org/" + "a" * 50_000 + "/porn": ("a.org", "/" + "a" * 50_000 + "/porn", None, "block"),
    }
    df = spark.createDataFrame([(k, u, 1, "h") for k, u in enumerate(cases)] * 2, "page_id long, url string, rule int, host string")
    got = {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judged(df).collect()}
    assert got == cases
    assert url_filter.judged(df.limit(0)).count() == 0


# -- code search --------------------------------------------------------------


def test_search_is_exact(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**63), 2**63 - 1, 40)
    codes = [int(x) ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 12))) for x in rng.choice(base, 600)]
    codes = [((c + 2**63) % 2**64) - 2**63 for c in codes] + [7] * 60  # many copies of one code
    rows = list(enumerate(codes))
    df = spark.createDataFrame(rows + [(None, 7), (9_999, None)] + rows[:5], "id long, code long")
    queries = df.where("id % 20 = 0")
    for k in (1, 10):
        got = sorted(tuple(r) for r in hamming_search.neighbours(df, queries, k).collect())
        want = []
        for q, c in rows:
            if q % 20 == 0:
                near = sorted((bin((c ^ x) & (2**64 - 1)).count("1"), i) for i, x in rows if i != q)[:k]
                want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
        assert got == sorted(want)
    few = df.where("id < 3")
    assert hamming_search.neighbours(few, few, 10).count() == 6
    assert hamming_search.neighbours(df.limit(0), df.limit(0), 10).count() == 0


# -- pages --------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<div class="cookie-notice">We use cookies <button>OK</button></div><nav><ul><li><a href=/a>{0} link</a><li><a href=/b>b</a></ul></nav>
<!-- <p>no</p> --><div id="{3}"><h1>{0} &amp; title</h1><p>First   para&nbsp;{1}<br>of it.<p>{2} <b>bold</b>er &lt;tag&gt; <form><input name=x>send</form>
<ul><li>one<li>two</ul><div class="share">tweet</div></div><aside><p>{2} aside text that goes on and on and on and on</p></aside>
<section id="comments"><p>I like it {1}</p></section><footer>&copy; f</footer></body>"""


def want(a, b, c):
    return f"{a} & title\n\nFirst para {b} of it.\n\n{c} bolder <tag>\n\none\n\ntwo"


def test_pages(spark):
    rows = [(k, f"https://h.org/{k}", PAGE.format(f"A{k}", "bee " * (k + 1), f"Sea {k} water " * (3 + k), "main-column" if k % 2 else "x9"), "n") for k in range(8)]
    rows += [(20, "http://one.org/", "<p>Alone on its host.<p>Two", "n"), (21, "http://n.org/", None, "n"), (22, "http://n.org/", "  ", "n"), (None, None, "plain text", None),
             (24, "http://art.org/1", "<nav>m</nav><article><header><h1>T</h1></header><p>x <a href=q>link</a> y</article><footer>f</footer>", "n"),
             (24, "http://art.org/1", "<nav>m</nav><article><header><h1>T</h1></header><p>x <a href=q>link</a> y</article><footer>f</footer>", "n"),
             (25, "http://long.org/", "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>", "n"), (26, "http://odd.org/", '<p class="x>broken <b <p>y</p>' * 50, "n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_wrapper.texts(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k in range(8):
        assert by[k].text == want(f"A{k}", " ".join(["bee"] * (k + 1)), " ".join([f"Sea {k} water"] * (3 + k)))
    assert by[20].text == "Alone on its host.\n\nTwo"
    assert (by[21].text, by[22].text, by[None].text) == ("", "", "plain text")
    assert by[24].text == "T\n\nx link y"
    assert by[25].text == "\n\n".join(["word & word"] * 20_000)
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_wrapper.texts(df.limit(0)).count() == 0


def test_wrapper_is_union_free():
    page = "<html><body><ul>{}</ul>{}<p>{}</p></body></html>"
    root = html_wrapper.wrapper([page.format("<li>a<li>b", "", "x"), page.format("<li>c", "<div class=note>n</div>", "y"), page.format("<li>a<li>q<li>r", "", "z")])
    assert html_wrapper.pattern(root) == "<html><body><ul>(<li>#)+(<div note>#c)?<p>#"


# -- language -----------------------------------------------------------------


def test_held_out_accuracy(spark, docs):
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = language.fit(docs.where(fold != 0))
    got = language.identified(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(fold == 0).toPandas()
    assert len(got) > 20
    assert (got.lang == got.lang_pred).mean() >= 0.95
    assert got.score.between(0, 1).all()


def test_language_edges(spark, docs):
    model = language.fit(docs)
    rows = [(1, None, "de"), (2, "", "de"), (3, "12 + 34!", "de"), (None, "the cat and the dog are in the house", None), (5, "日本語のテキスト", None), (6, "der " * 100_000, None), (6, "der " * 100_000, None),
            (7, "𝒳𝒴 𐍈", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r.doc_id: r for r in language.identified(df, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 2, 3))
    assert all(got[k].lang_pred in model.languages for k in (None, 5, 6, 7))
    assert language.identified(df.limit(0), model).count() == 0
    none = language.fit(docs.limit(0))
    assert none is None
    assert {r.lang_pred for r in language.identified(df, none).collect()} == {"und"}
    assert language.fit(spark.createDataFrame([(None, "de"), ("x", None), ("12", "de")], "text string, lang string")) is None


def test_kernel():
    a, b = language.present("abc abd"), language.present("abd")
    common = len(np.intersect1d(a, b))
    model = language.trained([(a, "x"), (b, "y")])
    k = model.kernel([a, b])
    assert np.isclose(k[0, 1], common / np.sqrt(len(a) * len(b)))
    assert np.allclose(np.diag(k), 1)
