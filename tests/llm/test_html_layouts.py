"""Articles whole, and wrappers per layout."""

from sumtrail.llm import html_wrapper


def test_the_outermost_article_is_kept_whole(spark):
    page = "<body><nav><a href=/>n</a></nav><article><header><h1>Title {0}</h1></header><p>lead {0}</p><div class=content>{1}</div><p>end {0}</p></article></body>"
    rows = [(k, f"https://a.org/{k}", page.format(k, f"long text of page {k} " * 40)) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split() for r in html_wrapper.texts(df).collect()}
    for k in range(4):
        assert got[k] == f"Title {k} lead {k} {f'long text of page {k} ' * 40} end {k}".split()


def test_every_layout_has_its_wrapper(spark):
    one = "<body><div class=story><p>{0}</p></div></body>"
    other = "<body><div class=story><p>read on</p></div><section><p>{0}</p></section></body>"
    rows = [(k, f"https://a.org/{k}", (other if k % 10 == 9 else one).format(f"text of page {k} " * 30)) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split() for r in html_wrapper.texts(df).collect()}
    for k in range(40):
        assert " ".join(got[k]).endswith(" ".join((f"text of page {k} " * 30).split()))


def test_wrappers_are_packed_whole():
    page = "<body><ul><li>a<li>b</ul><p>x<p class=c>y</p></body>"
    root = html_wrapper.wrapper([page, page.replace("x", "z")])
    assert html_wrapper.pattern(html_wrapper.unpacked(html_wrapper.packed(root))) == html_wrapper.pattern(root)


def test_slots_and_constants_decide(spark):
    page = ("<body><article><h1>T {0}</h1><p>{1}</p><p>Get all of our best stories by mail</p><p>Background</p><div class=search>Found {0} things</div>"
            "<div class=legal>All ours</div></article></body>")
    rows = [(k, f"https://a.org/{k}", page.format(k, f"text of page {k} " * 20)) for k in range(6)]
    rows += [(100, "https://b.org/", page.format(100, "text " * 20))]
    # Copies of one page show nothing.
    rows += [(200 + k, f"https://c.org/{k}", page.format(200, "text " * 20)) for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text.split("\n\n") for r in html_wrapper.texts(df).collect()}
    for k in range(6):
        lines = [x for x in got[k] if x]
        assert lines == [f"T {k}", (f"text of page {k} " * 20).strip(), "Background", f"Found {k} things"]
    for k in (100, 200, 204):
        assert [x for x in got[k] if x] == [f"T {min(k, 200)}", ("text " * 20).strip(), "Get all of our best stories by mail", "Background"]
