import re

import numpy as np

from gridspark.llm import html as H

SF = "/root/testdata/sf0.01"


def plain(source):
    """The article of the test pages by their own marks."""
    m = re.search(r"<article>(.*)</article>", source, re.S)
    blocks = re.split(r"<(?:p|/p|br|h1|/h1)>", m[1])
    clean = (" ".join(H.entities.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = H.QUERY(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and r.text == plain(pages[r.page_id].html)


def test_decoding_never_contradicts():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        page = H.Page(["#"] * n, [""] * n, [-1, *(int(rng.integers(0, i)) for i in range(1, n))])
        keep = H.decode(page, rng.normal(size=n) * 3)
        for i in range(1, n):
            chain, p = [], page.parent[i]
            while p >= 0:
                chain.append(bool(keep[p]))
                p = page.parent[p]
            if keep[i] and chain and not chain[0]:  # starts a kept part: nothing above was kept
                assert not any(chain)


def test_odd_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = H.train(pages)
    rows = [
        (1, "u", None, 1),
        (2, None, "", 1),
        (3, "u", "no markup &amp; at   all", 1),
        (4, "u", "<p><b>broken <a href='x>y'>&lt;i&gt;", 1),
        (5, "u", "<div>" * 3000 + "deep", 1),
        (5, "u", "<div>" * 3000 + "deep", 1),
        (6, "u", "<<<>>><!-- never closed <script>var x = '</div>'", 1),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    for m in (model, None):
        got = H.extract(df, m).collect()
        assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
        assert {r.text for r in got if r.page_id < 3} == {""}
    assert H.extract(df.limit(0), model).count() == 0 and H.train(df.limit(0)) is None


def test_other_layouts():
    body = "".join(f"<p>Sentence number {i}, with words, and more words. It goes on.</p>" for i in range(8))
    source = f"<html><body><header>Site</header><div class='menu'><a href=/>Home</a></div><div class='post-content'>{body}<div class='ad'>Buy</div></div><aside>More</aside><form>Mail <input></form><div id='comments'><p>First!</p></div></body></html>"
    page = H.parse(source)
    text = H.render(page, H.decode(page, H.log_odds(None, H.describe(page))))
    assert "Sentence number 7" in text and not re.search("Site|Home|Buy|More|Mail|First", text)


def test_broken_markup_costs_its_length():
    import time

    began = time.process_time()
    for source in ("<a " * 20_000, "<script " * 20_000, "<! " * 20_000, "<div>" * 10_000 + "</p>" * 10_000, "<a \"'" * 20_000, "<span>" * 10_000 + "<div>" * 10_000):
        H.render(page := H.parse(source), [True] * len(page.tag))
    assert time.process_time() - began < 20


def test_clashing_columns_and_repeated_rows(spark):
    page = "<html><body><nav>menu</nav><article><p>The text of it &amp; more.</p></article></body></html>"
    rows = [(1, "u", page, "x", 5), (1, "u", page, "x", 5), (None, None, None, "x", 5)]
    got = H.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), None).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "The text of it & more.", 22), (1, "The text of it & more.", 22)]


def test_very_many_attributes():
    """No number of attributes turns a tag into text, and broken tags stay linear."""
    import time

    for n in (249, 251, 5000):
        many = " ".join(f'd{i}="v{i} > <"' for i in range(n))
        page = H.parse(f"<body><div {many}>in<script {many}>var a = 1;</script></div {many}>out</body>")
        assert [t for _, _, t in page.texts] == ["in", "out"], n
        assert page.tag == ["#", "body", "div"]
    began = time.perf_counter()
    for broken in ('<a "' * 60_000, "<a '\"" * 60_000, '<a x="1" ' * 60_000, "<" * 100_000, '<script a="' * 30_000):
        H.parse(broken)
    assert time.perf_counter() - began < 20


def _bare(source):
    """A page without telling tags, classes, ids and roles."""
    source = re.sub(r"<(/?)(article|nav|header|footer|aside|form|main)\b", r"<\1div", source, flags=re.I)
    return re.sub(r"\s(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", source, flags=re.I)


def test_pages_without_any_marks(spark):
    """Nothing marked in the whole table: labels come from the densest node, and the trees still find nearly every article."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    want = {r["page_id"]: H.render(p, H.own_labels(p) > 0) for r in rows if H.own_labels(p := H.parse(r["html"])) is not None}
    bare = [(r["page_id"], r["url"], _bare(r["html"])) for r in rows]
    assert all(H.own_labels(H.parse(h)) is None for _, _, h in bare) and len(want) > 200
    pages = spark.createDataFrame(bare, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(pages, H.train(pages)).collect()}
    right = sum(got[k] == t for k, t in want.items())
    assert right >= 0.97 * len(want), right


def test_other_layouts():
    """Tables, lists and bare paragraphs as articles, beside link lists and short notices."""
    para = "This is a sentence of the article, and it goes on for a while. " * 4
    for open_, close in (("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<section><div>", "</div></section>")):
        body = "".join(f"<p>{para}{k}</p>" for k in range(5))
        page = H.parse(f"<body><div><a href=x>Home</a> <a href=y>News</a></div><div>Buy now!</div>{open_}{body}{close}<div><p>one reader said so</p></div></body>")
        text = H.render(page, H.dense_labels(page) > 0)
        assert text == "\n".join(f"{para}{k}" for k in range(5))
    assert H.dense_labels(H.parse("")) is None and H.dense_labels(H.parse("<div><a>only links</a></div>")) is None
