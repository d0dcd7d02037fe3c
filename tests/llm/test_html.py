"""Main text of pages: parser cases and held-out accuracy of the labeller."""

import time
from collections import Counter

from loglode.llm.html_blocks import blocks
from loglode.llm.html_text import FURNITURE, TRAIN_PAGES, fit, main_text, rule_label

SF = "/root/testdata/sf0.1"


def test_blocks():
    page = """<!DOCTYPE html><head><title>T &lt;</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><a href="x>y">One</a></nav><!-- <p>no</p> --><article><p>First <b>bold</b><br>line &amp more<p>second &eacute;\n\t end</article><p>cut <fo"""
    found = blocks(page)
    assert [(b.path[-1], b.text) for b in found] == [("title", "T <"), ("nav", "One"), ("p", "First bold line & more"), ("p", "second é end"), ("p", "cut")]
    assert found[1].linked == 3 and "article" not in found[4].path
    assert blocks(None) == blocks("") == blocks("<div></div> \n") == [] and blocks("a < b")[0].text == "a < b"
    deep = blocks("<div>" * 3000 + "text" + "</div>" * 3000)
    assert len(deep) == 1


def test_main_text_on_pages_not_trained_on(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html = {r.page_id: r.html for r in pages.select("page_id", "html").collect()}
    got = {r.page_id: r for r in main_text(pages).collect()}
    want = {i: "\n".join(b.text for b in blocks(h) if rule_label(b)) for i, h in html.items()}
    wrong = [i for i in want if got[i].text != want[i] or got[i].n_chars != len(want[i])]
    assert len(want) > 10 * TRAIN_PAGES and len(wrong) <= 0.001 * len(want)


def test_furniture_and_odd_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    para = "<p>This is a longer paragraph of the article, with words enough to be read.</p>"
    page = f"<html><body><header><a href=/>Site</a></header><article><h1>Head</h1>{para}<div class='comments'><p>Nice post!</p></div>{para}</article><aside><p>Related</p></aside><footer>c</footer>"
    odd = spark.createDataFrame([(9001, None, None), (9002, "u", ""), (None, "u", page), (9003, "u", page), (9003, "u", page)], base.schema)
    got = main_text(base.union(odd).selectExpr("*", "'x' AS text", "1 AS n_chars"))
    rows = [r for r in got.collect() if r.page_id is None or r.page_id > 9000]
    assert {r.text for r in rows if r.page_id in (9001, 9002)} == {""} and len(rows) == 5
    assert {r.text.split("\n")[0] for r in rows if r.page_id not in (9001, 9002)} == {"Head"}
    assert all("Site" not in r.text and "Related" not in r.text and "Nice" not in r.text for r in rows)
    assert main_text(base.where("false")).count() == 0 and "comments" in FURNITURE


def test_hostile_markup_takes_time_in_proportion():
    start = time.time()
    n = 100_000
    pages = ["<a" * n, "<div>" * n + "</p>" * n, '<a ">"' * n, "<p>x" * n, "<!--" * n, "<script>" * n, "</script" * n, "<" * n, "<div class='" + "a " * n + "'>" + "<p>b</p>" * 1000]
    for page in pages:
        blocks(page)
    assert time.time() - start < 20
    assert [b.text for b in blocks("<p title=\"a>b\">one<p t='>two")] == ["one", "two"]


PARA = "<p>This is a longer paragraph of the story, with words enough in it to be read as a whole text.</p>"
HOLDERS = ["<div class='post-content'>%s</div>", "<div id='content'>%s</div>", "<section class='story'>%s</section>", "<div>%s</div>"]


def test_pages_without_article_and_with_telling_body_classes(spark):
    """Markup that holds no article: known holders, and on held-out pages names no training page has."""
    base = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    weights = fit(base)
    body = "<html><body%s><nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav>%s<footer>&copy; 2020 The site</footer></body></html>"
    pages = [body % ("", h % (PARA * 4)) for h in HOLDERS] + [body % (" class='no-sidebar'", f"<article>{PARA * 4}</article>")]
    odd = spark.createDataFrame([(i, "u", p) for i, p in enumerate(pages)], base.schema)
    got = {r.page_id: r.text for r in main_text(odd, weights).collect()}
    assert set(got.values()) == {"\n".join([PARA[3:-4]] * 4)}
    plain = [(r.page_id, r.url, r.html) for r in base.where("page_id % 7 = 3").collect()]
    for name in ("<div class='prose'>", "<div id='haupttext'>", "<td>"):
        other = [(i, u, p.replace("<article>", name).replace("</article>", "</div>")) for i, u, p in plain]
        right = total = 0
        text = {r.page_id: r.text.split("\n") for r in main_text(spark.createDataFrame(other, base.schema), weights).collect()}
        for i, _, p in plain:
            want = [b.text for b in blocks(p) if rule_label(b)]
            rest = [b.text for b in blocks(p) if not rule_label(b)]
            right += sum((Counter(want) & Counter(text[i])).values()) + len(rest) - sum((Counter(text[i]) - Counter(want)).values())
            total += len(want) + len(rest)
        print(name, right / total)
        assert right >= 0.95 * total
