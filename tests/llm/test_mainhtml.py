import html
import re

from scorelake.llm import mainhtml

SF = "/root/testdata/sf0.01"


def test_marked_articles_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1|li|ul|div)>", inner))
        want[r.page_id] = "\n".join(p for p in parts if p)
    found = mainhtml.extract(pages, mainhtml.train(pages)).collect()
    assert {r.page_id: r.text for r in found} == want
    assert all(r.n_chars == len(r.text) for r in found)


def test_odd_pages(spark):
    rows = [
        (1, None, "t"),
        (2, "", "t"),
        (3, "<body><nav><ul><li><a href=x>Menu words here</a></ul></nav><div><p>One &amp; two<p>th<b>re</b>e<br>four</div>", "t"),
        (4, "<div id='main'><h1>Head</h1><p>Body text here.</p><div class='comments'><p>I disagree with it</p></div></div>", "t"),
        (5, "<p>A < b <script>if (a<b) '</p>'</script> c <!-- no --> d <form>name <input></form><p>unclosed <a href='x", "t"),
        (6, "<article>x" + "<p>word</p>" * 20000 + "</article><footer>many words in a footer</footer>", "t"),
        (3, "<nav>only a menu</nav>", "t"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string")
    found = mainhtml.extract(pages, {}).select("page_id", "text", "n_chars").collect()
    got = {(r.page_id, r.text) for r in found if r.page_id != 6}
    assert got == {
        (1, ""),
        (2, ""),
        (3, "One & two\nthree four"),
        (3, ""),
        (4, "Head\nBody text here."),
        (5, "A < b c d\nunclosed"),
    }
    assert next(r.n_chars for r in found if r.page_id == 6) == 5 * 20000 + 1
    empty = pages.limit(0)
    assert mainhtml.extract(empty, mainhtml.train(empty)).count() == 0


def test_names_inside_the_article():
    page = (
        "<nav>menu</nav><article><h2 id='search-for-life'>Search for life</h2><p>First text.</p>"
        "<section id='social-history'><h3 id=legal>Legal</h3><p data-id='ad'>Second text.</p></section>"
        "<p class='post-header big'>Third <span class='skip-link'>text</span>.</p><p class='x share'>Share this</p><div role=search>Find</div>"
        "<svg class='a>b' viewBox=1 /><p>After the picture.</p><svg><text>drawn</text></svg><p>End.</p></article>"
    )
    want = "Search for life\nFirst text.\nLegal\nSecond text.\nThird text.\nAfter the picture.\nEnd."
    assert mainhtml.main_text(page, {}) == want
    assert mainhtml.main_text(page.replace("article>", "div>"), {}) == want


def test_doubtful_names_are_weighed_by_what_was_learned(spark):
    text = "<p>" + "many words of text " * 20 + "</p>"
    page = f"<article><div class='post-header'>{text}</div></article><div class='site-footer'><ul><li>{'far away ' * 30}</li></ul></div>"
    pages = spark.createDataFrame([(i, page) for i in range(5)], "page_id long, html string")
    weights = mainhtml.train(pages)
    assert weights["word", "p|1"] > 0 == weights["word", "li|1"]
    assert mainhtml.main_text(page.replace("article>", "div>"), weights) == ("many words of text " * 20).strip()


def test_best_run():
    assert mainhtml.best_run([-1, 2, -1, 3, -5, 3]) == (1, 4)
    assert mainhtml.best_run([-1, 0]) == (0, 0)
