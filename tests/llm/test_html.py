import html as entities
import re

import pytest

from tidemark.llm import html
from tidemark.llm.shared import table


@pytest.fixture(scope="module")
def field(spark):
    from tidemark.llm.shared import workers_import

    workers_import(spark)
    return html.train(table(spark, "/root/testdata/sf0.01", "pages"))


def article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)>", inner)
    texts = [re.sub(r"\s+", " ", entities.unescape(re.sub("</?b>", "", p))).strip() for p in parts]
    return "\n".join(t for t in texts if t)


def test_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    found, name = html.extract(pages)
    rows = found.collect()
    assert all(r[name] == article(r["html"]) for r in rows)


SIDES = (
    "<nav><a href='/a'>Home</a> <a href='/b'>About us</a></nav>",
    "<aside class='sidebar'><h3>More</h3><ul><li><a href='/c'>Other story of the day</a></li></ul></aside>",
    "<div class='cookie-banner'>We use cookies to improve this site.</div>",
    "<form><label>Search</label><input name='q'><button>Go</button></form>",
    "<section class='comments'><p>I like this very much, said a reader.</p></section>",
    "<header><p>The Daily Name</p></header><footer>&copy; 2020 Name</footer>",
)


@pytest.mark.parametrize("main", ["article", "main", "div class='content'", "div id='main-content'", "section class='post'"])
def test_containers_of_other_names(field, main):
    paragraphs = [f"Paragraph {i} has words, commas and an end; it is about as long as text on pages tends to be." for i in range(4)]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    page = f"<html><body>{SIDES[0]}{SIDES[5]}<{main}><h1>Title of it all</h1>{body}</{main.split()[0]}>{''.join(SIDES[1:5])}</body></html>"
    assert html.main_text(page, field) == "\n".join(["Title of it all", *paragraphs])


def test_blocks():
    page = (
        "<title>t</title><script>var x='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>A &amp; b&nbsp;&lt;c&gt;\n <b>bold</b>"
        "<br>next<p>Second &#233;<ul><li>x<li>y</ul><template>no</template>tail <a href='>'>link</a><img src=x>"
    )
    assert [b.text for b in html.blocks_of(page)] == ["A & b <c> bold next", "Second é", "x", "y", "tail link"]


@pytest.mark.parametrize("page", [None, "", "   ", "no markup at all", "<p>", "<<<>>", "</div></div>x<", "<!-- open", "<script>open"])
def test_odd_pages_do_not_fail(field, page):
    assert isinstance(html.main_text(page, field), str)


def test_tables(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<article><p>Text of a page.</p></article>", "x"), (2, "u", "<p>a" * 3000, "x")]
    schema = "page_id long, url string, html string, text string"
    found, name = html.extract(spark.createDataFrame(rows, schema))
    assert name != "text"
    got = html.digest(found, name).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html.extract(spark.createDataFrame([], schema))[0].count() == 0
