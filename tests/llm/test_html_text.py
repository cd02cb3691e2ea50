import html
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillstone.llm.html_text import extract, lines_of, main_text, op8_html_line_blocks, spans_of

from .brute import rows

LONG = "A sentence that is long enough to be the main text of a page, with commas, and more words. "

CASES = {
    "": "",
    "   <!-- x --> ": "",
    "<p>One &amp; two&nbsp; three<br>four</p>": "One & two three four",
    "<article><h1>T</h1><p>a</p><p><b>b<br><p>c &lt;p&gt;</article><footer>f</footer>": "T a b c <p>",
    "<article><p>a<script>var t='</p>';</script>b</p><div class='ad box'>x<div>y</div></div><p>c</p></article>": "ab c",
    "<nav><a href=/>m</a></nav><main><header><h1>H</h1></header>text<form><input>f</form><section id=comments><article class=comment>no</article></section></main>": "H text",
    "<article><p>in<b>li</b>ne &eacute;&#233; x</p></article": "inline éé x",
    "<div class='ad'>never closed <article><p>still here</p></article>": "still here",
    "<article><a title=it's href='x>y'>a</a> <b title=\"z>c</b> d</article>": "a c d",
    "<div hidden>h</div><article>a<p style='display: none'>b</p></article>": "a",
    f"<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a><li><a href=4>four</a></ul><div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><table><tr><td><a>x</a><td><a>y</a><td><a>z</a></table>": f"{LONG}Short. {LONG}".strip(),
}


@pytest.mark.parametrize("page", CASES)
def test_pages(page):
    assert main_text(page) == CASES[page]


LINKED = {
    "<article><h1><a href=x>Title</a></h1><p>text</p><p><a href=y>Source</a></p></article>": "Title text Source",
    "<main><p>text</p><ul><li><a>r1</a><li><a>r2</a><li><a>r3</a><li><a>r4</a></ul><p>end</p></main>": "text r1 r2 r3 r4 end",
    f"<ul><li><a>m</a></ul><div><h1><a>Title</a></h1><p>{LONG}</p><p><a>r1</a></p><p><a>r2</a></p><p><a>r3</a></p><p><a>r4</a></p></div><ul><li><a>x</a><li><a>y</a><li><a>z</a></ul>": f"Title {LONG}r1 r2 r3 r4",
}


@pytest.mark.parametrize("page", LINKED)
def test_lines_of_links_in_the_text(page):
    assert main_text(page) == LINKED[page]


NAMED = {
    "<article class='post comments-open'><p>text</p></article>": "text",
    "<article class='post sponsored'><p>text</p></article>": "text",
    "<main><article class='promo'><p>text</p><article class=comment>no</article></article></main>": "text",
    "<div class='layout with-sidebar'><article>text</article></div>": "text",
    "<div class='no-sidebar'><div id='has-banner'><p>text</p></div></div>": "text",
    "<div class='layout sidebar'><article>text</article></div>": "text",
    "<div class='banner'><main>text</main></div>": "text",
    "<article>text</article><div class='comments'><article>no</article></div>": "text",
    "<div class='cookie-banner'>no</div><div id=comments>no</div><p>text</p>": "text",
}


@pytest.mark.parametrize("page", NAMED)
def test_names_of_parts(page):
    assert main_text(page) == NAMED[page]


WORDS = "word " * 59 + "word"
ROUND_ALL = {
    f"<body><form id=aspnetForm><nav>m</nav><article><p>{WORDS}</p><form>f</form></article><button>b</button></form></body>": WORDS,
    f"<body><form id=aspnetForm><nav>menu</nav><div><p>{WORDS}</p></div><select><option>o</select></form><p>x</p></body>": WORDS,
    f"<dialog open><main><p>{WORDS}</p></main></dialog>": WORDS,
    f"<dialog open><p>{WORDS}</p></dialog>": WORDS,
    f"<dialog><p>no {WORDS}</p></dialog><div><p>{WORDS}</p></div>": WORDS,
    f"<form hidden><p>no {WORDS}</p></form><div><p>{WORDS}</p></div>": WORDS,
    f"<form class=login><p>no {WORDS}</p></form><div><p>few</p></div>": "few",
    f"<form><p>no</p></form><div><p>{WORDS}</p></div>": WORDS,
    f"<form><p>no {WORDS}</p></form><article><p>few</p></article>": "few",
}


@pytest.mark.parametrize("page", ROUND_ALL)
def test_forms_and_dialogs_around_the_text(page):
    assert main_text(page) == ROUND_ALL[page]


def plain_spans(weights, width=3, surge=0.25, dive=1 / 32):
    """Line blocks by their definition."""
    block = lambda i: sum(weights[i : i + width])
    peak = max([block(i) for i in range(len(weights))], default=0)
    out, kept = [], set()
    for i in range(len(weights)):
        if i in kept or block(i) <= surge * peak:
            continue
        first = i
        while weights[first] * width <= surge * peak:
            first += 1
        end = first + 1
        while end < len(weights) and block(end) > dive * peak:
            end += 1
        if first not in kept:
            out.append((first, end))
            kept |= set(range(i, end))
    return out


def test_curve_against_brute_force():
    rng = random.Random(1)
    for n in range(200):
        weights = [rng.choice([0, 0, 0, 1, 5, 40, 200, 344]) for _ in range(n % 40)]
        assert spans_of(weights) == plain_spans(weights)


def unmarked(rng):
    """A page without an article tag, and its text: menus, links and imprints around paragraphs in one container."""
    words = lambda a, b: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(3, 9))) for _ in range(rng.randint(a, b)))
    text = [words(3, 8)] + [rng.choice([words(30, 90), words(30, 90), words(1, 3)]) for _ in range(rng.randint(4, 12))] + [words(30, 60)]
    links = lambda n: "".join(f"<li><a href=/{i}>{words(1, 4)}</a></li>" for i in range(n))
    page = f"<html><body><table><tr><td>{words(1, 2)}</td></tr></table><ul>{links(8)}</ul><div><h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:])
    return page + f"</div><ul>{links(rng.randint(4, 9))}</ul><table><tr><td>{words(1, 2)}</td></tr></table></body></html>", " ".join(text)


def test_pages_without_marks():
    """The curve finds the text; without it the menus would come along."""
    rng = random.Random(2)
    for _ in range(50):
        page, text = unmarked(rng)
        assert main_text(page) == text
        assert " ".join(x.text for x in lines_of(page) if x.text) != text


HOSTILE = {"tags": "<a" * 4000, "open": "<p class='ad'>x " * 8000, "marks": "<!" * 50_000, "quotes": "<a b=\"" * 30_000, "odd": "<a b='>" * 30_000, "deep": "<div class=ad>" * 30_000, "ends": "</div>" * 50_000, "scripts": "<script>" * 30_000, "equals": "<a " + "= " * 50_000 + ">", "mixed": "<b class=ad><div>" * 20_000 + "</b>" * 20_000, "number": "&#" + "9" * 100_000 + ";&#" + "0" * 5000 + "65;"}


@pytest.mark.parametrize("kind", HOSTILE)
def test_hostile_pages_take_linear_time(kind):
    page = HOSTILE[kind]
    began = time.process_time()
    main_text(page)
    once = time.process_time() - began
    assert once < 0.5
    began = time.process_time()
    main_text(page * 4)
    assert time.process_time() - began < 12 * once + 0.5


def test_numbers_beyond_characters():
    assert main_text("<article>&#00065;&#99999999;&#" + "0" * 5000 + "66;</article>") == "A\ufffdB"


def test_awkward_rows(spark):
    values = [(1, "u", None), (1, "u", ""), (None, None, "<article>x</article>"), (3, "v", "<article>" + "<p>y</p>" * 20000 + "</article>"), (4, "w", "<" * 5000), (5, "z", "<a" + " b" * 5000)]
    df = spark.createDataFrame(values, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r["page_id"], r["n_chars"]) for r in rows(extract(df))}
    assert {(1, 0), (None, 1), (3, 39999)} <= got and len(rows(extract(df))) == 6
    assert rows(extract(df.limit(0))) == []


def test_query(spark):
    """The tables' pages hold one article; everything else is outside of it."""
    sf = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in rows(op8_html_line_blocks(spark, sf))}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br|ul|li)>", body)]
        want = " ".join(b for b in blocks if b)
        assert (got[r.page_id]["text"], got[r.page_id]["n_chars"], got[r.page_id]["url"]) == (want, len(want), r.url)
