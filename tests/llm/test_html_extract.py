"""Main text of made pages and of hard cases: weights, ties, attributes, forms and names."""

from __future__ import annotations

import time

import pytest
from made_pages import made

from cadenza.llm import html_extract, queries
from cadenza.llm.html_extract import WEIGHTS, attributes_of, blocks, fit_weights, main_text, score

LONG = "A sentence of the main text that is long enough to count as prose, and goes on for a while. " * 3
TEXT = "\n\n".join([LONG.strip()] * 3)
PARAGRAPHS = f"<p>{LONG}</p>" * 3


@pytest.mark.parametrize(
    ("inside", "found"),
    [
        (' class="a b" id=c', {"class": "a b", "id": "c"}),
        (" data-hidden=\"x\" title='a hidden gem'", {"data-hidden": "x", "title": "a hidden gem"}),
        (' data-x="class=nav sidebar" CLASS = main', {"data-x": "class=nav sidebar", "class": "main"}),
        (" hidden data-n=don't role=main/", {"hidden": "", "data-n": "don't", "role": "main/"}),
        (' a="1" a="2" b=', {"a": "1", "b": ""}),
        (' x=a"b y', {"x": 'a"b', "y": ""}),
    ],
)
def test_attributes(inside, found):
    assert attributes_of(inside) == found


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # a form around the page, as server-side page frameworks write it
        (f'<form method="post" action="./p.aspx"><input type="hidden" name="s" value="x>y"><article>{PARAGRAPHS}</article><input name=q></form>', TEXT),
        (f'<form id="aspnetForm"><input type=hidden name=s><nav><a href=a>Home</a></nav><div>{PARAGRAPHS}</div><input name=q><button>Go</button></form>', TEXT),
        (f"<article>{PARAGRAPHS}<form><p>Our letter, each week.</p><label>Your e-mail</label><input name=e><button>Ok</button></form></article>", TEXT),
        # attributes whose values or longer names look like others
        *((f"<article><div {x}>{PARAGRAPHS}</div></article>", TEXT) for x in ('data-hidden="x"', 'data-style="display:none"', 'data-role="navigation"', 'title="a hidden gem"', 'data-x="class=nav sidebar"')),
        # an apostrophe in a bare value, and quotes that aren't values
        (f"<article><p data-n=don't>{LONG}</p><p>{LONG}</p><p class=it's>{LONG}</p></article>", TEXT),
        (f'<article><p ">{LONG}</p><p \'>{LONG}</p><p>{LONG}</p></article>', TEXT),
        # linked items of an article's list, in it and in a plain container
        (f"<article>{PARAGRAPHS}<ul><li><a href=a>First source of all</a></li><li><a href=b>Second source</a></li></ul></article>", f"{TEXT}\n\nFirst source of all\n\nSecond source"),
        (f"<div>{PARAGRAPHS}<ul><li><a href=a>First source of all we read</a></li></ul>{PARAGRAPHS}</div>", f"{TEXT}\n\nFirst source of all we read\n\n{TEXT}"),
        # names of furniture around the whole text
        (f'<nav><a href=a>Home</a></nav><div class="disclaimer">{PARAGRAPHS}</div><footer>Us</footer>', TEXT),
        (f'<div id="search-widget-page"><h1>Head of it</h1>{PARAGRAPHS}</div>', f"Head of it\n\n{TEXT}"),
        ('<div class="cookie-notice"><p>We use cookies to make this site better, and ask you to accept them.</p></div>', ""),
        (f'<div class="sidebar">{PARAGRAPHS}</div><article><p>Short.</p></article>', "Short."),
        # drawings
        (f"<article><svg><text>Label</text><p>{LONG}</p></article>", LONG.strip()),
        (f"<article><svg><title>T</title><text>Label</text></svg><p>{LONG}</p></article>", LONG.strip()),
        ("<article><p>Some words here.</p><svg><text>Label", "Some words here."),
    ],
)
def test_hard_pages(page, text):
    assert main_text(page) == text


def _judged(seeds):
    """Of all blocks: content, kept, and what the score alone would say; and how many pages come out exactly."""
    rows, exact = [], 0
    for seed in seeds:
        page, content = made(seed)
        text, known = main_text(page), set(content)
        kept = set(text.split("\n\n"))
        exact += text == "\n\n".join(content)
        rows += [(b.text in known, b.text in kept, score(b) > 0) for b in blocks(page)]
    return rows, exact


def test_weights_are_those_of_made_pages():
    fitted = fit_weights([(page, set(content)) for page, content in map(made, range(400))])
    assert fitted.keys() == WEIGHTS.keys() and all(WEIGHTS[k] == pytest.approx(v, abs=0.01) for k, v in fitted.items())


def test_main_text_of_made_pages():
    """Layouts that nothing was fitted to: nearly all come out exactly."""
    rows, exact = _judged(range(50_000, 50_300))
    assert sum(a == b for a, b, _ in rows) / len(rows) > 0.997 and exact > 285


def test_the_cut_decides_and_is_right():
    """Where labels with the cut differ from the signs of the scores, the cut is nearly always right, and errors
    are fewer than without it."""
    rows, _ = _judged(range(60_000, 60_400))
    changed = [content == kept for content, kept, alone in rows if kept != alone]
    assert len(changed) >= 20 and sum(changed) >= 0.9 * len(changed)
    assert sum(a != b for a, b, _ in rows) < 0.7 * sum(a != c for a, _, c in rows)


def test_many_quotes_take_linear_time():
    begun = time.thread_time()
    main_text("<article>" + "<p a=\"x' b='y>z" * 20_000)
    main_text("<form>" * 2000 + "<input><p>words" * 2000)
    assert time.thread_time() - begun < 10


def test_query_equals_the_articles_of_the_given_pages(spark):
    """The given pages: all blocks of the article element, and nothing else."""
    import html
    import re

    d = "/root/testdata/sf0.01"
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op8_html_extract(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    for r in pages:
        inside = re.search(r"<article[^>]*>(.*)</article>", re.sub(r"<!--.*?-->|<script.*?</script>", "", r.html or "", flags=re.S), re.S)
        parts = re.split(r"</?(?:p|h\d|div|ul|ol|li|table|tr|td|th|blockquote|section|figure|figcaption|pre)\b[^>]*>", inside[1] if inside else "")
        words = [" ".join(html.unescape(re.sub(r"<br[^>]*>", " ", x)).split()) for x in (re.sub(r"<(?!br)[^>]*>", "", p) for p in parts)]
        text = "\n\n".join(x for x in words if x)
        assert got[r.page_id] == (text, len(text))
    assert len(got) == len(pages)
