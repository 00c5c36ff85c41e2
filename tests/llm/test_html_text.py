"""Main text of pages: labelled pages, awkward markup, time."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glyphlake.llm import html_text
from glyphlake.llm.html_text import main_text

from .conftest import WORDS

LINKS = ["Home", "About us", "Contact", "World news", "Log in", "Terms of use", "Privacy"]


def sentence(rng, least, most):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randint(least, most))).capitalize() + rng.choice(".....!?")


def labelled_page(seed):
    """A page in one of several layouts, the blocks of its article, and all other visible blocks."""
    rng = random.Random(seed)
    good, bad = [], []

    def text(to, least=6, most=40):
        to.append(sentence(rng, least, most))
        return to[-1]

    def menu():
        items = rng.sample(LINKS, rng.randint(2, 6))
        bad.extend(items)
        return "<ul>" + "".join(f"<li><a href='/{k}'>{x}</a>" + rng.choice(["</li>", ""]) for k, x in enumerate(items)) + "</ul>"

    def body():
        out = []
        for _ in range(rng.randint(2, 9)):
            kind = rng.random()
            if kind < 0.65:
                inner = text(good)
                if rng.random() < 0.3:
                    first, _, rest = inner.partition(" ")
                    inner = f"{first} <a href='/x'>{rest.split(' ')[0]}</a> {' '.join(rest.split(' ')[1:])}" if " " in rest else inner
                out.append(f"<p>{inner}" + rng.choice(["</p>", ""]))
            elif kind < 0.75:
                out.append(f"<h2>{text(good, 2, 6)}</h2>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{text(good, 8, 20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote><p>{text(good)}</p></blockquote>")
            else:
                out.append(f"<div class='{rng.choice(['ad', 'promo-box', 'newsletter'])}'><p>{text(bad)}</p></div>")
        return "".join(out)

    title = f"<h1>{text(good, 3, 9)}</h1>"
    article = rng.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div class='post-content'>{}</div>", "<div id=story><section>{}</section></div>"]).format(title + body())
    parts = ["<html><head><title>" + sentence(rng, 2, 5) + "</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body>"]
    parts.append(f"<div class='{rng.choice(['navbar', 'site-header', 'menu'])}'>{menu()}</div>" if rng.random() < 0.5 else f"<header><nav>{menu()}</nav></header>")
    if rng.random() < 0.5:
        parts.append(f"<div id='cookie-notice' role=alert><p>{text(bad)}</p></div>")
    side = f"<aside><h3>{text(bad, 2, 4)}</h3><p>{text(bad)}</p></aside>" if rng.random() < 0.5 else f"<div class='sidebar widget'><p>{text(bad)}</p></div>"
    comments = f"<section class='comments'><div class=comment><p>{text(bad)}</p><p>{text(bad)}</p></div></section>"
    parts += [article, side, comments] if rng.random() < 0.7 else [side, article, comments]
    parts.append(f"<div hidden><p>{text(bad)}</p></div><form><label>{text(bad, 2, 3)}</label><textarea>{text(bad)}</textarea></form>")
    parts.append(f"<footer><p>{text(bad, 3, 12)}</p></footer></body></html>" if rng.random() < 0.5 else f"<div class='footer'>© {text(bad, 3, 12)}</div>")
    return "".join(parts), good, bad


def test_labelled_pages():
    right = found = wanted = 0
    for seed in range(400):
        page, good, _ = labelled_page(seed)
        got, want = Counter(main_text(page).split("\n")), Counter(good)
        shared = sum((got & want).values())
        right, found, wanted = right + shared, found + sum(got.values()), wanted + sum(want.values())
    assert right / found >= 0.97 and right / wanted >= 0.97, (right / found, right / wanted)


ARTICLE = "<p>A whole sentence of the article, as long as it need be.</p>"
TEXT = "A whole sentence of the article, as long as it need be."


@pytest.mark.parametrize(
    "page, text",
    [
        (f'<div class="overflow-hidden">{ARTICLE}</div>', TEXT),
        (f'<div title="hidden valley"><a href="/hidden/x"></a>{ARTICLE}</div>', TEXT),
        (f'<div data-style="display:none">{ARTICLE}</div>', TEXT),
        (f"<div hidden>{ARTICLE}</div>", ""),
        (f"<div id=a hidden=''>{ARTICLE}</div>", ""),
        (f"<div aria-hidden='true'>{ARTICLE}</div>", ""),
        (f"<div aria-hidden=false>{ARTICLE}</div>", TEXT),
        (f'<div style="color:red; display : none">{ARTICLE}</div>', ""),
        (f"<head><title>t</title><body>{ARTICLE}", TEXT),
        (f"<head><meta charset=utf-8><title>t</title>{ARTICLE}", TEXT),
        (f"<html><head><title>t</title><style>p{{}}</style>{TEXT}", TEXT),
        (f"<table><tr><td>{TEXT}<tr><td>{TEXT}</table>", f"{TEXT}\n{TEXT}"),
    ],
)
def test_hidden_elements_and_open_heads(page, text):
    assert main_text(page) == text


@pytest.mark.parametrize(
    "block",
    ["<div><p>{a}</p></div>", "<div class='{c}'><p>{a}.</p></div>", "<li>{a} <a href=x>{a}</a><p>{a}</p>", "<tr><td>{a}<td>{a}.<td>x", "<div><b><font>{a}", "<font><p>{a}</b></i>"],
)
def test_time_is_linear(block):
    rng = random.Random(5)
    page = "".join(block.format(a="word " * rng.randint(1, 20), c=rng.choice(["ad", "x"])) for _ in range(8000))
    began = time.process_time()
    blocks = html_text.blocks_of(page)
    parsed = time.process_time()
    main_text(page)
    assert len(blocks) >= 8000 and parsed - began < 4 and time.process_time() - parsed < 6


def test_long_chains_are_cut_in_time():
    rng, n = random.Random(6), 8000
    for gain in ([0.01] * (n // 2) + [-0.01] * (n // 2), [rng.uniform(-1, 1) for _ in range(n)]):
        began = time.process_time()
        html_text.min_cut(gain, {(i, i + 1): 1.0 for i in range(n - 1)})
        assert time.process_time() - began < 4


def test_rows_of_every_kind(spark):
    page = labelled_page(1)[0]
    long = "<body><article>" + ARTICLE * 20_000
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (3, "", ""), (None, "v", page), (4, "w", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({n: F.lit(0) for n in ("text", "n_chars", "blocks")})
    out = html_text.extract(df).collect()
    assert Counter((r.page_id, r.url) for r in out) == Counter((i, u) for i, u, _ in rows)
    for r in out:
        assert r.n_chars == len(r.text) and r.blocks == 0
    assert {r.page_id: r.text for r in out}[4] == "\n".join([TEXT] * 20_000)
    assert len({r.text for r in out if r.page_id in (1, None)}) == 1
