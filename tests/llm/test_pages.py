"""Page reading by cases, the labeller's gradients, and its accuracy on pages it wasn't fitted to."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pages

WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt ut labore et dolore magna".split()


def said(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def page(r, n):
    """A page of the plain layout, and its main text."""
    title, paragraphs = said(r, 5), [said(r, r.choice([1, 8, 40])) for _ in range(n)]
    menu = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in r.sample(WORDS, 4))
    body = f'<nav><ul>{menu}</ul></nav><!-- {said(r, 3)} --><div class="ad">{said(r, 5)}</div>'
    body += f"<article><h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs) + f"</article><footer>&copy; {said(r, 4)}</footer>"
    return f"<html><head><title>x</title><script>var a='</p>';</script></head><body>{body}</body></html>", " ".join([title, *paragraphs])


def read(html):
    return [("/".join(".".join([tag, *names]) for tag, names in path), text) for path, text, _ in pages.blocks(html)]


@pytest.mark.parametrize(
    "html, want",
    [
        (None, []),
        ("", []),
        ("  \n ", []),
        ("plain &amp; bare < 3 text", [("", "plain & bare < 3 text")]),
        ("<p>a\n b\t&nbsp;c</p>", [("p", "a b c")]),
        ("<p><b>one.<br>two<p>three", [("p", "one. two"), ("p", "three")]),
        ("<p>in<b>si</b>de <a href='x>y'>li</a>nk</p>", [("p", "inside link")]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", [("ul/li", "a"), ("ul/li", "b"), ("ul/li/ul/li", "c"), ("ul/li", "d"), ("", "e")]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", [("table/tr/td", "a"), ("table/tr/td", "b"), ("table/tr/td", "c")]),
        ("<div class='site-Footer wideBox' id=mainAds>x</div>", [("div.site.footer.wide.box.main.ad", "x")]),
        ("<b><p>x</b>y</p>z", [("p", "xy"), ("", "z")]),
        ("a<script>if (a<b) '</p>'</SCRIPT >b<style>p{}</style>c<textarea><p>no</textarea>d", [("", "abc"), ("", "d")]),
        ("a<!-- <p>b</p> -->c<!doctype x><?php d ?>e", [("", "ace")]),
        ("a<!-- never closed <p>b", [("", "a")]),
        ("a<script>never closed <p>b", [("", "a")]),
        ('a<p class="never closed>b</p>', [("", "a")]),
        ("<head><title>t</title><meta x>hello", [("", "hello")]),
        ("<head><title>t</title><p>hello", [("p", "hello")]),
        ("</p></div></nothing>x</x>y", [("", "xy")]),
        ("<svg><text>no</text></svg>yes<select><option>no</select>", [("", "yes")]),
        ("&#72;&#x69; &am &amp &copy 5 &unknown; &#xD800;", [("", "Hi &am & © 5 &unknown; �")]),
    ],
)
def test_blocks(html, want):
    assert read(html) == want


def test_deep_and_broken_pages_take_time_in_proportion():
    """Unclosed elements, quotes and brackets by the hundred thousand; no text is lost."""
    assert len(pages.blocks("<div>x" * 100_000)) == 100_000
    assert len(pages.blocks("<b>x</i>" * 50_000)) == 1
    assert sum(t.count("y") for _, t, _ in pages.blocks("<p>y</p>" + '<a "' * 100_000 + "<p>y" * 5)) >= 1
    assert len(pages.blocks("< <" * 100_000)[0][1]) > 100_000


def test_hints_take_the_nearest_telling_element():
    hint = lambda html: [pages.hint(path) for path, *_ in pages.blocks(html)]
    assert hint("<article><p>a</p><div class=comments><p>b</p></div></article><p>c<nav>d") == [1, 0, None, 0]
    assert hint("<header>a</header><article><header>b</header></article><aside><article>c") == [0, None, 1]


def test_gradients_equal_differences():
    r = random.Random(2)
    read_ = [pages.blocks(page(r, n)[0]) for n in (1, 3)] + [[]]
    f, model = pages.Features(read_), pages.Labeller(seed=3)
    n = len(f.measures)
    labels, weight = np.arange(n) % 2.0, np.linspace(0.2, 1, n)
    heard = (np.arange(n) % 3 > 0).astype(float)
    _, grads = model.gradients(f, labels, weight, heard)
    for name, g in grads.items():
        spots = np.flatnonzero(g)[:: max(1, np.count_nonzero(g) // 6)]
        for at in spots:
            flat = model.weights[name].reshape(-1)
            was, losses = flat[at], []
            for step in (1e-5, -1e-5):
                flat[at] = was + step
                losses.append(model.gradients(f, labels, weight, heard)[0])
            flat[at] = was
            assert abs((losses[0] - losses[1]) / 2e-5 - g.reshape(-1)[at]) < 1e-6, name


def test_scores_do_not_depend_on_padding():
    r = random.Random(4)
    read_ = [pages.blocks(page(r, n)[0]) for n in (1, 30, 6)]
    model = pages.Labeller(seed=5)
    together = model.scores(pages.Features(read_))
    assert np.allclose(together, np.concatenate([model.scores(pages.Features([p])) for p in read_]), atol=1e-9)


@pytest.fixture(scope="module")
def model():
    r = random.Random(6)
    return pages.train([page(r, r.choice([1, 3, 10]))[0] for _ in range(60)], passes=12)


def test_main_text_of_unseen_pages(spark, model):
    r = random.Random(7)
    made = [page(r, r.choice([1, 4, 25])) for _ in range(40)]
    rows = [(i, f"u{i}", html, "other", i) for i, (html, _) in enumerate(made)]
    odd = [(None, None, made[0][0], "", 1), (1, "again", made[1][0], "", 1), (90, "u", None, "", 1), (91, "u", "", "", 1), (92, "u", "<nav>a</nav>", "", 1)]
    df = spark.createDataFrame(rows + odd, "page_id long, url string, html string, text string, n_chars int").repartition(3)
    got = pages.extract(df, model.packed()).collect()
    assert pages.extract(df, model.packed()).columns == ["page_id", "url", "text", "n_chars"] and len(got) == 45
    by = {(g.page_id, g.url): g.text for g in got}
    wrong = sum(by[i, f"u{i}"] != text for i, (_, text) in enumerate(made))
    assert wrong <= 1
    assert by[None, None] == by[0, "u0"] and by[1, "again"] == by[1, "u1"]
    assert by[90, "u"] == by[91, "u"] == by[92, "u"] == ""
    assert all(g.n_chars == len(g.text) for g in got)


def test_other_layouts(model):
    """Containers, side bars, notices, forms and comments as they are not in the fitted pages."""
    r = random.Random(8)
    words = [w for _ in range(300) for w in said(r, 8).split()]
    right = total = 0
    for _ in range(150):
        blocks, labels = pages.layout([("h1", said(r, 5))] + [("p", said(r, 30)) for _ in range(r.randint(2, 12))], words, r)
        right += int(((model.scores(pages.Features([blocks])) > 0) == np.array(labels)).sum())
        total += len(labels)
    assert right / total > 0.95


def test_fit_reads_a_bounded_sample_in_one_task(spark, monkeypatch):
    monkeypatch.setattr(pages, "SAMPLE", 10)
    seen = []
    r = random.Random(9)
    htmls = [page(r, 2)[0] for _ in range(6)]
    rows = [(i, "u", htmls[i % 6]) for i in range(60)] + [(7, "u", htmls[1])] * 40 + [(i, "long", "x" * (pages.LONGEST + 1)) for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    monkeypatch.setattr(pages, "train", lambda sample: seen.append(len(sample)) or pages.Labeller())
    assert pages.Labeller.unpacked(pages.fit(df)).weights.keys() == pages.Labeller().weights.keys()


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert pages.extract(none).collect() == []


def test_every_row_is_read_once(spark, model):
    df = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<article><p>"), "id", F.lit(" some words of it</p></article>")).alias("html"))
    got = {g.page_id: g.text for g in pages.extract(df, model.packed()).collect()}
    assert got == {i: f"{i} some words of it" for i in range(300)}
