import html
import re
import time

import pytest

from witspark.llm import pages
from witspark.llm.queries import QUERIES

STORY = "Words of the story go on and on, with much to say. "


def gold(source):
    article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))
    return " ".join(html.unescape(plain).split())


def test_query_op4(spark, sf_dir):
    given = {r["page_id"]: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op4_html_extraction"](spark, sf_dir).collect()
    assert len(rows) == len(given)
    for row in rows:
        assert row["text"] == gold(given[row["page_id"]]["html"])
        assert row["n_chars"] == len(row["text"]) and row["url"] == given[row["page_id"]]["url"]


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return pages.fit(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@pytest.mark.parametrize(
    "source, expected",
    [
        ("", ""),
        (
            f"<body><header><p>Head</p></header><div id='sidebar'><p>{STORY}</p></div>"
            f"<div class='cookie-notice'>Cookies. {STORY}</div><div class='content'><h1>Title</h1>"
            f"<p>A &amp; <b>B</b>c {STORY}<script>x('</p>')</script></p><form><label>Mail</label></form>"
            f"<p>End.</p></div><section class='comments'><p>Nice! {STORY}</p><p>{STORY}</p></section>"
            f"<footer>{STORY}</footer></body>",
            f"Title A & Bc {STORY}End.",
        ),
        (
            f"<main><h1>T</h1><p>One. {STORY}<p>Two&nbsp;\n three.<ul><li>x<li>y</ul><aside>{STORY}</aside></main>",
            f"T One. {STORY}Two three. x y",
        ),
        (f"<article><p>unclosed <b>bold {STORY}", f"unclosed bold {STORY}".strip()),
    ],
)
def test_templates_not_in_the_sample(model, source, expected):
    assert model.main_text(source) == expected


def brute_marginals(model, tree):
    """Marginals by summing over all assignments."""

    from itertools import product
    from math import exp

    n = len(tree.tag)
    features = tree.features()
    mass = [0.0] * n
    total = 0.0
    for states in product(range(3), repeat=n):
        value = 1.0
        for i, s in enumerate(states):
            value *= exp(sum(model.unary.get(f, [0.0] * 3)[s] for f in features[i]))
            if i:
                kind = "text" if tree.tag[i] is None else "element"
                value *= model.pair[kind][states[tree.parent[i]]][s]
        total += value
        for i, s in enumerate(states):
            if s == pages.CONTENT:
                mass[i] += value
    return [m / total for m in mass]


@pytest.mark.parametrize("source", ["<p>a</p>", "<div><p>Some text.</p><a>x</a></div>", "<nav><li>a</nav><p>b b b."])
def test_sum_product_by_brute_force(model, source):
    tree = pages.Tree(source)
    assert model.marginals(tree)[1:] == pytest.approx(brute_marginals(model, tree)[1:], abs=1e-9)


def test_odd_rows(spark):
    rows = [(None, None, None, "x"), (1, "u", "", "x"), (2, "u", "<p>" + STORY * 3000, "x"), (2, "u", "<p>" + STORY * 3000, "x"), (3, "u", "<div>" * 2000 + STORY, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    out = pages.extract(df, pages.fit(df)).collect()
    assert len(out) == 5 and sorted((r["id"] or 0, len(r["text"])) for r in out)[:2] == [(0, 0), (1, 0)]
    none = df.limit(0)
    assert pages.extract(none, pages.fit(none)).collect() == []


def test_parsing_is_linear_in_depth():
    tree = pages.Tree("<div>" * 5000 + "x" + "</div>" * 5000)
    assert len(tree.tag) == 5002


@pytest.mark.parametrize(
    "source",
    [
        "<div>" * 200_000,
        "<a " * 350_000,
        "<a " * 350_000 + ">",
        "<div>" * 100_000 + "</b>" * 100_000,
        "<b>" * 150_000 + "<h1></h1>" * 50_000,
    ],
    ids=["nested", "unclosed", "closed late", "unmatched ends", "no paragraph"],
)
def test_a_megabyte_of_odd_tags_parses_in_seconds(source):
    begin = time.process_time()
    pages.Tree(source)
    assert time.process_time() - begin < 5
