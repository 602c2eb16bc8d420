import math
import random
import time

import pytest

from fieldlab.llm import op4_html as op

from .common_cases import saved

LONG = "A sentence of some length that tells what happened on that day in the town by the river. " * 3


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_article_without_the_rest():
    html = page(
        f"<nav><ul><li><a href=x>Home</a></li></ul></nav><div class='ad'>Buy\nnow</div><article><h1>Title &amp; more</h1><p>{LONG}<br>end<p>Ok.</p><aside>side</aside>"
        f"<form><input>name</form><script>var t='</p>';</script><section class='comments'><p>{LONG}</p></section><p>x &lt; y&nbsp;z</p></article><div id=cookie-notice>We use cookies</div><footer>&copy; me</footer>"
    )
    one = " ".join(LONG.split())
    assert op.main_text(html) == f"Title & more\n{one} end\nOk.\nx < y z"


def test_pages_without_article():
    one = " ".join(LONG.split())
    html = page(f"<div class=menu><a>a</a><a>b</a></div><div id=content><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=sidebar><p>{LONG}</p></div>")
    assert op.main_text(html) == f"{one}\nShort.\n{one}"
    assert op.main_text(page(f"<main><p>{LONG}</p></main><div><p>off</p></div>")) == one


ONE = " ".join(LONG.split())


@pytest.mark.parametrize(
    "body, expected",
    [
        (f"<article><div class='article-header'><h1>Title</h1></div><p>{LONG}</p></article>", f"Title\n{ONE}"),
        (f"<article><h1 class='header banner'>Title</h1><p>{LONG}</p></article>", f"Title\n{ONE}"),
        (f"<article><p>{LONG}</p><p class='notice'>{LONG}</p></article>", f"{ONE}\n{ONE}"),
        (f"<article><p>{LONG}</p><div class='notice'>Read <a>this</a></div></article>", ONE),
        (f"<article><p>{LONG}</p><div id='share-price'>12 euro</div><div class='social-policy'>Of old.</div></article>", f"{ONE}\n12 euro\nOf old."),
        (f"<article><p>{LONG}</p><div class='share'><a>A</a> <a>B</a></div><div class='relatedLinks'><a>C</a></div></article>", ONE),
        (f"<article><p>{LONG}</p></article><article><p>{LONG[:200]}</p></article>", f"{ONE}\n{LONG[:200].strip()}"),
        (f"<article><p>{LONG}</p><div class='comment-list'><p>{LONG}</p></div><section id=userComments><p>{LONG}</p></section></article>", ONE),
        (f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><div class='adventure ads-weekly'>Kept.</div></article>", f"{ONE}\nKept."),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>{LONG}</p></article>", ONE),
        (f"<div id=page><div class=menu>m</div><h1>Title</h1><div id=text><p>{LONG}</p><p>{LONG}</p></div></div>", f"Title\n{ONE}\n{ONE}"),
        (f"<header><h1>Site</h1></header><div id=text><p>{LONG}</p><p>{LONG}</p></div><div><h1>Other</h1><a>x</a></div>", f"{ONE}\n{ONE}"),
        (f"<form id=aspnetForm><div id=menu><a>m</a></div><div id=text><p>{LONG}</p><p>{LONG}</p></div><input><button>Go</button></form>", f"{ONE}\n{ONE}"),
        (f"<form id=aspnetForm><article><p>{LONG}</p></article><p>{LONG}</p></form><p>{LONG}</p>", ONE),
        (f"<article><p>{LONG}</p><form><p>Your name</p></form></article>", ONE),
        (f"<div class='comments'><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div></div>", f"Title\n{ONE}\n{ONE}"),
        (f"<article><h1>T</h1><p>{LONG}</p><ol class='commentlist'><li>{LONG}</li></ol><div class='advert-300x250'>Buy</div><div class='wp-block-ad'>Buy</div><ins class='adsbygoogle'>Buy</ins></article>", f"T\n{ONE}"),
        (f"<div id=text><p>{LONG}</p><p>{LONG}</p><div class='post-comments'><p>{LONG}</p></div><div class='related-posts'><a>A</a> <a>B</a> <a>C</a></div></div>", f"{ONE}\n{ONE}"),
    ],
)
def test_rules(body, expected):
    assert op.main_text(page(body)) == expected


def test_ratios_and_clusters_equal_a_plain_version():
    rng = random.Random(5)
    for _ in range(50):
        lines = [op.Line("x" * rng.choice([2, 5, 30, 200, 900]), rng.randint(0, 9), 0, 0, False, False) for _ in range(rng.randint(1, 60))]
        ratios = [len(x.text) / max(1, x.tags) for x in lines]
        kernel = [math.exp(-0.5 * (d / op.SIGMA) ** 2) for d in range(-4, 5)]
        smooth = [sum(k * ratios[min(max(i + d, 0), len(ratios) - 1)] for k, d in zip(kernel, range(-4, 5), strict=True)) / sum(kernel) for i in range(len(ratios))]
        mean = sum(smooth) / len(smooth)
        threshold = min((sum((x - mean) ** 2 for x in smooth) / len(smooth)) ** 0.5, max(smooth))
        got = op.content(lines)
        sure = [i for i in range(len(lines)) if abs(smooth[i] - threshold) > 1e-9]
        assert [got[0][i] for i in sure] == [smooth[i] >= threshold for i in sure] and got[1].tolist() == [x >= threshold for x in ratios]


def test_cut_and_broken_pages():
    one = " ".join(LONG.split())
    whole = page(f"<article><p>{LONG}</p><p>tail</p></article>")
    assert op.main_text(whole[: whole.index("tail") + 4]) == f"{one}\ntail"
    for rest in ("<p", "</p", "<a href='x", "<!-- no end"):
        assert op.main_text(f"<article><p>{LONG}</p>{rest}") == one
    assert op.main_text(f"<article><p>{LONG}</p><p>a <") == f"{one}\na <"
    assert op.main_text("<article>1 < 2 and a & b</article>") == "1 < 2 and a & b"
    assert op.main_text("") == op.main_text("<p></p>") == op.main_text("<script>x</script>") == ""


def test_chunks_do_not_matter(monkeypatch):
    html = page(f"<article><p>{LONG}&amp;&eacute;</p><p>{LONG}</p></article>")
    whole = op.main_text(html)
    monkeypatch.setattr(op, "CHUNK", 7)
    assert op.main_text(html) == whole


def test_rows(spark, tmp_path):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<article>hi</article>"), (3, "u", "<article>hi</article>"), (4, "u", "<article>" + "<p>é</p>" * 20000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.n_chars) for r in op.query(spark, saved(df, tmp_path, "pages")).collect())
    assert got == [(1, 0), (2, 0), (3, 2), (3, 2), (4, 39999)]
    assert op.extract_text(df.limit(0)).count() == 0
    assert op.extract_text(df.withColumnRenamed("url", "text")).columns == ["page_id", "html", "text"]


def plain_regions(lines, is_content, tree):
    """The choice of regions by the whole path of each line."""
    def path(n):
        return path(tree[n][1]) + [n] if n else []
    total = sum(len(x.text) for x, yes in zip(lines, is_content, strict=True) if yes)
    held = lambda n, only: sum(len(x.text) for x, yes in zip(lines, is_content, strict=True) if n in path(x.region) and (yes or not only))
    for kind in ("article", "main"):
        own = [n for n in range(1, len(tree)) if tree[n][0] == kind]
        if any(held(n, True) for n in own):
            return {n for n in own if held(n, True)}
        if any(held(n, False) for n in own):
            return {max(own, key=lambda n: held(n, False))}
    holding = [n for n in range(1, len(tree)) if held(n, True) and held(n, True) >= op.HOLDS * total]
    return {max(holding, key=lambda n: len(path(n)))} if holding else set()


def test_regions_equal_a_plain_version():
    rng = random.Random(3)
    for kinds in ("div section", "div article", "div main section", "div article main"):
        for _ in range(60):
            tree = [("", 0)] + [(rng.choice(kinds.split()), rng.randrange(n)) for n in range(1, rng.randint(2, 12))]
            lines = [op.Line("x" * rng.choice([1, 7, 40]), 1, rng.randrange(len(tree)), 0, False, False) for _ in range(rng.randint(1, 15))]
            marks = [rng.random() < 0.6 for _ in lines]
            assert op.regions(lines, marks, tree) == plain_regions(lines, marks, tree)


@pytest.mark.parametrize("html", ["<div>word " * 20_000, "<span>" * 20_000 + "<p>a</i>" * 20_000, "<b><p>" * 20_000, "<article>" + "<header>x " * 20_000, "<div>" * 20_000 + "</span>" * 20_000 + "end", "<form><p>w " * 20_000])
def test_deep_pages_take_linear_time(html):
    began = time.process_time()
    op.main_text(html)
    assert time.process_time() - began < 4
