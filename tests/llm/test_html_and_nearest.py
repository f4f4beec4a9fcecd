import numpy as np
import pytest
from pyspark.sql import functions as F

from casemetrics.llm.common import table
from casemetrics.llm.html_text import main_text, page_blocks
from casemetrics.llm.nearest import nearest

PAGES = "page_id long, url string, html string, host string, text string"


def text(html):
    return "\n".join(page_blocks(html)[1])


def test_blocks_of_an_article():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <header>No</header><nav><ul><li><a>No</a></ul></nav><!-- No <p> --><div class="cookie-notice">No</div>
    <article><header><h1>Title &amp; more&hellip;</h1></header><p><b>One\n two&nbsp; <i>th</i>ree.<br><p>Four</p>
    <div class="ad"><p>No</div><form><p>No</form><ul><li>Five<li>Six</ul><aside>No</aside><div hidden>No</div>
    <section id="comments"><p>No</section><p>Seven &am &#233; &lt;p&gt;</article><footer>&copy; No</footer></body>"""
    assert text(page) == "Title & more…\nOne two three.\nFour\nFive\nSix\nSeven &am é <p>"


@pytest.mark.parametrize(
    "html,want",
    [
        ('<div class="page has-sidebar"><div>beside</div><article><p>One</article></div>', "One"),
        ('<div class="layout sidebar-left"><div>beside</div><article><p>One</article></div>', "One"),
        ('<article><div class="body no-comments"><p>One</div><div class="comments"><p>No</div></article>', "One"),
        ('<div class="related"><article>No</article></div><article>One</article>', "One"),
        ('<aside class="x"><article>No</article></aside><article>One</article>', "One"),
        ('<main><div class="comments"><article>No</article></div><p>One</main>', "One"),
        ('<div class="ad">No</div><p>One</p><div class="cookie-notice">No</div>', "One"),
        ('<div class="nav">No<p>No<article>One</div>after', "One"),
    ],
)
def test_class_names_around_and_in_an_article(html, want):
    assert text(html) == want


def plain_runs(pages, size=8):
    """Brute force: every run of words of every page against every other page of different html."""
    runs = [{tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for _, w in pages]
    out = []
    for i, (html, words) in enumerate(pages):
        others = set().union(*(r for j, r in enumerate(runs) if pages[j][0] != html))
        gone = {k + d for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in others for d in range(size)}
        out.append(" ".join(w for k, w in enumerate(words) if k not in gone))
    return out


def test_repeated_runs_equal_brute_force_and_copies_stay(spark):
    source = np.random.default_rng(4)
    passages = [[f"p{k}w{i}" for i in range(source.integers(6, 14))] for k in range(5)]
    pages = []
    for i in range(40):
        words = [f"own{i}x{j}" for j in range(source.integers(0, 9))]
        for k in source.integers(0, 5, source.integers(0, 3)):
            words += passages[k] + [f"own{i}y{k}"]
        pages.append((f"<div>{' '.join(words)}</div>", words))
    pages += [pages[3], pages[7], pages[7], ("<p>a b c d e f g h i j</p>", list("abcdefghij"))]
    pages.append(pages[-1])
    rows = [(i, "http://one.org/", html, "h", "t") for i, (html, _) in enumerate(pages)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert [got[i] for i in range(len(pages))] == plain_runs(pages)
    assert got[len(pages) - 1] == got[len(pages) - 2] == "a b c d e f g h i j"


@pytest.mark.parametrize("html,want", [(None, ""), ("", ""), ("<p>a<p>b", "a\nb"), ("<article></article>", ""), ("a < b", "a < b")])
def test_odd_pages(html, want):
    assert text(html) == want


def test_what_a_host_repeats_is_removed_without_markup(spark):
    menu = "start here then go on to the shop or leave now"
    rows = [(i, f"http://Host.org/{i}", f"<div>{menu}</div><p>a{i} b{i} c{i}</p>") for i in range(4)]
    rows += [(9, "http://other.org/", f"<div>{menu}</div>"), (10, None, None), (None, "x", "<p>y"), (None, "x", "<p>y")]
    rows += [(20 + i, "http://host.org/", f"<article>{menu}</article>") for i in range(2)]
    got = main_text(spark.createDataFrame([(*r, "h", "t") for r in rows], PAGES)).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert by[2] == "a2 b2 c2" and by[9] == menu and by[20] == menu and by[10] == "" and by[None] == "y"
    assert main_text(spark.createDataFrame([], PAGES)).collect() == []


def article(i, *layout, words=30):
    prose = " ".join(f"own{i}x{j}" for j in range(words))
    return f"<main><h1>Title {i}</h1>{''.join(layout)}<p>{prose}</p></main>", f"Title {i}", prose


def test_what_a_host_repeats_in_the_layout_of_articles_is_removed(spark):
    menu = "".join(f"<li>Go to {k}</li>" for k in "abcde")
    shared = "one passage of ten words that two articles both quote"
    rows, want = [], []

    def add(url, html, *blocks):
        rows.append((len(rows), url, html))
        want.append("\n".join(blocks))

    for i in range(5):
        only = f"Only {i} has this block of more than eight words"
        html, title, prose = article(i, f"<ul>{menu}</ul>", f"<div>{only}</div>", f"<p>{shared}</p>")
        add(f"http://One.org/{i}", html, title, only, shared, prose)
    add("http://one.org/0", rows[0][2], want[0])
    html, title, prose = article(6, f"<ul>{menu}<li>More</li></ul>")
    add("http://one.org/6", html, title, "More", prose)
    listed = [f"Go to {k}" for k in "abcde"]
    html, title, prose = article(7, f"<ul>{menu}</ul>", words=8)
    add("http://one.org/short", html, title, *listed, prose)
    html, title, prose = article(8, f"<ul>{menu}</ul>")
    for url in ("http://two.org/", None):
        add(url, html, title, *listed, prose)
    add(None, html.replace("own8", "own9"), title, *listed, prose.replace("own8", "own9"))
    for i in range(2):
        html, title, prose = article(10, f"<section>{shared}</section>", words=40)
        add("http://copies.org/", html.replace("own10x39", f"end{i}"), title, shared, prose.replace("own10x39", f"end{i}"))
    got = main_text(spark.createDataFrame([(*r, "h", "t") for r in rows], PAGES)).collect()
    assert {r.page_id: r.text for r in got} == dict(enumerate(want))
    assert all(r.n_chars == len(r.text) for r in got)


def test_near_copies_of_one_article_among_unlike_ones(spark):
    note = "<div>the same notice of this host on all of its pages</div>"
    html, title, prose = article(0, note, words=40)
    rows = [(i, "http://one.org/", html.replace("own0x39", f"end{i}"), "h", "t") for i in range(6)]
    before = main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert all(r.text.startswith(f"{title}\nthe same notice") for r in before) and len(before) == 6
    rows.append((6, "http://one.org/", article(1, note)[0], "h", "t"))
    after = main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(after) == 7 and not any("notice" in r.text for r in after)


def test_unmarked_pages_are_told_by_what_stands_beside_articles_of_their_host(spark):
    menu = "start here then go on to the shop or leave now"
    lead = "an article that marks itself may be quoted by others whole"
    rows = [(i, f"http://{host}.org/a", f"<div>{menu}</div><p>text {lead}</p>") for i, host in enumerate(["one", "two"])]
    rows.append((2, "http://one.org/b", f"<div>{menu}</div><article><p>{lead}</p></article><div>after</div>"))
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame([(*r, "h", "t") for r in rows], PAGES)).collect()}
    assert got == {0: f"text {lead}", 1: f"{menu}\ntext {lead}", 2: lead}


def exact(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        score = np.array([sum(float(a) * float(b) for a, b in zip(x[i], y)) for y in x])
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def test_neighbours_of_given_vectors(spark):
    vectors = table(spark, "/root/testdata/sf0.1", "embeddings")
    got = nearest(vectors, F.col("vec_id") % 20 == 0).toPandas()
    rows = vectors.orderBy("vec_id").toPandas()
    want = exact(rows.vec_id.to_numpy(), np.stack(rows.embedding), 20)
    found = total = 0
    for q, own in got.groupby("query_id"):
        assert sorted(own["rank"]) == list(range(1, len(own) + 1)) and len(own) == 20
        known = dict(want[q])
        found += len(known.keys() & set(own.vec_id))
        total += len(known)
        ordered = own.sort_values("rank")
        assert list(zip(-ordered.score, ordered.vec_id)) == sorted(zip(-ordered.score, ordered.vec_id))
    assert set(got.query_id) == set(want) and found / total >= 0.9


def test_ties_copies_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(100 + i, [0.5, float(i)]) for i in range(3)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0]), (260, [nan, 1.0]), (280, [inf, 1.0]), (300, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(320, [1.0, 2.0, 3.0]), (340, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, "q", 0.0) for r in rows], "vec_id long, embedding array<float>, query_id string, score double")
    got = nearest(frame, F.col("vec_id") % 20 == 0, part_rows=7, probes=81).toPandas()
    first = got[got.query_id == 0].sort_values("rank")
    assert list(first.vec_id) == list(range(1, 21))
    assert list(got[got.query_id == 40].sort_values("rank").vec_id) == list(range(20))
    assert list(got[got.query_id == 320].vec_id) == [340]
    assert set(got.query_id) == {0, 20, 40, 100, 320, 340}
    assert nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_many_different_vectors_tied_to_rounding(spark):
    rows = [(0, [0.1, 0.0, 0.3])] + [(90 - i, [0.1, float(i % 30) / 64, 0.3 if i < 30 else 0.3 - i * 1e-9]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest(frame, F.col("vec_id") == 0, part_rows=7, probes=81, width=50.0).orderBy("rank").collect()
    ids, vectors = zip(*rows)
    want = exact(np.array(ids), np.array(vectors), 20)[0]
    assert [(r.vec_id, r.score) for r in got] == want
    assert [r.vec_id for r in got] == list(range(61, 81))
