"""Vector links and page texts against brute force."""

import time

import numpy as np
import pandas as pd
import pytest

from salesmerge.llm import embedding_dedup
from salesmerge.llm.embedding_dedup import near_duplicate_vectors
from salesmerge.llm.hnsw import Graph
from salesmerge.llm.html_text import main_text, read, shared_lines


@pytest.mark.parametrize("shard_rows", [100_000, 200])
def test_links_equal_brute_force(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(embedding_dedup, "MIN_SHARDS", 2)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 400)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(500, 16))
    near = base[:1] + rng.normal(size=(150, 16)) * 0.1
    chain = np.cumsum(np.vstack([base[1:2], rng.normal(size=(40, 16)) * 0.15]), 0)
    vectors = np.vstack([base, near, chain, np.repeat(base[5:6], 30, 0)]).astype(np.float32)
    rows = [(int(k), [float(v) for v in x], 0) for k, x in enumerate(vectors)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0]]
    rows += [(10_000 + k, x, 0) for k, x in enumerate(odd)] + [(None, rows[0][1], 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n_links int")
    got = {r.vec_id: r for r in near_duplicate_vectors(frame).collect()}
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    label = np.arange(len(unit))
    for _ in range(len(unit)):
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            break
        label = new
    assert [got[k].component_id for k in range(len(unit))] == label.tolist()
    assert [got[k].n_links for k in range(len(unit))] == (linked.sum(1) - 1).tolist()
    for k in range(len(odd)):
        assert (got[10_000 + k].n_links, got[10_000 + k].kept) == (0, True)
    assert got[None].kept and got[None].component_id is None
    assert near_duplicate_vectors(frame.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[1000:1400] = x[0] + rng.normal(size=(400, 24)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = Graph.build(x).search(x[:500], 128)
    truth = np.argsort(-(x[:500] @ x.T), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(truth.tolist(), ids.tolist(), strict=True)]) > 9


ARTICLE = (
    "<html><head><title>T</title><style>p{}</style></head><body class='has-sidebar'><nav><a>Home</a></nav>"
    "<header>Site</header><div class='ad-slot'>Buy</div><article><header><h1>Big &amp; bold</h1>by me</header>"
    "<p>One<br>two &nbsp; <b>three</b>\n four<p>Five<aside>Side</aside><script>x<y</script>"
    "<ul><li>a<li>b</ul><div id='comments'><p>Nice!</p></div></article><form>Mail <input></form>"
    "<footer>&copy;</footer></body>"
)
BARE = "<body><p>Site name</p><p>{}</p><p>Good</p><p>Imprint</p></body>"


def test_main_text(spark):
    url = "http://h.example/"
    pages = [
        (1, f"{url}a", ARTICLE), (2, f"{url}b/1", BARE.format("First")), (3, f"{url}b/2", BARE.format("Second")),
        (4, f"{url}b/2?x=1", BARE.format("Second")), (5, "http://alone.example/", "<p>Only <i>line</i></p> tail"),
        (6, None, None), (7, f"{url}c", ""), (8, "http://two.example/x", "<p>A</p>"),
        (9, "http://two.example/y", "<p>A</p>"), (1, f"{url}a", ARTICLE), (None, f"{url}z", "<main>Here</main> there"),
        (10, f"{url}deep", "<tr><td>x" * 5000),
        (11, "http://odd.example/", "<p>a<![foo[ x ]]><p>b<![\0[<!DOCTYPE [ <!X"),
    ]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rows = main_text(frame).collect()
    assert len(rows) == len(pages)
    got = {r.page_id: r for r in rows}
    assert got[1].text == "Big & bold\n\nOne two three four\n\nFive\n\na\n\nb"
    assert (got[2].text, got[3].text, got[4].text) == ("First", "Second", "Second")
    assert got[5].text == "Only line\n\ntail"
    assert (got[6].text, got[6].n_chars, got[7].text) == ("", 0, "")
    assert got[8].text == got[9].text == "A"  # a copy isn't boilerplate
    assert got[None].text == "Here"
    assert got[11].text.startswith("a\n\nb")
    assert got[10].text.count("x") == 5000
    assert all(r.n_chars == len(r.text) for r in rows)
    assert main_text(frame.limit(0)).count() == 0


def test_articles_are_compared_too(spark):
    page = (
        "<article><h1>{0}</h1><div class='ad-slot'>Buy now</div><p>Text of {0}</p><p>As always.</p>"
        "<div class='related-posts'>Own to {0}</div></article>"
    )
    pages = [(k, f"http://h.example/s/{k}", page.format(f"story {k}")) for k in range(3)]
    pages.append((9, "http://alone.example/", page.format("one")))
    rows = {r.page_id: r for r in main_text(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for k in range(3):  # a part that only hints at an advert goes if the neighbour has it; plain text stays
        assert rows[k].text == f"story {k}\n\nText of story {k}\n\nAs always.\n\nOwn to story {k}"
        assert (rows[k].n_chars, rows[k].n_shared) == (len(rows[k].text), 2)
    assert (rows[9].text.split("\n\n")[1], rows[9].n_shared) == ("Buy now", 0)


def test_alignment_of_repeated_lines_is_quick():
    begin = time.perf_counter()
    assert len(shared_lines(["a", "b"] * 2000, ["b", "a"] * 2000)) == 3999
    assert time.perf_counter() - begin < 2


def test_longest_common_subsequence():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = ([str(x) for x in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
        shared = shared_lines(a, b)
        rest = iter(b)
        assert len(shared) == size[-1][-1] and all(a[k] in rest for k in sorted(shared))


def test_names_never_exclude_the_text():
    article = "<article><h1>Head</h1><p>First line of it</p><div class=share>Tell</div></article>"
    for start in (
        '<div class="layout has-sidebar">', '<div id="page" class="no-comments">', '<div class="share-enabled">',
        '<div class="search-result">', '<div class="search">', '<section id="widget"><div class="legal">', "<form>",
    ):
        text, _ = read(f"{start}{article}<div class=comments><article>Mine too</article></div>")
        assert text == ["Head", "First line of it"], start
    text, _ = read(f"{article}<div class=comments><article>{'Mine too ' * 50}</article></div>")
    assert text == ["Head", "First line of it"]
    plain = "<div class=legal><p>Terms of this long page</p><p>and their end</p></div><div class=ad>Buy</div>"
    assert read(plain) == (None, ["Terms of this long page", "and their end"])


def test_a_teaser_is_not_the_text():
    long = "<div><p>The whole text stands in plain containers</p><p>and goes on here</p></div>"
    lines = ["The whole text stands in plain containers", "and goes on here", "See also"]
    teaser = "<article>See also</article>"
    assert read(long + teaser) == (None, lines)
    assert read(f"<main>{long}{teaser}</main><p>loose") == (lines, ["loose"])


def _groups(rng, n, size):
    """Unit vectors: one group of `size` near copies, pairs of near copies, the rest apart."""
    x = rng.normal(size=(n, 32))
    x[:size] = x[0] + 0.01 * rng.normal(size=(size, 32))
    x[size + 1 : size + 200 : 2] = x[size : size + 200 : 2] + 0.01 * rng.normal(size=(100, 32))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_audit_weighs_every_query_the_same():
    x = _groups(np.random.default_rng(3), 2400, 1500)
    graph = Graph(x.astype(np.float32), [np.arange(2400)], [])
    row, node = np.nonzero(x @ x.T >= 0.95)
    assert embedding_dedup._audit(graph, x, row, node, 0.95, np.arange(2400)) == 1
    lost = (row >= 1500) & (row != node)  # each pair loses its only link
    assert embedding_dedup._audit(graph, x, row[~lost], node[~lost], 0.95) < embedding_dedup._RECALL


def test_unreachable_nodes_are_found():
    x = _groups(np.random.default_rng(4), 2400, 300)
    nodes = pd.DataFrame({"id": np.arange(2400), "place": np.arange(2400), "n": 1, "height": 0, "island": False})
    nodes["vector"], nodes["links"] = list(x), [np.full(32, -1)] * 2400
    got = embedding_dedup._query(0.95)(nodes[["id", "vector"]], nodes)
    linked = got[got.x == got.y].set_index("x").n
    true = (x @ x.T >= 0.95).sum(1) - 1
    assert linked.to_dict() == {k: v for k, v in enumerate(true) if v}


def test_small_shards_are_walked_as_large_ones(monkeypatch):
    # Input of any size takes the same way: the first, narrow beam reads less than a shard of 1,000.
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(1000, 64)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    walked = []
    search = Graph.search
    graph = Graph.build(vectors)
    monkeypatch.setattr(Graph, "search", lambda *a, **k: walked.append(len(a[1])) or search(*a, **k))
    row, node = embedding_dedup._hits(graph, vectors.astype(float), 0.95, embedding_dedup.FIRST_BEAM)
    assert walked and sorted(zip(row.tolist(), node.tolist())) == [(k, k) for k in range(1000)]


def test_two_shards_meet_once_and_count_links_on_both_sides(spark):
    # About 700 vectors a shard, groups of 1 to 60 near copies spread over all shards.
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(1200, 32))
    sizes = rng.choice([1, 2, 3, 60], 1200, p=[0.5, 0.3, 0.18, 0.02])
    vectors = np.repeat(centres, sizes, axis=0)
    vectors = vectors + rng.normal(size=vectors.shape) * 0.03
    rows = [(int(k), v.tolist()) for k, v in enumerate(vectors)]
    rows += [(int(k + len(vectors)), rows[k][1]) for k in range(0, len(vectors), 50)]  # exact copies
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()}
    owner = np.arange(len(rows))
    while not np.array_equal(owner, new := np.where(near, owner, len(rows)).min(1)):
        owner = new
    assert got == {rows[k][0]: (int(near[k].sum()) - 1, int(owner[k])) for k in range(len(rows))}
