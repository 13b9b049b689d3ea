"""Main text where the merged trees have to decide."""

import math

import pytest
from pyspark.sql import functions as F

from ashlar.llm import site_style


def texts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in site_style.main_text(pages, ["page_id"]).collect()}


@pytest.mark.parametrize("most", [50_000, 0])
def test_copies_of_one_page_keep_its_text(spark, monkeypatch, most):
    monkeypatch.setattr(site_style, "BROADCAST_HOSTS", most)
    page = "<body><div id=post-17><p>all of the text</p><p>and more</p></div></body>"
    whole = "all of the text\n\nand more"
    rows = [(0, "http://one.example/", page), (1, "http://two.example/a", page), (2, "http://two.example/b", page)]
    rows += [(3, "http://twice.example/", "<body><div>said</div><div>said</div></body>")]
    # A host of other pages, where one page is there in copies and has a container of its own.
    rows += [(10 + i, f"http://many.example/{i}", f"<body><section id=entry-{i}><p>page {i}</p></section></body>") for i in range(20)]
    rows += [(100 + i, f"http://many.example/x{i}", page) for i in range(30)]
    found = texts(spark, rows)
    assert found[0] == found[1] == found[2] == whole
    assert found[3] == "said\n\nsaid"
    assert all(found[10 + i] == f"page {i}" for i in range(20))
    assert all(found[100 + i] == whole for i in range(30))


def test_numbers_and_titles_do_not_part_nodes():
    step = lambda tag: site_style.parsed(f"{tag}<p>x</p>")[0][0][0]
    assert step("<div id=post-17 class='k post-17'>") == step("<div id=post-4 class='k post-4'>")
    assert step("<div id=how-to-sew>") == step("<div id=a-day-out-there>") != step("<div id=body>")


def test_repeated_box_under_numbered_containers_goes(spark):
    rows = [(i, f"http://a.example/{i}", f"<body><div id=post-{i}><p>text {i}</p><div class=k9>Our offer</div></div></body>") for i in range(30)]
    assert all(t == f"text {i}" for i, t in texts(spark, rows).items())


def test_trees_decide_in_and_beside_an_article(spark):
    def page(i, host):
        box = "<div class=k9>Our offer of the day</div>"
        return f"<body><article><h1>title {i}</h1>{box}<p>text {i}</p></article><div class=q>aside {i}</div><div class=z>Same on {host}</div></body>"

    rows = [(i, f"http://a.example/{i}", page(i, "a")) for i in range(30)]
    # The body beside an article that only teases, and an article on one page of its host.
    rows += [(50 + i, f"http://b.example/{i}", f"<body><article><p>More to read</p></article><div class=x><p>body {i}</p></div></body>") for i in range(30)]
    rows += [(90, "http://c.example/", "<body><article><div class=k9>Our offer of the day</div></article></body>")]
    found = texts(spark, rows)
    assert all(found[i] == f"title {i}\n\ntext {i}\n\naside {i}" for i in range(30))
    assert all(found[50 + i] == f"body {i}" for i in range(30))
    assert found[90] == "Our offer of the day"


def test_names_are_a_prior_for_whole_names_only(spark):
    """Headings and sections that merely share a word with furniture stay, and so do other attributes."""
    page = (
        "<body><article><h2 id='related-work'>Related work</h2><p>first</p><section class='side-effects'><h3>Side effects</h3><p>second</p>"
        '</section><h2 id="sharing-memory">Sharing memory</h2><p data-id="comments" data-role=menu>third</p>'
        "<div class='related-posts'>Read this, too</div><div class=\"comment-list item-3\">I agree</div></article></body>"
    )
    found = texts(spark, [(1, "http://a.example/", page)])
    assert found[1] == "Related work\n\nfirst\n\nSide effects\n\nsecond\n\nSharing memory\n\nthird"


def test_stray_quotes_end_with_their_tag():
    said = lambda page: " ".join(b[2] for b in site_style.parsed(page)[0])
    assert said("<p>see <a href=x title=don't>this</a> and <b title='a > b' id=\"c>d\">that</b></p>") == "see this and that"
    assert said('<p class="x>open</p><p>1 < 2 and 3 > 2</p>') == "open 1 < 2 and 3 > 2"
    assert said("<p " + "a='b' " * 5000) != ""


def plain_importance(rows):
    """Entropies by loops: host -> node -> importance, of distinct pages."""
    found = {}
    for host in {h for h, _ in rows}:
        pages = {tuple(site_style.parsed(page)[0]): site_style.parsed(page) for h, page in rows if h == host}
        there, styles, said = {}, {}, {}
        for blocks, nodes in pages.values():
            for path in {n[0] for n in nodes}:
                there[path] = there.get(path, 0) + 1
            for path, style in nodes:
                styles.setdefault(path, []).append(style)
            for path, _, text in blocks:
                said.setdefault(path, []).append(text)
        for path, all_styles in styles.items():
            m = len(all_styles)
            entropy = -sum(all_styles.count(s) / m * math.log(all_styles.count(s) / m) for s in set(all_styles))
            layout = entropy / math.log(m) if m > 1 else 1.0
            mine = said.get(path, [])
            content = 1 - sum(math.log(mine.count(t)) for t in mine) / len(mine) / math.log(m) if m > 1 and mine else 0.0
            found[site_style._number(host, path)] = max(layout, content) if there[path] > 1 else 1.0
    return found


def test_importance_equals_plain_entropies(spark):
    rows = []
    for i in range(12):
        extra = "<ul><li>a</li><li>b</li></ul>" if i % 3 else ""
        rows.append(("one.example", f"<body><div class=top>Same</div><article><h1>t{i % 5}</h1><p>text {i}</p>{extra}</article><div>{i % 2}</div></body>"))
    rows += [rows[0], rows[1]] + [("two.example", "<body><p>alone</p></body>")] * 3
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(rows)], "page_id long, url string, html string")
    trees = site_style.trees(pages, ["page_id"]).withColumn("page", F.col("row.page_id"))
    found = {r.node: r.importance for r in site_style.importance(trees).collect()}
    expected = plain_importance(rows)
    assert found.keys() == expected.keys() and len(found) > 8
    for node, value in expected.items():
        assert found[node] == pytest.approx(value, abs=1e-12)
