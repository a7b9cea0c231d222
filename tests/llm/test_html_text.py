import random
from itertools import combinations

from tidemark.llm import html_text as H


def one(html):
    return H._finish({"page_id": 1, "url": "u", "host": "", "path": "", "lines": (x := H.lines_of(html)), "keys": [x.text for x in x]}, None)[2]


def test_article_with_chrome_around_and_inside():
    page = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">Cookies!</div>
    <article><header><h2>Title &lt;1&gt;</h2><span>by me</span></header><p>One\n two<b> three<br>four<p>Five &eacute;&#233; &am</p>
    <div class="ad">Buy</div><form><p>Name</p></form><aside>Side</aside><!-- <p>hidden</p> --><ul><li>a<li>b</ul><table><tr><td>x<td>y</table>
    <section class="comments"><article><p>First!</p></article></section><p>a < b & c</article>
    <div class="sidebar"><p>Links</p></div><footer>&copy; 2024</footer></body></html>"""
    assert one(page) == "Title <1>\nOne two three four\nFive éé &am\na\nb\nx\ny\na < b & c"


def test_broken_and_empty_pages():
    assert one(None) == "" and one("") == "" and one("<") == "<" and one("a <b") == "a"
    assert one("<p>cut off <a href='x") == "cut off"
    assert one("<script>never closed <p>x</p>") == ""
    assert one("<main><p>in main</p></main><p>out") == "in main"
    assert one("plain &nbsp; text\n\nonly") == "plain text only"
    assert one("<p title=\"a > b\">q</p><p hidden>no</p><img alt='x'/>r") == "q\nr"
    assert len(one("<article>" + "<p>word</p>" * 50_000 + "</article>").split("\n")) == 50_000


def test_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 9))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 9))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = sorted(H.shared_lines(a, b))
        assert len(got) == table[-1][-1]
        part = [a[i] for i in got]
        assert any(part == [b[j] for j in js] for js in combinations(range(len(b)), len(part)))


def test_differencing_deletes_what_near_pages_share(spark):
    """Without an article element only differencing can tell the site's lines."""
    def page(*lines):
        return "<body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body>"
    rows = [(1, "http://h.example/a/1", page("Welcome", "news one", "Imprint")), (2, "http://h.example/a/2?x=1", page("Welcome", "news two", "Imprint")),
            (3, "http://h.example/b/9.html", page("Welcome", "other nine", "Imprint")), (4, "http://alone.example/a/1", page("Welcome", "solo", "Imprint")),
            (5, None, page("Welcome", "no url")), (6, "http://h.example/a/1/", page("Welcome", "news one", "Imprint")), (7, "http://h.example/n", None),
            (1, "http://h.example/a/1", page("Welcome", "news one", "Imprint"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as host", "1 as path", "2 as text").repartition(3)
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in H.main_text(df).coalesce(1).collect())
    want = [(1, "news one"), (1, "news one"), (2, "news two"), (3, "other nine"), (4, "Welcome\nsolo\nImprint"), (5, "Welcome\nno url"), (6, "news one"), (7, "")]
    assert [g[1] for g in got if g[0] in (4, 5, 7)] == [w[1] for w in want if w[0] in (4, 5, 7)]
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:  # one range: every page of the host has its neighbours
        got = sorted((r["page_id"], r["text"]) for r in H.main_text(df).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == want
    assert H.main_text(df.limit(0)).count() == 0


def test_site_lines_inside_the_article_go(spark):
    """Share bars, bylines and notices without a known class go; prose that two articles share, near copies and cells stay."""
    def page(k, *more):
        return (f"<body><article><h1>Title {k}</h1><div>By our staff</div><p>Story {k} tells of {k} things that happened in town {k} today.</p>"
                f"<table><tr><td>yes</table>{''.join(f'<p>{x}</p>' for x in more)}<p>All rights stay with the paper.</p></article>")
    told = "A passage that two articles tell in the very same words."
    urls = [f"http://h.example/a/{k}" for k in range(1, 6)]
    rows = [(k, u, page(k, told) if k < 3 else page(k)) for k, u in enumerate(urls, 1)]
    two = [(k, f"http://two.example/{k}", f"<article><div>Share it</div><p>{told}</p><p>{f'Only page {k} says so. ' * 9}</p></article>") for k in (11, 12)]
    long = "".join(f"<p>Line {i} of a long story told twice.</p>" for i in range(20))
    copies = [(k, f"http://copies.example/{k}", f"<article>{long}<p>end {k}</p></article>") for k in (21, 22, 23, 24, 25)]
    df = spark.createDataFrame(rows + two + copies, "page_id long, url string, html string")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["page_id"]: (r["text"].split("\n"), r["n_deleted"]) for r in H.main_text(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for k in range(1, 6):
        story = [f"Title {k}", f"Story {k} tells of {k} things that happened in town {k} today.", "yes"]
        assert got[k] == (story + [told] * (k < 3), 2)
    for k in (11, 12):
        assert got[k] == ([told, " ".join([f"Only page {k} says so."] * 9)], 1)
    assert all(len(got[k][0]) == 21 and got[k][1] == 0 for k in range(21, 26))


def test_whole_table_keeps_article_lines(spark):
    from tests.conftest import SF0001
    df = spark.read.parquet(f"{SF0001}/pages.parquet")
    texts = {r["text"] for r in spark.read.parquet(f"{SF0001}/documents.parquet").select("text").collect()}
    got = H.main_text(df).collect()
    assert len(got) == df.count()
    # the article repeats its document after the heading
    assert sum(r["text"].split("\n", 1)[-1] in texts for r in got) >= 0.9 * len(got)


def test_attributes_are_read_by_name():
    """Ordinary article text whose attributes only look like chrome stays; real chrome goes."""
    kept = ['<p title="hidden gems">a</p>', '<p data-id="comment-3">a</p>', '<section id="search-algorithms"><p>a</p></section>', '<h2 id="related-work">a</h2>',
            '<p class="notice-of-award">a</p>', '<p data-class="ad">a</p>', "<p title='class=ad'>a</p>", '<p aria-hidden="false">a</p>', "<p class=lead id=x>a</p>"]
    gone = ['<p hidden>a</p>', '<p class="lead ad">a</p>', '<div class="cookie-notice">a</div>', "<div CLASS='Ad_2'>a</div>", '<div id="comments">a</div>', '<div role=search>a</div>',
            '<p aria-hidden="true">a</p>']
    for piece in kept:
        assert one(f"<article><p>x</p>{piece}</article>") == "x\na", piece
    for piece in gone:
        assert one(f"<article><p>x</p>{piece}</article>") == "x", piece


def test_teasers_beside_the_article_go():
    story = "<p>" + "A long story. " * 20 + "</p>"
    assert "Teaser" not in one(f'<article>{story}</article><article class="teaser"><h3>Teaser</h3><p>More</p></article>')
    assert one("<article><p>first half here</p></article><article><p>second half of it</p></article>") == "first half here\nsecond half of it"


def test_exact_alignment_at_every_size(monkeypatch):
    """Halved alignments are as long as whole ones, many equal lines or not."""
    rng = random.Random(6)
    for _ in range(60):
        letters = rng.choice([1, 2, 5, 40])
        a, b = ([rng.randint(0, letters) for _ in range(rng.randint(0, 120))] for _ in range(2))
        monkeypatch.setattr(H, "MAX_PAIRS", 10**9)
        whole = H.shared_lines(a, b)
        monkeypatch.setattr(H, "MAX_PAIRS", 3)
        halved = sorted(H.shared_lines(a, b))
        assert len(halved) == len(whole)
        at = iter(b)
        assert all(any(a[i] == x for x in at) for i in halved)  # a common subsequence indeed
    a, b = [k % 3 for k in range(20_000)], [k % 2 for k in range(20_000)]
    monkeypatch.setattr(H, "MAX_PAIRS", 2_000_000)
    got = sorted(H.shared_lines(a, b))
    at = iter(b)
    assert len(got) >= 13_333 and all(any(a[i] == x for x in at) for i in got)


def test_pairing_does_not_depend_on_the_partitions(spark):
    from tests.conftest import SF0001
    df = spark.read.parquet(f"{SF0001}/pages.parquet")
    found = []
    for n in ("1", "8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(tuple, H.main_text(df.repartition(3)).collect()), key=str))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] == found[2] and any(r[4] is not None for r in found[0])


def test_headings_of_the_article_stay(spark):
    """A heading at the same place on all near pages is the article's all the same."""
    rows = [(k, f"http://r.example/{k}", f"<article><h2>Ingredients</h2><p>Take {k} of the things that page {k} alone can name.</p><div>Share</div></article>") for k in range(1, 7)]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Ingredients\nTake {k} of the things that page {k} alone can name." for k in got)
