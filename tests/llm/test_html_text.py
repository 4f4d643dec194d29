
import itertools
import random

from quern.llm import html_text
from quern.llm.html_text import extract, induce, match, parse


def test_article_without_the_rest():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>top</header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad 0 --><div class="ad">buy</div>
    <article><h1>Ti&amp;tle</h1><p><b>one<br><p>two  <i>three</i>
    four</p><div class="advert-box">ad</div><ul><li>x<li>y</ul>bare &lt;tag&gt; &eacute;<form>name <input></form>
    <section id="comments"><p>first!</p></section><script>no()</script></article>
    <aside>side</aside><div class="cookie-notice">ok?</div><footer>&copy; me</footer></body></html>"""
    assert extract(page) == "Ti&tle\n\none\n\ntwo three four\n\nx\n\ny\n\nbare <tag> é"


def test_odd_pages():
    assert extract(None) == extract("") == ""
    assert extract("plain text only") == "plain text only"
    assert extract("<article><p>cut sho") == "cut sho"
    assert extract("<article><p>cut</p><p") == "cut"
    assert extract("<article><p>a < b &am</p><!-- open") == "a < b &am"
    assert extract('<article><p title="a>b">q</p></article>') == "q"
    assert extract("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>") == "deep"
    assert len(extract("<article><p>" + "word " * 200000)) == 999999


def test_match_is_maximal():
    rng = random.Random(2)

    def tree(depth):
        return f"<div>{''.join(tree(depth - 1) if rng.random() < 0.5 else rng.choice(['<p>x</p>', '<h2>y</h2>']) for _ in range(rng.randint(0, 3)))}</div>" if depth else "<p>z</p>"

    def brute(a, b):
        if (a.tag, a.name) != (b.tag, b.name):
            return 0
        best = 0
        x, y = a.children, b.children
        for n in range(min(len(x), len(y)) + 1):
            for p in itertools.combinations(x, n):
                for q in itertools.combinations(y, n):
                    best = max(best, sum(brute(s, t) for s, t in zip(p, q)))
        return 1 + best

    for _ in range(150):
        a, b = parse(tree(3)), parse(tree(3))
        size, pairs = match(a, b)
        assert len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs}) == len(pairs) == size
        assert size == brute(a, b)
        assert match(a, a)[0] == brute(a, a)


def plain(i, host):
    """A page without marks: the frame repeats, the texts vary."""
    return (i, f"http://{host}/{i}", f"<body><div class='top'>Welcome to {host}</div><div class='x'><h2>Title {i}</h2><p>Text {i} of {host}.</p>{'<p>More.</p>' * (i % 3)}</div><div class='z'>All rights reserved</div></body>", "q")


def test_constant_nodes_are_template(spark):
    rows = [plain(i, h) for h in ("a.example", "b.example") for i in range(12)] + [(99, None, None, ""), (98, "http://one.example/", "<p>alone</p>", ""), (97, "x", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r for r in html_text.main_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(12):
        for h in ("a.example", "b.example"):
            assert got[i, f"http://{h}/{i}"].text.split("\n\n")[:2] == [f"Title {i}", f"Text {i} of {h}."]
            assert "Welcome" not in got[i, f"http://{h}/{i}"].text and "rights" not in got[i, f"http://{h}/{i}"].text
    assert got[99, None].text == "" and got[98, "http://one.example/"].text == "alone" and got[98, "http://one.example/"].n_chars == 5
    assert html_text.main_text(df.where("false")).count() == 0


def test_repeated_article_stays(spark):
    rows = [(i, "http://c.example/x", "<body><nav>m</nav><article><h1>Same</h1><p>Same text</p></article></body>") for i in range(6)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Same\n\nSame text"} and len(got) == 6


def test_rare_layout_is_in_the_template(spark):
    rows = [(i, f"http://d.example/{i}", f"<body><div class='x'><p>Text {i}</p></div></body>") for i in range(300)]
    rows += [(i, f"http://d.example/{i}", f"<body><div class='frame'>Printed for friends of d</div><div class='rare'><p>Rare {i}</p></div></body>") for i in range(300, 306)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Text {i}" if i < 300 else f"Rare {i}" for i in range(306)}


def test_copies_are_no_template(spark):
    def page(x):
        return f"<body><div><h2>Head {x}</h2><p>Words {x}</p></div></body>"

    rows = [(i, "http://e.example/x", page("same")) for i in range(9)] + [(10 + i, "http://e.example/y", page(i)) for i in range(3)]
    rows += [(20 + i, "http://f.example/z", page("twice")) for i in range(2)] + [(30 + i, "http://g.example/z", page(i)) for i in range(2)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: "same" for i in range(9)} | {10 + i: i for i in range(3)} | {20: "twice", 21: "twice", 30: 0, 31: 1}
    assert got == {i: f"Head {x}\n\nWords {x}" for i, x in want.items()}


def test_constant_blocks_in_articles(spark):
    def page(i, body):
        return (i, f"http://h.example/{i}", f"<body><nav>m</nav><article><h1>Title {i}</h1>{body}<div class='more'>Read more of h every week</div></article></body>")

    rows = [page(i, "".join(f"<p>Text {i} {k}</p>" for k in range(i % 4 + 2))) for i in range(20)]
    # Two long near copies have nodes that no other page has; those aren't template.
    rows += [page(i, f"<p>Long {i}</p>" + "".join(f"<p>Shared text {k}</p>" for k in range(12))) for i in (20, 21)]
    # A host of near copies keeps its articles.
    rows += [(i, f"http://k.example/{i}", f"<body><article><h1>{i}</h1><p>A text that all of these pages share.</p></article></body>") for i in range(30, 34)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(20):
        assert got[i] == "\n\n".join([f"Title {i}"] + [f"Text {i} {k}" for k in range(i % 4 + 2)])
    for i in (20, 21):
        assert got[i] == "\n\n".join([f"Title {i}", f"Long {i}"] + [f"Shared text {k}" for k in range(12)])
    for i in range(30, 34):
        assert got[i] == f"{i}\n\nA text that all of these pages share."


def test_stray_quotes_end_with_the_tag():
    assert extract("<article><p title=it's>one</p><p>two</p></article>") == "one\n\ntwo"
    assert extract('<article>a <img alt="5" tall">b<p>it\'s "c" > d</p></article>') == "a b\n\nit's \"c\" > d"
    assert extract("<article><p title=it's>one</p><p>it's</p><p title='x>y' b=\">\" c = 1/2 d= >two</p></article>") == "one\n\nit's\n\ntwo"
    assert extract('<article><p>one</p><p title="open>two</p>') == "one"
    assert extract("<article><p>one</p></article>" + '<a b="' * 100_001) == "one"
    assert extract("<div class = ad>x</div><div id='share'>y</div><div data-a='\"' class=\"menu\">z</div><p class=a/b>q</p>") == "q"


def test_depth_loses_nothing():
    for deep in (100, 119, 120, 121, 130, 5000):
        page = f"<div><article>{'<div>' * deep}in<nav>menu<div>more</div><nav>x</nav></nav><p>deep</p>on{'</div>' * deep}<p>after</p></article></div>"
        assert extract(page).replace("on\n\nafter", "on\n\nafter") == "in\n\ndeep\n\non\n\nafter", deep
    assert extract("<article>" + "<div>" * 300 + "<p>one<p>two" + "</div>" * 300 + "<ul><li>x<li>y</ul></article>") == "one\n\ntwo\n\nx\n\ny"


def test_article_keeps_what_only_sounds_like_a_frame():
    page = "<article><p class='share-price'>12</p><div class='widget'>w</div><p>f <math><mi>x</mi><mo>=</mo><mn>1</mn></math> g <canvas>c</canvas></p><div class='related-work'>r</div><div class='comments'>no</div><div class='side-bar'>no</div></article>"
    assert extract(page) == "12\n\nw\n\nf x=1 g c\n\nr"


def test_query_against_brute_force(spark):
    """Flat frames: what the wrapper takes out is what repeats on half of a host's distinct pages, counted here line by line."""
    rng = random.Random(11)
    rows, want = [], {}
    for h in range(3):
        frame = [f"Host {h} greets you", f"Made by host {h}"]
        for i in range(14):
            body = [f"h{h} p{i} {k} {rng.random()}" for k in range(3)]
            html = f"<body><div class='a'>{frame[0]}</div><section class='b'><p>{body[0]}</p><p>{body[1]}</p><p>{body[2]}</p></section><div class='c'>{frame[1]}</div></body>"
            rows.append((h * 100 + i, f"https://h{h}.example/{i}", html, "t", "k"))
            want[h * 100 + i] = "\n\n".join(body)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, template string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.main_text(df).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    alone = {r[0]: extract(r[2]) for r in rows}
    assert all(alone[i] != want[i] for i in want)  # without the wrapper the frame would stay
