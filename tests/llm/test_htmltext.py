"""Operator 2 on made pages: marked articles, induced templates and odd markup."""

from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sparkassay.llm import dom, htmltext
from sparkassay.llm.dom import match, parse


def run(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id bigint, url string, html string, text string, host int").repartition(2)
    return {r.page_id: r for r in htmltext.extract(frame).collect()}


def test_marked_article(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/">Home</a></ul></nav><!-- ad --><div class="ad">Buy</div><div class="cookie-notice">We use cookies</div>
    <aside>More</aside><form>Name <input></form><article><header><h1>A &amp; B</h1><span>By me</span></header><p><b>First&nbsp;&eacute;  line<br>goes on<p>Second <i>p</i>art
    <ul><li>one<li>two</ul><div class="share">Share this</div><section id="comments"><p>Nice!</p></section></article><footer>&copy; x</footer></body></html>"""
    got = run(spark, [(1, "http://h.example/1", page), (2, None, None), (3, "odd", ""), (4, "http://h.example/2", "no tags, 1 < 2 &lt; 3"), (None, "http://h.example/3", "<p>x<p>y")])
    assert got[1].text == "A & B\nFirst é line goes on\nSecond part\none\ntwo"
    assert got[1].n_chars == len(got[1].text) and got[1].url == "http://h.example/1"
    assert (got[2].text, got[2].n_chars, got[2].url) == ("", 0, None) and got[3].text == ""
    assert got[4].text == "no tags, 1 < 2 < 3" and got[None].text == "x\ny"


def test_induced_template(spark):
    page = lambda i: f"<body><div>Welcome to our site</div><div><p>Story {i} begins here.</p><p>It ends {'here' * (i + 1)}.</p></div><div>All rights reserved</div></body>"
    rows = [(i, f"https://Site.example:80/{i}", page(i)) for i in range(8)]
    rows += [(20, "https://other.example/", page(1)), (21, "https://site.example/x", page(3)), (21, "https://site.example/x", page(3))]
    got = run(spark, rows)
    for i in range(8):
        assert got[i].text == f"Story {i} begins here.\nIt ends {'here' * (i + 1)}."
    assert got[20].text.startswith("Welcome") and got[21].text == got[3].text


def test_hostile_markup(spark):
    rows = [(1, "http://a/1", "<div>" * 3000 + "deep" + "</div>" * 10), (2, "http://a/2", "<p " + "a='" * 2000), (3, "http://a/3", "<script>never closed"), (4, "http://a/4", "<p>long " + "word " * 60_000), (5, "http://a/5", "</p></div><li>x</ul><td>y"), (6, "http://a/6", "".join(f"<div class=c{i}>{i}</div>" for i in range(600)))]
    got = run(spark, rows)
    assert got[1].text == "deep" and got[3].text == "" and got[4].n_chars == len("long " + "word " * 59_999 + "word") and got[5].text == "x\ny"
    assert got[6].text.split("\n") == [str(i) for i in range(600)]


def test_empty_table(spark):
    assert htmltext.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


TREES = st.recursive(st.builds(lambda x: (x, []), st.sampled_from("ab")), lambda kids: st.tuples(st.sampled_from("ab"), st.lists(kids, max_size=3)), max_leaves=8)


def flat(tree):
    labels, children = [], []

    def add(node):
        n = len(labels)
        labels.append(node[0])
        children.append([])
        for kid in node[1]:
            children[n].append(add(kid))
        return n

    add(tree)
    return labels, children


def largest(a, b):
    """Size of the largest alignment, by plain recursion."""
    if a[0] != b[0]:
        return 0

    def rows(p, q):
        if not p or not q:
            return 0
        return max(rows(p[1:], q), rows(p, q[1:]), rows(p[1:], q[1:]) + largest(p[0], q[0]))

    return 1 + rows(a[1], b[1])


@settings(max_examples=100, deadline=None)
@given(TREES, TREES)
def test_simple_tree_matching(a, b):
    x, y = flat(a), flat(b)
    pairs = match(x, y)
    assert len(pairs) == largest(a, b)
    assert all(x[0][m] == y[0][n] for m, n in pairs.items()) and len(set(pairs.values())) == len(pairs)


def test_records_are_one_node():
    page = parse("<ul>" + "<li><h3>t</h3><p>x</p></li>" * 50 + "</ul>")
    assert len(page.label) == 5 and len(page.pieces) == 100


def test_deep_nesting(spark):
    deep = lambda inside: "<div>" * 70 + inside + "</div>" * 70
    page = f"<body><div id=page><article><p>First.</p>{deep('<p>Deep.</p><nav>Menu</nav><div class=share>Share</div>')}<p>Second.</p></article></div><p>Outside</p>"
    assert run(spark, [(1, "http://a/1", page)])[1].text == "First.\nDeep.\nSecond."


def test_wide_and_deep_trees():
    rng = random.Random(4)
    p, q = ([rng.choice("abcdefgh") for _ in range(n)] for n in (260, 300))
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i, x in enumerate(p):
        for j, y in enumerate(q):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + (x == y))
    wide = lambda kids: (["r", *kids], [list(range(1, len(kids) + 1)), *([] for _ in kids)])
    assert len(match(wide(p), wide(q))) == 1 + best[-1][-1]
    chain = lambda n, last: (["d"] * (n - 1) + [last], [[i + 1] for i in range(n - 1)] + [[]])
    assert len(match(chain(5000, "x"), chain(5000, "y"))) == 4999


def test_halved_alignment(monkeypatch):
    rng = random.Random(6)
    tree = lambda n: flat(("r", [(rng.choice("ab"), [(rng.choice("ab"), []) for _ in range(rng.randint(0, 2))]) for _ in range(n)]))
    pairs = [(tree(40), tree(50)) for _ in range(20)]
    whole = [len(match(a, b)) for a, b in pairs]
    monkeypatch.setattr(dom, "CELLS", 9)
    assert [len(match(a, b)) for a, b in pairs] == whole


def test_template_inside_articles(spark):
    page = lambda i: f"<body><article><h1>Title {i}</h1><div class=strap>Read by everyone in town</div><p>Story {i}.</p></article><article><p>More of {i}.</p></article></body>"
    rows = [(0, "http://s.example/0", ""), *((i, f"http://s.example/{i}", page(i)) for i in range(1, 9))]
    rows += [(i, f"http://t.example/{i}", f"<body><article><p>The same story.</p></article><div>{i}</div></body>") for i in range(20, 28)]
    got = run(spark, rows)
    for i in range(1, 9):
        assert got[i].text == f"Title {i}\nStory {i}.\nMore of {i}."
    assert {got[i].text for i in range(20, 28)} == {"The same story."}  # copies of each other, not template


def test_references_of_several_layouts(spark):
    story = lambda i: f"<body><div>Our daily news</div><p>Story {i}.</p></body>"
    album = lambda i: f"<body><section><h2>Album {i}</h2><h3>All pictures here</h3></section></body>"
    got = run(spark, [(i, f"http://s.example/{i}", (album if i % 2 else story)(i)) for i in range(16)])
    assert [got[i].text for i in range(16)] == [f"Album {i}" if i % 2 else f"Story {i}." for i in range(16)]


def test_end_tags_quotes_and_names(spark):
    body = lambda inside: f"<body><article><p>Start.</p>{inside}<p>End.</p></article></body>"
    cases = {
        "<button>Go": "Start.\nGo\nEnd.",
        "<button>Go</button>": "Start.\nEnd.",
        "<input list=x><datalist id=x><option>One<option>Two</datalist>": "Start.\nEnd.",
        "<select><option>One<option>Two</select>": "Start.\nEnd.",
        "<p title=it's>hello</p><p>it's more</p>": "Start.\nhello\nit's more\nEnd.",
        '<p title="a > b" class = \'x\'>quoted</p>': "Start.\nquoted\nEnd.",
        "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>": "Start.\nLet x=2 be.\nEnd.",
        "<p>Text <span class=ad>Buy <span>now</span>!</span> goes on.</p>": "Start.\nText goes on.\nEnd.",
        "<p>Text <span class=ad>Buy now": "Start.\nText\nEnd.",
        "<div class='notice-of-motion'>Moved.</div>": "Start.\nMoved.\nEnd.",
        "<div class='social-history'>Long ago.</div>": "Start.\nLong ago.\nEnd.",
        "<div class='article-body related-story'>Told.</div>": "Start.\nTold.\nEnd.",
        "<div class='cookie-notice'>Cookies!</div><div class='box'>A</div><div class='box ad-banner'>B</div><div class=shareButtons>C</div>": "Start.\nA\nEnd.",
        "<div id=comments><p>First!</p></div><div class='comment-list'><p>Second!</p></div>": "Start.\nEnd.",
    }
    got = run(spark, [(i, f"http://h{i}.example/", body(x)) for i, x in enumerate(cases)])
    assert {x: got[i].text for i, x in enumerate(cases)} == cases


def test_layout_without_any_telling_name(spark):
    """The pages table with its elements and classes made neutral: the wrapper alone finds the same text."""
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    want = {i: r.text for i, r in run(spark, pages).items()}
    neutral = lambda h: re.sub(r"<(/?)(nav|article|footer)>", lambda m: "</div>" if m[1] else f"<div class={'abc'[('nav', 'article', 'footer').index(m[2])]}>", h.replace('class="ad"', "class=d"))
    got = run(spark, [(i, u, neutral(h)) for i, u, h in pages])
    assert len(want) == len(pages) and sum(got[i].text == want[i] for i in want) >= 0.95 * len(want)
    mixed = [p for p in pages if "<nav>" in p[2]]
    assert mixed and all("<a " not in got[i].text for i, _, _ in mixed)


def plain_extract(rows, share=htmltext.SHARE, support=htmltext.SUPPORT):
    """Texts by the rules of the operator, with a recursive alignment and loops over all pairs of pages of one host."""
    pages = {i: parse(h) for i, h in rows}
    shape = lambda p: str((p.label, p.children, p.flags))

    def pairs(p, q, a=0, b=0):
        if p.label[a] != q.label[b]:
            return {}
        memo = {}

        def rows_(i, j):
            if (i, j) not in memo:
                x, y = p.children[a], q.children[b]
                if i == len(x) or j == len(y):
                    memo[i, j] = {}
                else:
                    met = pairs(p, q, x[i], y[j])
                    memo[i, j] = max(*([{**met, **rows_(i + 1, j + 1)}] if met else []), rows_(i + 1, j), rows_(i, j + 1), key=len)
            return memo[i, j]

        return {a: b, **rows_(0, 0)}

    texts = {i: [[t for n, t, _ in p.pieces if n == m] for m in range(len(p.label))] for i, p in pages.items()}
    by_shape = {}
    for i, p in pages.items():
        if p.pieces:
            by_shape.setdefault(shape(p), []).append(i)
    wrappers = []
    for _, ids in sorted(by_shape.items(), key=lambda x: (-len(x[1]), x[0]))[: htmltext.LAYOUTS]:
        q, slots = pages[min(ids)], {}
        for ref in {str(texts[i]): i for i in (max(ids), min(ids))}.values():
            for m in range(len(q.label)):
                met = [(i, n) for i, p in pages.items() for n, other in pairs(p, q).items() if other == m and (texts[i][n] or texts[ref][m])]
                told = [(i, n) for i, n in met if texts[ref][m] and (texts[i] != texts[ref] or shape(pages[i]) != shape(q))]
                if met:
                    plain = [sum(len(t) - k for x, t, k in pages[i].pieces if x == n) for i, n in met]
                    inner = [sum(k for x, t, k in pages[i].pieces if x == n) for i, n in met]
                    constant = len(told) >= support and sum(texts[i][n] == texts[ref][m] for i, n in told) >= share * len(told)
                    slots[m] = (sum(plain) / len(met), sum(inner) / len(met), constant or m in slots and slots[m][2])
        wrappers.append((q, slots))
    out = {}
    for i, p in pages.items():
        best = max(wrappers, key=lambda w: len(pairs(p, w[0])) / (len(p.label) + len(w[0].label) - len(pairs(p, w[0]))))
        tree = [best[0].label, best[0].children, best[0].flags, best[0].parent]
        inside, content = htmltext.induce(tree, best[1])
        met, state = pairs(p, best[0]), {}
        for n in range(len(p.label)):
            state[n] = (met[n] in inside, met[n] in content) if n in met else (state[p.parent[n]][0],) * 2
        kept = [t for n, t, _ in p.pieces if state[n][1] and not htmltext.out_of_text(p.flags[n])]
        out[i] = "\n".join(kept or [t for n, t, _ in p.pieces if state[n][0] and not htmltext.out_of_text(p.flags[n])])
    return out


def test_against_plain_induction(spark):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(["sun", "rain", "hill", "sea", "wood"]) + str(rng.randint(0, 99)) for _ in range(n))
    for host in range(4):
        fixed = [text(4) for _ in range(3)]
        rows = []
        for i in range(14):
            parts = [f"<div class=top>{fixed[0]}</div>", f"<ul class=menu-x>{''.join(f'<li><a href=/{j}>{text(2)}</a></li>' for j in range(4))}</ul>"]
            inner = f"<h1>{text(5)}</h1><div class=lead>{fixed[1] if i % 7 else text(4)}</div>" + "".join(f"<p>{text(rng.randint(5, 30))}</p>" for _ in range(rng.randint(1, 4)))
            if rng.random() < 0.5:
                inner += f"<div class=extra>{text(6)}</div>"
            parts.append(f"<{'article' if host % 2 else 'div'} class=story>{inner}</{'article' if host % 2 else 'div'}>")
            if rng.random() < 0.7:
                parts.append(f"<div class=tail>{text(3)}</div>")
            parts.append(f"<div class=legal>{fixed[2]}</div>")
            rows.append((i, f"<body>{''.join(parts)}</body>"))
        got = run(spark, [(i, f"http://p{host}.example/{i}", h) for i, h in rows])
        want = plain_extract(rows)
        assert {i: got[i].text for i, _ in rows} == want
        assert all(f not in t for t in want.values() for f in (fixed[0], fixed[2]))
        assert {i: got[i].text for i, _ in rows} != {i: r.text for i, r in run_with(spark, rows, share=2.0).items()}


def run_with(spark, rows, **options):
    frame = spark.createDataFrame([(i, "http://p.example/", h) for i, h in rows], "page_id bigint, url string, html string")
    return {r.page_id: r for r in htmltext.extract(frame, **options).collect()}
