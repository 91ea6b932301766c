"""N-gram join and decontamination against brute force; main text of hand-made pages."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fundlens.llm import decontaminate as D, main_text as M, ngram_join as J
from fundlens.llm.main_text import main_text, with_main_text

SCHEMA = "doc_id long, text string, source string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_components(docs, k=5, percent=80):
    sets = []
    for key, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        sets.append((key, frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            at[x].append(i)
    for i, (_, s) in enumerate(sets):
        for j, both in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (key, s) in enumerate(sets):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return sorted(((key, len(s), low.get(find(i)) if s else key) for i, (key, s) in enumerate(sets)), key=repr)


def joined(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.similar_documents(docs).collect()), key=repr)


def test_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    shared = " ".join(rng.choice(words, 60))  # a passage that many documents hold
    for family in range(30):
        base = list(rng.choice(words, rng.integers(3, 120)))
        for _ in range(rng.integers(1, 9)):
            text = list(base)
            for _ in range(rng.integers(0, max(2, len(base) // 12))):
                text[rng.integers(len(text))] = str(rng.choice(words))
            docs.append((" ".join(text) + (" " + shared if family % 3 == 0 else "")).upper() if family % 7 == 0 else " ".join(text))
    chain = list(rng.choice(words, 200))  # a chain: neighbours are similar, its ends are not
    for step in range(12):
        docs.append(" ".join(chain))
        chain[step * 15 : step * 15 + 4] = [f"c{step}"] * 4
    docs += ["", None, " \n ", "one", "one", "ONE", "a b c d", "a b c d e", "é É " * 5]
    rows = [(i, t) for i, t in enumerate(docs)] + [(None, docs[0]), (None, "alone of all"), (5, docs[5]), (7, "other text of the same key")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).withColumn("component_id", F.lit("own"))
    assert joined(df) == brute_components(rows)


def test_join_of_a_hot_family_and_an_empty_table(spark):
    rng = np.random.default_rng(4)
    base = [f"h{i}" for i in range(150)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(rng.integers(0, 7)):
            text[rng.integers(150)] = f"n{rng.integers(10_000)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, rows[0][1]) for i in range(200)]
    assert joined(spark.createDataFrame([(i, t, None) for i, t in rows], SCHEMA)) == brute_components(rows)
    assert joined(spark.createDataFrame([], SCHEMA)) == []


def test_one_document_of_each_component_stays(spark):
    text = "a long enough text that is the same in several rows of this table"
    docs = spark.createDataFrame([(3, text, "a"), (1, text, "b"), (1, text, "b"), (2, "quite another one", "c"), (None, text, "d"), (4, None, "e")], SCHEMA)
    kept = J.one_per_component(docs, J.similar_documents(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id, r.source) for r in kept.collect()) == [(False, 1, "b"), (False, 2, "c"), (False, 4, "e"), (True, None, "d")]


def test_a_key_of_several_texts_loses_no_component(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(5, a, "s"), (6, a, "s"), (7, a + " more", "s"), (5, b, "s"), (3, b, "s"), (8, c, "s"), (8, d, "s"), (8, d + " more", "s"), (8, d, "s"),
            (9, "", "s"), (9, None, "s"), (9, " ", "s"), (10, None, "s"), (10, a, "s"), (None, a, "s"), (11, "unique", "s")]
    for part in (rows, rows[:5], rows[5:7]):
        docs = spark.createDataFrame(part, SCHEMA).withColumn("node", F.lit("own"))
        kept = J.one_per_component(docs, J.similar_documents(docs))
        assert kept.columns == docs.columns
        found = [(r.doc_id, ((r.text or "").strip() or "-")[0]) for r in kept.collect()]
        expected = {(5, "a"), (3, "b"), (8, "c"), (8, "d"), (9, "-"), (10, "-"), (None, "a"), (11, "u")} & {(k, ((t or "").strip() or "-")[0]) for k, t, _ in part}
        assert sorted(found, key=repr) == sorted(expected, key=repr)


def brute_hits(docs, items, width=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for item, passage in items:
            p = words(passage)
            size = min(width, len(p))
            sought = {tuple(p[i : i + size]) for i in range(len(p) - size + 1)} if p else set()
            for i in range(len(w) - size + 1):
                if sought and tuple(w[i : i + size]) in sought:
                    hit.update(range(i, i + size))
                    if item is not None:
                        found.add(str(item))
        out.append((key, len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


PASSAGE = " ".join(f"q{i}" for i in range(30))
DOCS = [
    (1, "before " * 20 + PASSAGE + " after" * 20), (2, PASSAGE.upper().replace(" ", ", ")), (3, " ".join(PASSAGE.split()[:12])), (4, "x " * 400 + " ".join(PASSAGE.split()[3:16])),
    (5, "so Short it is"), (6, None), (7, ""), (7, PASSAGE), (None, "a short one " + PASSAGE), (9, "clean words only here"), (10, "é ü short it " * 3), (11, "short it " * 50_000),
]
ITEMS = [(1, PASSAGE), (2, "short, it"), (3, None), (4, "..."), (None, "clean WORDS"), (10, " ".join(PASSAGE.split()[5:25])), (2, "short it")]


@pytest.mark.parametrize("most", [100_000, 3])
def test_hits_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_WINDOWS", most)  # beyond it the windows are joined
    docs = spark.createDataFrame([(k, t, "s") for k, t in DOCS], SCHEMA).withColumn("n_hit", F.lit("own"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r["items"], r.contaminated) for r in D.scan(docs, bench).collect()]
    assert sorted(found, key=repr) == brute_hits(DOCS, ITEMS)
    bad = Counter(k for k, *_, dirty in brute_hits(DOCS, ITEMS) if dirty)
    kept = D.remove_documents(docs, bench)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(k for k, _ in DOCS) - bad


def test_cut_spans_and_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, f"Keep this, {PASSAGE}! And this.", "s"), (2, "Nothing here", "s"), (3, None, "s"), (4, f"--{PASSAGE}", "s")], SCHEMA)
    bench = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    cut = {r.doc_id: r.text for r in D.remove_spans(docs, bench).collect()}
    assert cut[1].startswith("Keep this, ") and cut[1].endswith("! And this.") and "q1" not in cut[1]
    assert cut[2] == "Nothing here" and cut[3] is None and cut[4].strip() == "--"
    assert D.scan(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert D.scan(docs.limit(0), bench).count() == 0


def test_main_text_of_an_article():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>not, this, one</p>";</script><style>p{}</style></head><body>
      <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="sidebar-right"><p>Side, by, side, and, more, of, it</p></div>
      <div id="cookie-notice">We use cookies, as, you, know</div><article><h2>Tom &amp; Ann&nbsp;&#x263A;</h2><p>First   paragraph,
      with <b>bold</b> and <a href=x>a link</a>.<p>Second one<br>goes on.<ul><li>point one<li>point two</ul><div class="ad">Buy!</div>
      <form><p>Name, please, now</p></form><table><tr><td>cell a<td>cell b</table><!-- no --></article>
      <section class="comments"><p>Great, really, very, good, post</p></section><footer>&copy; 2020</footer></body>"""
    assert main_text(page) == "Tom & Ann ☺\nFirst paragraph, with bold and a link.\nSecond one goes on.\npoint one\npoint two\ncell a\ncell b"


def test_main_text_without_article_element():
    body = "".join(f"<p>Sentence number {i}, which is long enough, and has commas.</p>" for i in range(5))
    links = "".join(f'<p><a href="/{i}">link, with, many, commas, number {i}</a></p>' for i in range(30))
    page = f'<div id=wrap><div class=box>{links}</div><div class=box><h1>Head</h1><div class=entry>{body}</div></div><div>Imprint</div></div>'
    assert main_text(page).split("\n") == ["Head"] + [f"Sentence number {i}, which is long enough, and has commas." for i in range(5)]


PROSE = [f"Sentence number {i} of the article, which is long enough, and has commas." for i in range(4)]


@pytest.mark.parametrize("marks", [
    "class=has-sidebar", "class='content no-sidebar'", "class='page header-fixed'", "class='hentry comments-open'", "class=hasSidebar", "class='layout sidebar-right'",
    "class='post-with-comments'", "id=sidebar-layout"])
def test_main_text_of_marked_wrappers(marks):
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    boxes = "<div class=sidebar><p>Side, by, side, and, more</p></div><div class=comments>" + "<p>Great, really, very, good, post, and so on and on</p>" * 40 + "</div>"
    assert main_text(f"<body><div {marks}>{body}</div></body>").split("\n") == PROSE
    assert main_text(f"<body><div {marks}><div>{body}</div>{boxes}</div><div>Imprint</div></body>").split("\n") == PROSE
    assert main_text(f"<div {marks}><article {marks}>{body}</article>{boxes}</div>").split("\n") == PROSE
    assert main_text(f"<div {marks}><main {marks}>{body}</main></div>{boxes}").split("\n") == PROSE


def test_long_marked_parts_beside_an_article_go():
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    long = "<p>Great, really, very, good, post, and so on and on</p>" * 40
    for marks in ("class=comments", "id=comments class=comments-area", "class=footer", "id=sidebar", "hidden", "class=cookie-notice"):
        assert main_text(f"<div class=text>{body}</div><div {marks}>{long}</div>").split("\n") == PROSE, marks
    assert main_text(f"<article>{body}</article><div class=sidebar-right>{long}</div>").split("\n") == PROSE


def test_main_text_without_the_end_of_the_head():
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    script = "<script>var a = 1</script><style>p{}</style>"
    for page in (f"<html><head><title>T</title><body>{body}", f"<html><head><title>T</title>{script}{body}</html>", f"<head><title>T<body>{body}</body>",
                 f"<head><noscript><img src=x><p>no</p></noscript><meta name=a><title>T</title><template><p>no</p></template></head>{body}",
                 f"<head><noscript><img src=x><title>T</title><body>{body}", f"<html><title>T</title>{script}{body}", f"<title>T<body>{body}", f"<title>T{body}",
                 f"<head><title>About <b> and so on</title></head>{body}"):
        assert main_text(page).split("\n") == PROSE, page
    assert main_text("<head><meta name=a>Words of the page") == "Words of the page"
    assert main_text("<title>T</title>") == main_text("<head><title>T</title></head>") == ""


def test_main_text_of_short_articles_in_parts():
    assert main_text("<body><div>The first paragraph.</div><div>The second paragraph.</div></body>") == "The first paragraph.\nThe second paragraph."
    one, two = (f"<div><p>{PROSE[i]}</p><p>{PROSE[i + 1]}</p></div>" for i in (0, 2))
    links = "<div><ul>" + "".join(f"<li><a href=/{i}>Page number {i}</a>" for i in range(20)) + "</ul></div>"
    noise = "<div class=ad>Buy!</div>" + links
    assert main_text(f"<body>{links}{one}{two}{noise}</body>").split("\n") == PROSE
    between = "<h3>Head</h3><ul><li>point</ul><blockquote>Said.</blockquote><table><tr><td>cell</table><p>Short.</p>bare <b>words</b> here"
    parts = ["Head", "point", "Said.", "cell", "Short.", "bare words here"]
    assert main_text(f"<body>{links}<section>{one}{between}{noise}{two}</section>{noise}</body>").split("\n") == PROSE[:2] + parts + PROSE[2:]
    nested = [f"<div class=part><div><div>{x}</div></div><div class=ad>Buy!</div></div>" for x in (one, two)]
    assert main_text(f"<body>{links}<div>{nested[0]}{between}{nested[1]}</div></body>").split("\n") == PROSE[:2] + parts + PROSE[2:]
    mixed = main_text(f"<div><div>{one}{links}</div><div>{two}{links}</div></div>").split("\n")
    assert [x for x in mixed if x in PROSE] == PROSE
    assert main_text("<div><span>a <b>b</b></span><div><p>one, two, three</p></div>tail</div>") == "a b\none, two, three\ntail"


def test_main_text_edge_cases(spark):
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x</script>") == ""
    assert main_text("just text") == "just text" and main_text("a &lt; b &am &copy") == "a < b &am ©"
    assert main_text("<div>" * 30_000 + "<p>deep, text</p>") == "deep, text"
    assert len(main_text("<article>" + "<p>word, word</p>" * 50_000)) == 50_000 * 11 - 1
    pages = spark.createDataFrame([(1, "<p>a, b</p>", "x"), (1, "<p>a, b</p>", "x"), (None, None, None)], "page_id long, html string, text string")
    assert sorted(r.text for r in with_main_text(pages).collect()) == ["", "a, b", "a, b"]
    assert with_main_text(pages.limit(0)).count() == 0


def test_columns_of_clashing_names_stay(spark):
    item = " ".join(f"b{i}" for i in range(13))
    rows = [(1, item, "h", "k", "d", 5, "s"), (2, "one, two", "h2", None, "d2", 6, "s2"), (2, "one, two", "h2", None, "d2", 6, "s2"), (None, "three", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _hit string, key string, doc string, _row int, found string")
    bench = spark.createDataFrame([("x", item)], "item_id string, text string")
    assert sorted(map(tuple, D.remove_documents(docs, bench).collect()), key=repr) == sorted(rows[1:], key=repr)
    cut = D.remove_spans(docs, bench)
    assert cut.columns == docs.columns
    assert {(r.text.strip(), r._hit, r.doc) for r in cut.collect()} == {("", "h", "d"), ("one, two", "h2", "d2"), ("three", None, None)}
    kept = J.one_per_component(docs, J.similar_documents(docs))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[1], rows[3]], key=repr)


ARTICLE = "<p>" + "This is a sentence of the article, with words. " * 6 + "</p>"
ARTICLE_TEXT = " ".join(("This is a sentence of the article, with words. " * 6).split())


def test_malformed_sections_are_comments():
    for page, text in {
        "<p>x</p><![foo[bar]]>": "x", "<![x y z]><p>stays, it does</p>": "stays, it does", "<p>a</p><![": "a", "<p>a</p><!-- open": "a", "<p>a</p><!": "a",
        "<p>b</p><![CDATA[zz]]><p>c</p>": "b\nc", "<![if !IE]><p>kept, yes</p><![endif]>": "kept, yes", "<![]]><![[>": "",
    }.items():
        assert main_text(page) == text, page


def test_frames_of_the_page_stay_and_forms_go():
    page = "<body><form id=f><input type=hidden>{}<div><input><button>Go</button></div></form><div>Copyright 2024</div></body>"
    assert main_text(page.format(ARTICLE * 2)).startswith(f"{ARTICLE_TEXT}\n{ARTICLE_TEXT}")
    assert "Go" not in main_text(page.format(ARTICLE))
    assert main_text(f"<body><noscript>{ARTICLE}</noscript></body>") == ARTICLE_TEXT
    assert main_text(f"<body><header>{ARTICLE}</header></body>") == ARTICLE_TEXT
    login = "<form><p>Log in please, it is free.</p><label>Name</label><input><button>Send</button></form>"
    assert main_text(f"<body><header><p>The site, since 1999</p></header>{login}<div>{ARTICLE * 2}</div>{login}</body>") == f"{ARTICLE_TEXT}\n{ARTICLE_TEXT}"
    assert main_text("<body><form><p>Search, here.</p></form></body>") == ""
    assert main_text("<div><p>Use <button>Save</button> or <label>Cancel</label> now, please.</p><button>Share</button></div>") == "Use Save or Cancel now, please."


def test_deep_nesting_is_linear():
    import time

    for tag in ("blockquote", "div", "form", "span"):
        started = time.perf_counter()
        main_text(f"<{tag}>words, and more " * 4000 + f"</{tag}>" * 4000)
        assert time.perf_counter() - started < 3


def test_points_equal_a_plain_count():
    rng = random.Random(5)

    def made(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["some, words here ", " ", "a long run of text, with commas, and more of it " * 3, "x"])
        tag = rng.choice(["div", "p", "blockquote", "section", "ul", "li", "a", "span", "td", "pre", "script", "article"])
        return f"<{tag}>" + "".join(made(depth - 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"

    def inside(node, links):
        """All text of a node, or what stands in links, without dropped elements."""
        out = ""
        for x in node.children:
            if isinstance(x, str):
                out += x if links in (None, True) else ""
            elif x.tag not in M.DROPPED:
                out += inside(x, None if links is None else links or x.tag == "a")
        return out

    def lengths(node, links):
        total = linked = 0
        for x in node.children:
            if isinstance(x, str):
                total, linked = total + len(x.strip()), linked + (len(x.strip()) if links else 0)
            elif x.tag not in M.DROPPED:
                t, n = lengths(x, links or x.tag == "a")
                total, linked = total + t, linked + n
        return total, linked

    def plain(root):
        points = {}

        def visit(node, path):
            own = "".join(x for x in node.children if isinstance(x, str)).strip()
            is_paragraph = node.tag in M.PARAGRAPH
            if is_paragraph or node.tag in ("div", "section", "article", "main") and own:
                text = (inside(node, None) if is_paragraph else own).strip()
                total, linked = lengths(node, node.tag == "a" or any(n.tag == "a" for n in path))
                if text:
                    value = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - (linked / total if total else 0.0))
                    chain = ([] if is_paragraph else [node]) + path[::-1]
                    for share, above in zip((1, 2, 6, 9, 12), chain):
                        points[id(above)] = points.get(id(above), 0.0) + value / share
            for x in node.children:
                if isinstance(x, M.Node) and x.tag not in M.DROPPED:
                    visit(x, [*path, node])

        visit(root, [])
        return points

    for _ in range(150):
        root = M.parse("<html>" + "".join(made(5) for _ in range(4)) + "</html>")
        nodes = M._measure(root)
        M._score(nodes)
        want = plain(root)
        assert all(abs(n.points - want.get(id(n), 0.0)) < 1e-9 for n in nodes)
