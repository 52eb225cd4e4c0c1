import random

import pytest

from tessera.llm import html_extract as X

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head>
<body class="page"><header id="top">Site name</header><nav><ul><li><a href="/">Home {i}</a></ul></nav>
<div class="cookie-notice">We use cookies</div><aside>Side {i}</aside>
<div id="content"><h1>Title {i}</h1><p>First &amp; {i} <b>bold</b>text<p>Second&nbsp;line
  goes   on<br>here {i}<ul><li>one {i}<li>two {i}</ul><div class="promo">Buy {i}</div><p>Always the same words</p>
<table><tr><td>c1 {i}<td>c2 {i}</table><form><label>Name</label><input></form></div>
<section class="comments"><p>Nice {i}</p></section><footer>&copy; {i}</footer></body></html>"""


def want(i):
    return "\n".join([f"Title {i}", f"First & {i} boldtext", f"Second line goes on here {i}", f"one {i}", f"two {i}", f"c1 {i}", f"c2 {i}"])


def test_wrapper_drops_template_and_keeps_slots(spark, empty):
    rows = [(i, "http://h.org/", PAGE.format(i=i)) for i in range(30)]
    rows += [(100, "http://h.org/x", None), (101, None, ""), (102, "http://other.org/", "just text & more"), (103, "http://h.org/c", PAGE.format(i=7)[:700])]
    rows += [(None, "http://h.org/", PAGE.format(i=5)), (3, "http://h.org/", PAGE.format(i=3))]
    got = X.extract(spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r.n_chars == len(r.text)
        by.setdefault(r.page_id, []).append(r.text)
    assert all(by[i] == [want(i)] * (2 if i == 3 else 1) for i in range(30))
    assert by[100] == [""] and by[101] == [""] and by[102] == ["just text & more"] and by[None] == [want(5)]
    assert by[103][0].startswith("Title 7\nFirst & 7 boldtext")
    assert X.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def alone(html):
    return X.main_text(html, X.induce([html]))


def test_article_is_preferred_and_copies_are_not_template():
    page = "<body><nav>menu</nav><article><header><h1>Head</h1></header><p>Same story.</p></article><article class='comment'>me too</article></body>"
    assert X.main_text(page, X.induce([page] * 5)) == "Head\nSame story."
    assert alone("<p>a<p>b</p>c") == "a\nb\nc"
    assert alone("<div><p>a <i>b</i></div>tail <") == "a b\ntail <"


def random_tree(rng, depth):
    part = X.Part(rng.choice("abc"))
    part.children = [random_tree(rng, depth - 1) for _ in range(rng.randrange(4) if depth else 0)]
    return part


def brute_match(a, b):
    if a.sign != b.sign:
        return 0

    def line(x, y):
        if not x or not y:
            return 0
        return max(line(x[1:], y), line(x, y[1:]), brute_match(x[0], y[0]) + line(x[1:], y[1:]))
    return 1 + line(a.children, b.children)


def test_simple_tree_matching_is_the_best_alignment():
    rng = random.Random(4)
    for _ in range(150):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        a.sign = b.sign = "r"
        pairs = []
        assert X.match(a, b, pairs) == brute_match(a, b) == len(pairs)


def test_folded_wrappers_hold_all_trees_in_order():
    """Every tree has a place for each of its nodes in the fold of all, parents above children, siblings in order."""
    rng = random.Random(8)
    for _ in range(40):
        trees = [random_tree(rng, 3) for _ in range(rng.randrange(1, 6))]
        for t in trees:
            t.sign = "r"
        listed = [X.flat(t) for t in trees]
        parents, signs, ns, pages = X.fold([(p, s, [1] * len(s), 1) for p, s, _ in listed] * 1)
        assert pages == len(trees) and all(n <= pages for n in ns) and sum(ns) == sum(len(s) for _, s, _ in listed)
        for p, s, _ in listed:
            at = X.slots((parents, signs), p, s, alike=False)
            known = [(i, x) for i, x in enumerate(at) if x >= 0]
            assert all(signs[x] == s[i] for i, x in known) and [x for _, x in known] == sorted(x for _, x in known)
            assert all(at[p[i]] == parents[x] for i, x in known if i)


def test_rare_nodes_leave_a_wrapper():
    trees = [X.flat(X.tree([-1, 0, 0], ["r", "a", f"x{i}"])[0]) for i in range(60)]
    _, signs, _, _ = X.fold([(p, s, n, 1) for p, s, n in trees])
    assert signs == ["r", "a"]


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert alone(deep) == "x"
    X.induce([deep, deep + "<p>y", deep])
    long = "<article>" + "<p>word</p>" * 20000 + "</article>"
    assert X.main_text(long, X.induce([long, long + "<p>z"])).count("word") == 20000
    mixed = "".join(f"<p>text {i}</p><h2>head {i}</h2>" for i in range(400))
    assert X.main_text(f"<div>{mixed}</div>", X.induce([f"<div>{mixed}</div>", f"<div><h2>x</h2>{mixed}<ul><li>y</ul></div>"])).count("\n") == 799


def texts(spark, rows):
    got = X.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def story(i, k=6):
    return "".join(f"<p>Story {i} tells part {j} of its tale</p>" for j in range(k))


def lines(i, k=6):
    return "\n".join(f"Story {i} tells part {j} of its tale" for j in range(k))


def test_copies_and_rare_layouts_are_learned_from_all_pages(spark):
    note = "<div class='x'>Read our notes on this host</div>"
    a = "<body><div id='wrap'>{}" + note + "</div></body>"
    b = "<body><section class='other'><div class='text'>{}</div><div class='say'>A line of the second layout</div></section></body>"
    rows = [(i, "http://h.org/", a.format(story(0))) for i in range(200)]  # copies of one story
    rows += [(1000 + i, "http://h.org/", a.format(story(i))) for i in range(1, 7)]
    rows += [(2000 + i, "http://h.org/", b.format(story(50 + i))) for i in range(4)]  # rare on the host
    got = texts(spark, rows)
    assert all(got[i] == lines(0) for i in range(200))
    assert all(got[1000 + i] == lines(i) for i in range(1, 7))
    assert all(got[2000 + i] == lines(50 + i) for i in range(4))


def test_hosts_with_few_pages(spark):
    page = "<body><div>{}<p>All rights are kept by us</p></div></body>"
    rows = [(n * 10 + i, f"http://h{n}.org/", page.format(story(n * 10 + i))) for n in (1, 2, 3, 4) for i in range(n)]
    rows += [(90 + i, "http://versions.org/", page.format(story(9) + f"<p>edit {i}</p>")) for i in range(5)]
    got = texts(spark, rows)
    assert got[10] == lines(10) + "\nAll rights are kept by us"  # one page shows no template
    assert all(got[n * 10 + i] == lines(n * 10 + i) for n in (2, 3, 4) for i in range(n))
    assert all(got[90 + i] == lines(9) + f"\nedit {i}\nAll rights are kept by us" for i in range(5))  # versions of one story


def test_constant_block_after_a_long_list(spark):
    page = "<body><div>{}<p>This stands on every page</p></div></body>"
    rows = [(i, "http://h.org/", page.format(story(i, 300 + i))) for i in range(12)]
    got = texts(spark, rows)
    assert all(got[i] == lines(i, 300 + i) for i in range(12))
    assert {t for _, t in X.induce([r[2] for r in rows])["template"]} == {"This stands on every page"}


def plain(i):
    """No article and no telltale names; optional blocks before, inside and after the story; the story's own place varies."""
    before = "<div><p>Today on this host</p></div>" if i % 3 else ""
    list_ = f"<ul><li>first {i}<li>second {i}</ul>" if i % 2 else ""
    after = f"<div><div><p>Look at page {i * 7 % 5} too</p></div><p>Printed by machine</p></div>"
    return f"<body>{before}<div><div>Name of the host</div><div>{story(i)}{list_}<p>Copy what you like</p></div></div>{after}</body>"


def test_pages_without_names_and_with_optional_blocks(spark):
    got = texts(spark, [(i, "http://h.org/", plain(i)) for i in range(40)])
    for i in range(40):
        assert got[i] == lines(i) + (f"\nfirst {i}\nsecond {i}" if i % 2 else "")


def test_a_page_inside_a_form_is_not_lost(spark):
    page = "<body><form id='aspnet'><div class='top'>Name of the host</div><div class='main'>{}</div><div class='menu'><a href='/'>Home</a></div></form></body>"
    got = texts(spark, [(i, "http://h.org/", page.format(story(i))) for i in range(9)] + [(99, "http://one.org/", page.format(story(99)))])
    assert all(got[i] == lines(i) for i in range(9))
    assert got[99] == lines(99)
    # beside an article or other text a form is furniture
    assert alone("<body><article><p>short</p></article><form><p>" + "long " * 200 + "</p></form></body>") == "short"
    assert alone("<body><div><p>the story is told here</p></div><form><p>your name please</p></form></body>") == "the story is told here"


@pytest.mark.parametrize("fold,small", [(2, 32 << 20), (3, 0), (1000, 0)])
def test_groups_of_trees_fold_to_the_same_texts(spark, monkeypatch, fold, small):
    monkeypatch.setattr(X, "FOLD", fold)
    monkeypatch.setattr(X, "SMALL", small)
    rows = [(i, f"http://h{i % 2}.org/", plain(i)) for i in range(30)]
    rows += [(100 + i, "http://h0.org/", f"<body><section><h2>Other {i}</h2><div>{story(i, 3 + i % 4)}<p>Same line</p></div></section></body>") for i in range(9)]
    got = texts(spark, rows)
    by = {}
    for i, url, html in rows:  # the same on the driver, layout by layout
        parsed = X.page_parts(X.parse(html))
        by.setdefault((url, X.layout_of(*parsed)[0]), []).append((i, html))
    for pages in by.values():
        wrapper = X.induce([h for _, h in pages])
        assert {i: X.main_text(h, wrapper) for i, h in pages} == {i: got[i] for i, _ in pages}


def test_the_wrapper_changes_texts(spark):
    rows = [(i, "http://h.org/", plain(i)) for i in range(12)]
    got = texts(spark, rows)
    assert all(got[i] != alone(h) and "Copy what you like" in alone(h) for i, _, h in rows)
