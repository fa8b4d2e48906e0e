import html
import itertools
import random
import re

from stopdelay.llm import page_text as p


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def subsequence(x, y):
    it = iter(y)
    return all(v in it for v in x)


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(2)
    for _ in range(2000):
        a, b = (r.choices("abcdef"[: r.randrange(1, 7)], k=r.randrange(0, 12)) for _ in range(2))
        got = [x for x, s in zip(a, p.shared_lines(a, b)) if s]
        assert len(got) == lcs(a, b) and subsequence(got, b)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class="no-comments">
<!-- <p>no</p> --><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
<div id=sidebar><div>deep</div>side</div><article class=x><header><h1>A  title</h1></header><p>One &amp; two&nbsp;three &lt;b&gt;
four<br>five<p>Unclosed <b>bold <i>x</i><ul><li>item</ul><script>if (a < b) document.write("<p>no</p>")</script>
<form><input name="q">Search</form><table><tr><td>c1<td>c2</table><section class="comments"><p>First!</p></section><aside>also</aside></article>
<div class="adBox ad">Buy</div><footer>&copy; me</footer>"""


def test_structure():
    lines, inside = p.page_lines(PAGE)
    assert [x for x, own in zip(lines, inside) if own] == ["A title", "One & two three <b> four five", "Unclosed bold x", "item", "c1", "c2"]
    assert p.page_lines(None) == p.page_lines("") == ([], [])
    assert p.page_lines("just text") == (["just text"], [False])
    assert p.page_lines("<div class=ad>never closed <p>x<article><p>kept")[0] == ["kept"]
    assert p.page_lines("<p>&amp;amp; &#x41;&#66;</p><p> </p>")[0] == ["&amp; AB"]


def test_hidden_is_an_attribute_or_a_declaration():
    shown = ['style="overflow:hidden"', 'title="a hidden valley"', 'href="/hidden/valley"', 'data-hidden=1', 'style="display:none;display:block"', "title='class=ad'", 'style="background:url(x;display:none)"']
    for x in shown:
        assert p.page_lines(f"<article><p {x}>kept</p></article>") == (["kept"], [True]), x
    for x in ["hidden", "HIDDEN=''", 'hidden="until-found"', 'aria-hidden="true"', 'style="color:red; Display : none !important"', "style=visibility:hidden", 'style="display:none!important;display:block"', "class=ad"]:
        assert p.page_lines(f"<article><p {x}>gone</p><p>kept</p></article>")[0] == ["kept"], x


def test_left_out_elements_end_where_html_ends_them():
    for page, text in [
        ("<article><p class=notice>no<p>a<p>b</article>", "a b"),
        ("<article><p class=notice>no<i>no<ul><li>a</ul>b</article>", "a b"),
        ("<article><ul><li class=share>no<li>a<ul><li class=share>no</ul>b<li>c</ul></article>", "a b c"),
        ("<article><dl><dt class=ad>no<dd>a<dd class=ad>no<dt>b</dl></article>", "a b"),
        ("<article><table><tr class=ad><td>no<table><tr><td>no</table>no<tr><td class=ad>no<td>a<tr><th class=ad>no<th>b<tr class=ad><td>no<tbody><tr><td>c</table>d</article>", "a b c d"),
        ("<article><div><div class=ad>no<div>no</div></div>x</div>a</article>b", "x a b"),
        ("<article><div><span class=ad>no</div>a</article>", "a"),
        ("<article><section><aside>no</section>a</article><p>b", "a b"),
        ("<article><div class=comments><article>no</div>a</article>", "a"),
        ("<article><svg><path/><title/><g/></svg>a<svg/><p>b</article>", "a b"),
        ("<article><div class=ad><p>no</p>no<br>no</span>no</div>a</article>", "a"),
        ("<article><p>a</div><p>b</article>", "a b"),
        ("<article><td class=ad>no</article><p>b", "b"),
        ("<nav><ul><li><a>no<li>no</ul></nav><select><option>no<option>no</select>a", "a"),
    ]:
        assert " ".join(p.page_lines(page)[0]) == text, page
    assert p.page_lines("<article><aside>no</article><p>b") == (["b"], [False])


def test_articles_that_are_not_the_pages_own():
    for page, text in [
        ("<article><p>a</article><section class=comments><article class=comment><p>no</article></section><article>b</article>", "a b"),
        ("<aside><article class=teaser><p>no</article></aside><div>a</div>", "a"),
        ("<footer><div><article>no</article></div></footer><p>a", "a"),
        ("<aside><p>never ended<article><p>a</article>", "a"),
        ("<article>a</article><aside>never ended<article><p>b</article>", "a b"),
        ("<form><p>no<article>a</article></form>", "a"),
        ("<div class='page has-comments'><p>no</p><article>a</article></div>", "a"),
    ]:
        assert " ".join(p.page_lines(page)[0]) == text, page


def test_marks_of_text_blocks():
    kept = ["share-price", "menu-item", "related-work", "x sharePrice"]
    gone = ["share", "x share", "cookie-notice", "adBanner", "share_social"]
    for x in kept + gone:
        assert p.page_lines(f"<article><p class='{x}'>a</p>b</article>")[0] == ["a", "b"][x in gone :], x
    assert p.page_lines("<article><div class='related-posts'>no</div>b</article>")[0] == ["b"]
    assert p.page_lines("<p class='share-price'>no</p>b")[0] == ["b"]


def test_quotes_that_open_no_value():
    for tag in ['<p class="x>', "<p don't>", "<p title=don't>", "<p title='a > b'>", '<p title = "a > b" x>', "<p a==\">", "<p '>"]:
        assert p.page_lines(f"<article>{tag}Hello</p><p>World</p></article>")[0] == ["Hello", "World"], tag


def test_differencing(spark):
    site = lambda i, body: f"<html><body><div>The Site</div>{body}<p>Since 1999 on page {i % 1}</p></body></html>"
    rows = [(i, f"http://H.example/a/{i:03}", site(i, f"<p>own {i}</p><p>more {i}</p>")) for i in range(20)]
    rows += [(100, "http://other.example/x", "<p>alone</p>"), (101, None, None), (102, "http://h.example/a/000", site(0, "<p>own 0</p><p>more 0</p>")), (103, "::bad", "<p>x</p>")]
    df = spark.createDataFrame([(*x, "t", 1) for x in rows], "page_id long, url string, html string, text string, host int")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in p.extract_text(df).collect()}
    assert len(got) == len(rows)
    for i in range(1, 20):
        text = f"own {i}\nmore {i}"
        assert got[i] == (f"http://H.example/a/{i:03}", text, len(text))
    assert got[100][1:] == ("alone", 5) and got[101] == (None, "", 0) and got[103][1] == "x"
    assert got[102][1] == "own 0\nmore 0"  # its nearest neighbour is a copy, which says nothing
    assert p.extract_text(df.limit(0)).count() == 0


def test_open_lines_beside_an_article(spark):
    """Open lines are differenced on pages with an article too: the site's go, a headline or lead of the page stays in its place."""
    page = lambda i: f"<p>The Site</p><h1>Head {i}</h1><article><p>Body {i}</p></article><p>Lead {i}</p><p>Since 1999</p>"
    rows = [(i, f"http://h.example/a/{i}", page(i)) for i in range(3)]
    rows += [(10 + i, f"http://g.example/a/{i}", f"<p>The Site</p><article><p>Body {i}</p></article>") for i in range(2)]
    got = {r.page_id: r.text for r in p.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: f"Head {i}\nBody {i}\nLead {i}" for i in range(3)}, 10: "Body 0", 11: "Body 1"}


def test_neighbours_on_a_large_host(spark):
    """Against all pages in one list: a large host whose sections have menus of their own, with long runs of copies."""
    r, rows = random.Random(3), []
    for i in range(1500):
        k = 700 if 700 <= i < 1100 else i - i % 4 if i % 40 < 4 else i  # runs of 4 copies, and of 400
        rows.append((i, f"http://h.example/s{i // 5:03}/{i:04}", f"<p>Site</p><p>Section {k // 5}</p><p>own {k}</p>" + "<p>more</p>" * (k % 3)))
    rows += [(5000 + i, f"http://g{i % 3}.example/{i}", f"<p>G</p><p>own {i // 6}</p>") for i in range(60)]
    rows += [(None, "http://h.example/s100/0500", "<p>Site</p><p>x</p>"), (5500, "http://h.example/s100/0500", "<p>Site</p><p>y</p>")]
    r.shuffle(rows)
    host, path = lambda x: x[1].split("/")[2], lambda x: "/" + x[1].split("/", 3)[3]
    ordered = sorted(rows, key=lambda x: (host(x), path(x), x[0] is not None, x[0] or 0))
    want = []
    for i, x in enumerate(ordered):
        lines = p.page_lines(x[2])[0]
        sides = []
        for k, others in enumerate((ordered[:i][::-1], ordered[i + 1 :])):
            y = next((y for y in others if host(y) != host(x) or y[2] != x[2]), None)
            if y and host(y) == host(x):
                sides.append((-p._common(path(x), path(y)), k, p.page_lines(y[2])[0]))
        want.append((x[0] or 0, x[1], p.main_text(lines, [False] * len(lines), [y for _, _, y in sorted(sides)])))
    got = [(x.page_id or 0, x.url, x.text) for x in p.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert sorted(got) == sorted(want)
    assert not any("Site" in text for _, u, text in got if "//h." in u)


def test_pages_of_the_table(spark):
    """The articles of the given pages, by a plainer way that their simple markup allows."""
    d = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{d}/pages.parquet").collect()
    got = {r.page_id: r.text for r in p.op2_page_text(spark, d).collect()}
    for r in pages:
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert got[r.page_id] == "\n".join(x for x in blocks if x)


def test_very_long_pages():
    many = "<p>line</p>" * 50_000
    lines, _ = p.page_lines(many)
    assert len(lines) == 50_000
    a, b = [f"x{i}" for i in range(3000)], [f"x{i}" for i in range(0, 6000, 2)]
    assert sum(p.shared_lines(a, b)) == 1500
