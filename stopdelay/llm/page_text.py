"""HTML extraction by differencing pages of neighbouring URLs.

Pages are cut into text lines by their block elements, and what stands in menus, footers, forms and the like by its
markup is left out. The lines outside any article are then differenced, on every page: pages of a host stand by URL
path, each is paired with the nearest page of other text whose path it shares most of, their lines are aligned by a longest common
subsequence, and the lines they share are the site's and go. Lines inside an article element are the page's own and
stay whatever its neighbour is.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, sliced, staged, table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*(?:"[^"]*"|'[^']*')|=)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: In a style: comments, quoted strings and brackets, whose semicolons and colons part nothing.
QUOTED = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*"|'[^']*'|\([^()]*\)""", re.S)
#: Elements by what they do to a text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main "
    "ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset("article main".split())
LEFT_OUT = frozenset("aside button canvas datalist dialog footer form head map menu nav noscript object select svg template video audio".split())
#: Words in a class, id or role that mark what isn't the article.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "sidebar complementary nav navbar navigation menu breadcrumb breadcrumbs footer contentinfo masthead comment comments disqus reply replies respond "
    "share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay dialog toolbar pagination pager copyright".split()
)
EXEMPT = frozenset("html body article main h1".split())
#: The marks of reader comments, and blocks of text, as against containers.
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
TEXT_BLOCK = frozenset("p li dt dd tr td th h2 h3 h4 h5 h6 blockquote figcaption".split())
#: Which open elements a start tag ends by itself, each with the elements across which it doesn't.
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main "
    "menu nav ol p pre section summary table ul xmp".split()
)
SCOPE = frozenset("caption table td th object template".split())
APART = BLOCK | LEFT_OUT | {"header"}
IMPLIED = {
    "a": (frozenset(["a"]), APART),
    "li": (frozenset(["li"]), APART - {"address", "div", "p"}),
    **{t: (frozenset(["dd", "dt"]), APART - {"address", "div", "p"}) for t in ("dd", "dt")},
    **{t: (frozenset(["td", "th", "caption"]), frozenset(["tr", "table", "template"])) for t in ("td", "th")},
    "tr": (frozenset(["tr", "caption"]), frozenset(["table", "template"])),
    **{t: (frozenset(["tbody", "thead", "tfoot", "caption"]), frozenset(["table", "template"])) for t in ("tbody", "thead", "tfoot")},
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
}
P = (frozenset(["p"]), SCOPE | {"button"})
#: Across which an end tag ends nothing: of a table's part, of a list's item, of another block, of anything else.
ACROSS = {
    **dict.fromkeys("table caption tbody thead tfoot tr td th".split(), frozenset(["table", "template"])),
    "li": SCOPE | {"ul", "ol"},
    "p": P[1],
    **dict.fromkeys(("html", "body", *MAIN), frozenset()),
}
#: Pages of a part, on average.
PART_PAGES = 4096


def _unseen(style: str) -> bool:
    """Whether a style's declarations hide the element; the last of a name holds, an important one before others."""
    held: dict[str, tuple[bool, str]] = {}
    for declaration in QUOTED.sub(" ", style).lower().split(";"):
        name, _, value = declaration.partition(":")
        important = value.rstrip().endswith("important")
        if important or not held.get(name.strip(), (False,))[0]:
            held[name.strip()] = important, value.split("!")[0].strip()
    return held.get("display", (0, ""))[1] == "none" or held.get("visibility", (0, ""))[1] == "hidden"


def _left_out(tag: str, attributes: str, in_main: bool) -> str:
    """Why an element is left out: by its tag, as comments, or else; "" if it isn't.

    Inside an article a block of text goes only by a class all of whose words are marks: "cookie-notice" is one,
    "share-price" is not.
    """
    if tag in LEFT_OUT or tag == "header" and not in_main:
        return "else" if tag == "form" else "tag"
    if tag in EXEMPT or not attributes:
        return ""
    named: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        named.setdefault(name.lower(), html.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    if "hidden" in named or named.get("aria-hidden", "").strip().lower() == "true" or "style" in named and _unseen(named["style"]):
        return "else"
    for name in ("class", "id", "role"):
        for token in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", named.get(name, "")).lower().split():
            words = set(re.split(r"[^a-z]+", token)) - {""}
            if in_main and tag in TEXT_BLOCK and not words <= MARKED:
                continue
            if words & MARKED or "header" in words and not in_main:
                return "comments" if words & COMMENTS else "else"
    return ""


def page_lines(page: str | None, nested: bool = True) -> tuple[list[str], list[bool]]:
    """The text lines of a page and whether each stands inside an article (or main) element.

    An article in a sidebar or among comments (a teaser, a reader's comment) is left out with it, where the page ends as
    many elements of that name as it begins; else, and in other elements that are left out, it is taken as the page's
    own, behind an element that was never ended. Comments that hold all articles of a page are no comments (nested off).
    """
    lines: list[str] = []
    inside: list[bool] = []
    held: list[str] = []
    page = page or ""
    at, main, skip, why, doubt = 0, 0, 0, "", False
    stack: list[str] = []  # the open elements; from place skip - 1 on they are left out
    count: dict[str, int] = {}
    balance: dict[str, bool] = {}

    def close(tags, across):
        """Ends the innermost open element of these with all in it, but not across some or across an article that counts."""
        nonlocal skip
        if not any(count.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i] in tags:
                for t in stack[i:]:
                    count[t] -= 1
                del stack[i:]
                if skip > i:
                    skip = 0
                return
            if stack[i] in across or across and stack[i] in MAIN and not (skip and i >= skip - 1):
                return

    def ended(tag):
        """Whether the page ends all elements of this name."""
        if tag not in balance:
            begun, ends = (len(re.findall(rf"<{x}{tag}(?![a-z0-9:-])", page, re.I)) for x in ("", "/"))
            balance[tag] = begun <= ends
        return balance[tag]

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                lines.append(text)
                inside.append(main > 0)

    while m := TAG.search(page, at):
        if not skip and m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            left_out = skip
            close((tag,), ACROSS.get(tag, SCOPE if tag in APART else APART))
            if skip or left_out and len(stack) == left_out - 1:
                continue  # it stood in what is left out, or ended just that
            if tag in BLOCK:
                flush()
                if tag in MAIN and main:
                    main -= 1
            continue
        foreign = tag in ("svg", "math") or count.get("svg") or count.get("math")
        alone = tag in VOID or foreign and m[3].endswith("/")
        if tag in RAW and not alone:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ENDS_P:
            close(*P)
        if tag in ("tbody", "thead", "tfoot"):
            close(*IMPLIED["tr"])
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if skip and (tag in MAIN and not main or tag == "body"):
            if tag == "article" and (why == "tag" or why == "comments" and nested) and ended(stack[skip - 1]):
                doubt = doubt or why == "comments"
            else:
                skip = 0  # what was left open ends here
        if not alone:
            stack.append(tag)
            count[tag] = count.get(tag, 0) + 1
        if skip:
            continue
        if tag == "br":
            held.append(" ")
        elif not alone and (why := _left_out(tag, m[3], main > 0)):
            flush()
            skip = len(stack)
        elif tag in BLOCK:
            flush()
            main += tag in MAIN
    if not skip:
        held.append(page[at:])
    flush()
    return page_lines(page, False) if doubt and not any(inside) else (lines, inside)


def shared_lines(a: list[str], b: list[str]) -> list[bool]:
    """Which lines of a are in a longest common subsequence with b.

    Rows of the table are bits of one number, so a row costs a few operations; only lines that both have are aligned,
    less what they begin and end with alike.
    """
    out = [False] * len(a)
    both = set(a) & set(b)
    xs, ys = [i for i, x in enumerate(a) if x in both], [y for y in b if y in both]
    same = next((k for k, (i, y) in enumerate(zip(xs, ys)) if a[i] != y), min(len(xs), len(ys)))
    for i in xs[:same]:
        out[i] = True
    xs, ys = xs[same:], ys[same:]
    while xs and ys and a[xs[-1]] == ys[-1]:
        out[xs.pop()] = True
        ys.pop()
    if not xs or not ys:
        return out
    where: dict[str, int] = {}
    for j, y in enumerate(ys):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(ys)) - 1
    rows, row = [], full  # a bit is 0 where the row's length steps up
    for i in xs:
        rows.append(row)
        hit = row & where.get(a[i], 0)
        row = ((row + hit) | (row - hit)) & full
    rows.append(row)
    j = len(ys)
    for k in range(len(xs) - 1, -1, -1):
        # the last step up at or before j, in the rows with and without this line
        steps = ~rows[k + 1] & ((1 << j) - 1)
        if not steps:
            break
        j = steps.bit_length()
        if rows[k] >> (j - 1) & 1:  # without this line there is no step here: the line makes it
            out[xs[k]] = True
            j -= 1
    return out


def _common(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a.split("/"), b.split("/")):
        if x != y:
            break
        n += 1
    return n


def main_text(lines: list[str], inside: list[bool], neighbours: list[list[str]]) -> str:
    """The page's own lines, in page order: those inside an article and the open ones that no neighbour shares.

    neighbours: the open lines of the pages of other text to difference with, nearest first. A page without lines of an
    article would be empty where a neighbour has all its lines, so the next one is taken; without any the lines stay.
    """
    at = [i for i, own in enumerate(inside) if not own]
    open_lines = [lines[i] for i in at]
    for other in neighbours:
        shared = shared_lines(open_lines, other)
        if len(at) < len(lines) or not all(shared):
            gone = {i for i, x in zip(at, shared) if x}
            return "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return "\n".join(lines)


KEY = "host string, path string, page_id long, url string, digest string"
PARSED = f"part long, own boolean, {KEY}, lines array<string>, inside array<boolean>"


def _read(batch) -> list[tuple]:
    """Of each page its key, lines and places; the key's digest tells pages of other text."""
    keys = zip(*[batch.column(c).to_pylist() for c in ("host", "path", "page_id", "url")])
    out = []
    for key, page in zip(keys, batch.column("html").to_pylist()):
        lines, inside = page_lines(page)
        digest = hashlib.blake2b("\n".join([*lines, "".join("01"[x] for x in inside)]).encode(), digest_size=16).hexdigest()
        out.append(((*key, digest), lines, inside))
    return out


def _table(rows, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[x for x, _ in fields])


def _place(key: tuple) -> tuple:
    """A key as Spark orders it: nulls first, texts by code point."""
    host, path, page_id, url, digest = key
    return host, path, page_id is not None, page_id or 0, url is not None, url or "", digest


def _edges(batches):
    """Of keys in order, by part: the first page and the first of other text on its host, the last and the last of other text on its host."""
    part, held = None, None
    for batch in batches:
        rows = []
        for at, *key in zip(*[c.to_pylist() for c in batch.columns]):
            if at != part:
                rows += [(part, k, *x) for k, x in enumerate(held or ()) if x]
                part, held = at, [key, None, key, None]
                continue
            first, other, last, _ = held
            if other is None and key[0] == first[0] and key[4] != first[4]:
                held[1] = key
            if key[0] != last[0]:
                held[3] = None
            elif key[4] != last[4]:
                held[3] = last
            held[2] = key
        if rows:
            yield _table(rows, f"part long, kind long, {KEY}")
    if held:
        yield _table([(part, k, *x) for k, x in enumerate(held) if x], f"part long, kind long, {KEY}")


def _carried(edges: list[tuple]) -> dict[tuple, list[int]]:
    """Which pages other parts need: the nearest of other text before a part's first page and behind its last one. edges: rows of _edges."""
    parts: dict[int, list] = {}
    for part, kind, *key in edges:
        parts.setdefault(part, [None] * 4)[kind] = tuple(key)
    out: dict[tuple, list[int]] = {}
    for order, (mine, near, far, end) in ((sorted(parts), (0, 2, 3, 0)), (sorted(parts, reverse=True), (2, 0, 1, 2))):
        need = None
        for before, part in zip([None, *order], order):
            key = parts[part][mine]
            side = parts[before] if before is not None else None
            if side is None or side[near][0] != key[0]:
                need = None
            elif side[near][4] != key[4]:
                need = side[near]
            elif side[far]:
                need = side[far]
            elif side[end][0] != key[0]:
                need = None  # else the whole part is copies of this page, and what it needs is needed here
            if need:
                out.setdefault(need, []).append(part)
    return out


def _difference(batches):
    """Pages in order, a run of copies at a time: it is done when the page behind it is known. The run's lines and those of two pages are held."""
    before, run = None, []
    rows: list[tuple] = []

    def open_lines(page):
        return [x for x, own in zip(page[7], page[8]) if not own]

    def done(after):
        sides = [x for x in (before, after) if x is not None]
        texts: dict[tuple, str] = {}
        for own, path, page_id, url in run[1:]:
            if own:
                order = tuple(sorted(range(len(sides)), key=lambda k: (-_common(path, sides[k][3]), k)))
                if order not in texts:
                    texts[order] = main_text(run[0][7], run[0][8], [open_lines(sides[k]) for k in order])
                rows.append((page_id, url, texts[order], len(texts[order])))
                if len(rows) == 128:
                    yield _table(rows, TEXT)
                    rows.clear()

    for batch in sliced(batches):
        for page in zip(*[c.to_pylist() for c in batch.columns]):
            together = run and (run[0][0], run[0][2]) == (page[0], page[2])
            if not together or run[0][6] != page[6]:
                if run:
                    yield from done(page if together else None)
                before, run = run[0][:3] + run[-1][1:2] + run[0][4:] if together else None, [page]
            run.append((page[1], *page[3:6]))
    if run:
        yield from done(None)
    if rows:
        yield _table(rows, TEXT)


TEXT = "page_id long, url string, text string, n_chars long"


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of pages(page_id, url, html).

    White space in a line, however coded, is one space; lines stand in page order, one to a row of text; a page without
    text has "". Null html is an empty page; a page without a URL belongs to the host "". Repeated rows are pages of
    their own. Pages of a host stand by path, then id, then URL; each has on either side the nearest page of other text to
    be differenced with, across any number of copies. Other columns are not read.

    Pages are dealt by ranges of that order into parts. A first reading keeps keys only; from the keys at the edges of the
    parts follows which pages (two a part at most) a second reading sends to another part as well.
    """
    spark = pages.sparkSession
    url = F.coalesce("url", F.lit(""))
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    p = pages.select(host.alias("host"), path.alias("path"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    order = [x.split()[0] for x in KEY.split(", ")]

    def first_reading(batches):
        for batch in sliced(batches):
            yield _table([x for x, _, _ in _read(batch)], KEY)

    keys = staged(p.mapInArrow(first_reading, KEY))
    n = keys.count()
    parts = max(12, -(-n // PART_PAGES))
    some = sorted(_place(tuple(r)) for r in keys.sample(min(1.0, 20 * parts / max(n, 1)), seed=1).collect())
    bounds = sorted({some[len(some) * k // parts] for k in range(1, parts)}) if some else []
    shared = spark.sparkContext.broadcast(bounds)

    def deal(batches):
        for batch in batches:
            rows = list(zip(*[c.to_pylist() for c in batch.columns]))
            yield _table([(bisect_right(shared.value, _place(x)), *x) for x in rows], f"part long, {KEY}")

    def by_part(df):
        return df.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", *order)

    edges = by_part(keys.mapInArrow(deal, f"part long, {KEY}")).mapInArrow(_edges, f"part long, kind long, {KEY}")
    carried = spark.sparkContext.broadcast(_carried([tuple(r) for r in edges.collect()]))  # four rows a part at most
    discard(keys)

    def second_reading(batches):
        for batch in sliced(batches):
            rows = []
            for key, lines, inside in _read(batch):
                rows.append((bisect_right(shared.value, _place(key)), True, *key, lines, inside))
                rows += [(part, False, *key, lines, inside) for part in carried.value.get(key, ())]
            yield _table(rows, PARSED)

    return by_part(p.mapInArrow(second_reading, PARSED)).mapInArrow(_difference, TEXT)


def op2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
