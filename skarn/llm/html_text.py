"""Main text of web pages: page differencing between nearest URLs, guided by the page's structure.

A page is cut into lines (blocks of text, in page order). Pages are sorted by host and URL path; of
its two neighbours on the host, the page whose path has the longer common beginning is the nearest
(ties: the one before). The two pages' lines are aligned by a longest common subsequence, and the
lines of the alignment are what the site repeats: they go.

Alone that gives wrong texts: pages that copy an article would lose it, and menus, adverts and
footers that differ on every page would stay. So the structure has the first word where it has one.
Lines inside the article (``article``, ``main``, ``role=main``) stay; lines of furniture (menus,
headers, footers, sidebars, notices, adverts, forms, reader comments, by element or by class, id and
role) go, and, on a page with an article, all lines outside it. Every other line is decided by the
alignment. A page all of whose undecided lines are shared is a copy of its neighbour and keeps them.

The sort is a range partitioning of narrow rows (a hash per line), so a host of any size is spread
over tasks; each range gets the edge rows of its neighbours. Pages are matched with their shared
lines by id, URL and a hash of the html, and cross that shuffle packed by zstandard.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from skarn.llm.common import by_slices, slices, table, written

#: Fixed values of HTML: elements without an end, elements whose content is no markup, and blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a start tag ends although they have no end tag, and the elements beyond which it does not look for them.
ENDS_P = BLOCK - set("body caption head html legend optgroup option select tbody td tfoot th thead tr".split())
_ROWS = "tbody thead tfoot"
IMPLIED = {
    **{name: (set(ends.split()), set(within.split())) for names, ends, within in (
        ("li", "li", "ul ol menu table td th"), ("dt dd", "dt dd", "dl table td th"), ("td th", "td th", "tr table"), ("tr", "tr", f"{_ROWS} table"),
        (_ROWS, _ROWS, "table"), ("option optgroup", "option", "select optgroup"),
    ) for name in names.split()},
}
#: An end tag of a block looks for its start up to these; one of another element up to any block.
SCOPE = set("html table td th caption template".split())
TABLE = {"table"}
IN_TABLE = set("table caption thead tbody tfoot tr td th".split())
#: Elements that class, id and role never make furniture: they hold or name what the page is about.
UNMARKED = set("html body main article h1".split())
HEADINGS = set("h2 h3 h4 h5 h6".split())
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
#: Furniture by element, and by a word of class, id or role.
FURNITURE = set("nav header footer aside form dialog menu search noscript template svg canvas object audio video button select head".split())
NAMES = set(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer "
    "header menu modal nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor "
    "sponsored subscribe toolbar complementary contentinfo search".split()
)
MAIN = set("article main".split())

_NAME = re.compile(r"</?[a-zA-Z][^\s/>]*")
_SIGNS = re.compile("[\"'>]")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Marks of a line.
ARTICLE, OPEN, DROPPED = 0, 1, 2


def _marks(name: str, rest: str) -> tuple[bool, bool]:
    """Whether an element is furniture, and whether it is the main part."""
    furniture, main = name in FURNITURE, name in MAIN
    if rest:
        for key, value in _NAMED.findall(rest):
            value = value.strip("\"'").lower()
            if name not in UNMARKED:
                words = NAMES.intersection(re.split(r"[^a-z0-9]+", value))
                furniture |= bool(words - {"header"} if name in HEADINGS else words)
            main |= key.lower() == "role" and value == "main"
    return furniture, main and not furniture


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of all quotes and ``>``, and for each the ``>`` that ends a tag read on from there (-1: none).

    A quote leads to the sign after the next one of its kind. All are found by one walk from the end, so
    a tag that never ends costs nothing but itself, however many there are.
    """
    signs = [m.start() for m in _SIGNS.finditer(page)]
    ends = [-1] * (len(signs) + 1)
    later = {'"': len(signs), "'": len(signs)}
    for k in range(len(signs) - 1, -1, -1):
        sign = page[signs[k]]
        if sign == ">":
            ends[k] = signs[k]
        else:
            after = later[sign]
            ends[k] = ends[after + 1] if after < len(signs) else -1
            later[sign] = k
    return signs, ends


def tag_finder(page: str):
    """Function from a place to the next tag: (start, end, closing, name, rest) or None; places must not fall.

    Comments and declarations have no name.
    """
    signs, ends = _tag_ends(page)
    last = page.rfind(">")
    named = name_end = 0

    def after(at: int) -> tuple[int, int, bool, str | None, str] | None:
        nonlocal named, name_end
        while (start := page.find("<", at)) >= 0:
            at = start + 1
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, False, None, ""
            if page[at : at + 1] in ("!", "?") and at < len(page):
                end = page.find(">", start) if start < last else -1
                if end < 0:
                    continue
                return start, end + 1, False, None, ""
            if not named <= start < name_end:  # a name that runs over further "<" is read once
                if not (found := _NAME.match(page, start)):
                    continue
                named, name_end = start, found.end()
            elif not _NAME.match(page, start, start + 3):
                continue
            end = ends[bisect_left(signs, name_end)]
            if end >= 0:
                closing = page[at] == "/"
                return start, end + 1, closing, page[at + closing : name_end], page[name_end:end]
        return None

    return after


def lines(page: str | None) -> list[tuple[str, int]]:
    """The page's lines with their marks."""
    page = page or ""
    out: list[tuple[str, int]] = []
    part: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # open elements: name, furniture, main
    opened: Counter[str] = Counter()  # by name, so that a search of the stack is made only if it can find something
    furniture = main = 0
    article_seen = False
    at = 0

    def end_line() -> None:
        if part:
            line = " ".join("".join(part).split())
            part.clear()
            if line:
                out.append((line, DROPPED if furniture else ARTICLE if main else OPEN))

    def close(names: set[str], within: set[str]) -> None:
        """End the innermost open element of these names, and all in it, unless it lies beyond one of ``within``."""
        nonlocal furniture, main
        if not any(opened[n] for n in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                break
            if stack[k][0] in within:
                return
        if any(f or m for _, f, m in stack[k:]):
            end_line()
        for name, f, m in stack[k:]:
            opened[name] -= 1
            furniture -= f
            main -= m
        del stack[k:]

    def add(text: str) -> None:
        if text:
            part.append(entities.unescape(text) if "&" in text else text)

    last, after = page.rfind(">") + 1, tag_finder(page)
    while found := after(at):
        start, end, closing, name, rest = found
        add(page[at:start])
        at = end
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name in BLOCK:
                end_line()
            close({name}, TABLE if name in IN_TABLE else SCOPE if name in BLOCK or name in FURNITURE else BLOCK)
            continue
        if name == "br":
            part.append(" ")
            continue
        if name in BLOCK:
            end_line()
        if opened["head"] and name not in IN_HEAD:
            close({"head"}, set())
        if opened["p"] and name in ENDS_P:
            close({"p"}, SCOPE)
        if name in IMPLIED:
            close(*IMPLIED[name])
        if name in RAW:
            found = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at, max(at, last))
            at = found.end() if found else len(page)
            continue
        if name in VOID or rest.endswith("/") and name not in BLOCK:
            continue
        f, m = _marks(name, rest)
        if f or m:
            end_line()
        stack.append((name, f, m))
        opened[name] += 1
        furniture += f
        main += m
        article_seen |= m
    add(page[at:])
    end_line()
    if article_seen:
        out = [(text, DROPPED if mark == OPEN else mark) for text, mark in out]
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequence of ``a`` and each beginning of ``b``, by bits of one long number."""
    where: dict[int, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        m = where.get(x, 0)
        u = v & m
        v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(-(-len(b) // 8) or 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of one longest common subsequence; memory grows with the longer list only."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not mid_a or not mid_b:
        inner = []
    elif len(mid_a) == 1:
        inner = [0] if mid_a[0] in mid_b else []
    else:
        half = len(mid_a) // 2
        score = _lengths(mid_a[:half], mid_b) + _lengths(mid_a[half:][::-1], mid_b[::-1])[::-1]
        cut = int(score.argmax())
        inner = common(mid_a[:half], mid_b[:cut]) + [half + i for i in common(mid_a[half:], mid_b[cut:])] if score[cut] else []
    return [*range(head), *(head + i for i in inner), *range(len(a) - tail, len(a))]


def _same_start(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _hashes(pages: pa.Array) -> pa.Array:
    import xxhash

    found = [[xxhash.xxh3_64_intdigest(text.encode()) >> 1 for text, _ in lines(p)] for p in pages.to_pylist()]
    return pa.array(found, pa.list_(pa.int64()))


def _pressed(pages: pa.Array) -> pa.Array:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    return pa.array([press.compress((p or "").encode()) for p in pages.to_pylist()], pa.binary())


def _kept(packed: pa.Array, shared: pa.Array) -> pa.Array:
    import zstandard

    press = zstandard.ZstdDecompressor()
    texts, counts = [], []
    for blob, places in zip(packed.to_pylist(), shared.to_pylist()):
        found = lines(press.decompress(blob).decode())
        repeated = set(places or ())
        undecided = [k for k, (_, mark) in enumerate(found) if mark == OPEN]
        if undecided and repeated.issuperset(undecided):
            repeated = set()
        texts.append("\n\n".join(x for k, (x, mark) in enumerate(found) if mark == ARTICLE or mark == OPEN and k not in repeated))
        counts.append(len(repeated))
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["text", "n_shared"])


#: Pages that a worker holds as Python objects at a time.
ROWS = 128


@F.arrow_udf(ArrayType(LongType()))
def _line_hashes(pages: pa.Array) -> pa.Array:
    return by_slices(_hashes, pages, rows=ROWS)


@F.arrow_udf(BinaryType())
def _pack(pages: pa.Array) -> pa.Array:
    return by_slices(_pressed, pages, rows=ROWS)


@F.arrow_udf(StructType().add("text", "string").add("n_shared", "long"))
def _text(packed: pa.Array, shared: pa.Array) -> pa.Array:
    return by_slices(_kept, packed, shared, rows=ROWS)


KEYS = ("page_id", "url", "h")


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before = TaskContext.get().partitionId(), 0
    for b in batches:
        places = pa.array(np.arange(before, before + len(b)), pa.int64())
        before += len(b)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(b), part, np.int32)), places], [*b.schema.names, "part", "pos"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of part and place -> each row's lines that its nearest neighbour has as well."""

    def nearest(before, row, after):
        near = [x for x in (before, after) if x is not None and x["part"] == row["part"] and x["host"] == row["host"]]
        return max(near, key=lambda x: _same_start(x["path"], row["path"]), default=None)

    def found(before, row, after):
        other = nearest(before, row, after)
        shared = common(row["lines"], other["lines"]) if other else []
        return {"page_id": row["page_id"], "url": row["url"], "h": row["h"], "shared": shared}

    before = row = None
    schema = None
    for b in slices(batches):
        schema = pa.schema([*(b.schema.field(k) for k in KEYS), pa.field("shared", pa.list_(pa.int32()))])
        out = []
        for after in b.to_pylist():
            if row is not None and not row["guest"]:
                out.append(found(before, row, after))
            before, row = row, after
        yield pa.RecordBatch.from_pylist(out, schema)
    if row is not None and not row["guest"]:
        yield pa.RecordBatch.from_pylist([found(before, row, None)], schema)


def shared_lines(pages: DataFrame) -> DataFrame:
    """``page_id, url, h, shared``: for every different page, the places of lines its nearest page has."""
    after = F.substring_index(F.regexp_extract("url", r"(?s)://(.*)", 1), "#", 1)
    address = F.substring_index(after, "?", 1)
    host, path = F.lower(F.substring_index(address, "/", 1)), F.regexp_extract(address, r"(?s)^[^/]*(.*)", 1)
    blank = F.lit("")
    rows = pages.select("page_id", "url", F.xxhash64("html").alias("h"), F.coalesce(host, blank).alias("host"), F.coalesce(path, blank).alias("path"), _line_hashes("html").alias("lines"))
    order = ["host", "path", "page_id", "url", "h"]
    spread = rows.dropDuplicates(KEYS).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema)
    spread = written(spread.mapInArrow(_sorted, f"{schema}, part int, pos long"), "ordered")

    # The last row of the part before and the first of the part after, as guests; a row per part.
    row = F.struct(*order, "lines")
    edges = spread.groupBy("part").agg(F.min_by(row, "pos").alias("first"), F.max_by(row, "pos").alias("last"))
    near = Window.orderBy("part")
    edges = edges.select("part", F.lag("last").over(near).alias("b"), F.lead("first").over(near).alias("a"))
    names = [*order, "lines"]
    guests = edges.select("part", F.lit(-1).cast("long").alias("pos"), "b.*").where("host IS NOT NULL").unionByName(
        edges.select("part", F.lit((1 << 62)).cast("long").alias("pos"), "a.*").where("host IS NOT NULL")
    )
    columns = [*names, "part", "pos"]
    both = spread.select(*columns, F.lit(False).alias("guest")).union(guests.select(*columns, F.lit(True).alias("guest")))
    both = both.repartition("part").sortWithinPartitions("part", "pos")
    types = {f.name: f.dataType.simpleString() for f in spread.schema}
    return both.mapInArrow(_aligned, f"page_id {types['page_id']}, url string, h long, shared array<int>")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_shared`` for every row; lines are joined by two line ends.

    A null or empty page has an empty text; a null URL has the empty host. Repeated rows are one
    page for the pairing and give repeated results. Other columns are not read.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    shared = written(shared_lines(pages), "shared")
    shared = shared.select(*(F.col(k).alias(f"_{k}") for k in KEYS), "shared")
    packed = pages.select("page_id", "url", F.xxhash64("html").alias("h"), _pack("html").alias("packed"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    # A merge join at every size: the functions on either side of it run in different stages.
    found = packed.join(shared.hint("merge"), same[0] & same[1] & same[2], "left")
    return found.select("page_id", "url", _text("packed", "shared").alias("t")).select("page_id", "url", "t.*")


def op1_html_extraction(spark, folder: str) -> DataFrame:
    found = extract(table(spark, folder, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared")
