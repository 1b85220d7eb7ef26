"""Main text of web pages: element names, and nearest-URL page differencing.

* A page is read as lines, one a block, each with a zone: ``ARTICLE`` inside
  an article or main element, ``CHROME`` inside an element whose name, role or
  class says menu, footer, advert, form, notice, comment and so on, ``OPEN``
  where no element says either.
* Pages of a host are sorted by URL path (pages of equal lines are one); the
  partner of a page is the neighbour with the longest common path prefix that
  is not a near copy of it.  The lines of both pages, of whatever zone, are
  aligned by a longest common subsequence; shared lines are the template.
* Chrome lines are deleted, article lines kept, and open lines deleted where
  the alignment finds them shared.  Article lines are kept although shared,
  because articles of a host repeat passages; see the README for figures.

Only 64-bit line hashes are sorted and paired, never html.  The sort is by
range, so a large host spans many tasks, and pairing works on runs of a fixed
number of pages in that order.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import common as C
from gleaner.llm.common import Stages, session

ARTICLE, CHROME, OPEN = 0, 1, 2
#: Pages in one pairing task group.
RUN = 512
#: Places before and after a page at which a partner is looked for.
REACH = 4
#: A neighbour that shares more than half of the open and article lines of at least this many words is a near copy.
LONG_LINE = 10

# Element, role and class names of page furniture.
_DROPPED = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "video", "audio", "map", "math",
            "head", "title", "select", "textarea", "button", "datalist"}
_RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template", "xmp", "noembed", "noframes"}
_CHROME = {"nav", "footer", "aside", "form", "dialog", "menu", "fieldset", "search"}
_ROLES = {"navigation", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "sponsors", "promo", "promotion",
          "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay",
          "newsletter", "subscribe", "subscription", "signup", "login", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
          "sidebar", "widget", "widgets", "footer", "masthead", "comment", "comments", "reply", "replies", "respond", "disqus", "share",
          "sharing", "social", "related", "recommended", "pagination", "pager", "skip", "paywall", "copyright", "hidden"}
_HEADER_NAMES = {"header", "topbar", "banner"}
_BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
           "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html",
           "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "tfoot",
           "thead", "tr", "ul"}
_CONTAINERS = _BLOCKS - {"p", "li", "dd", "dt", "hr", "option", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "tbody", "thead", "tfoot", "summary", "legend"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "basefont", "bgsound", "frame", "keygen"}
_SPACED = {"br", "td", "th", "img", "wbr", "input"}

_MARK = re.compile(r"<(?:!--|([!?])|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>)|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(>|\Z))")
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")


def _furniture(name: str, attrs: str, in_article: bool) -> bool:
    if name in _CHROME:
        return True
    if name == "header" and not in_article:
        return True
    if not attrs.strip(" /\t\n\r\f"):
        return False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key == "role" and (value in _ROLES or (value == "banner" and not in_article)):
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key in ("class", "id") and name not in ("html", "body", "article", "main"):
            words = set(_SPLIT.split(value))
            if words & _NAMES or (words & _HEADER_NAMES and not in_article):
                return True
        elif key in ("class", "id") and name in ("article",) and set(_SPLIT.split(value)) & {"comment", "comments", "reply", "ad", "advert"}:
            return True
    return False


def page_lines(page: str | None) -> tuple[list[str], list[int]]:
    """The non-empty lines of a page, one a block, and their zones.

    White space inside a block is one space, character references are
    decoded, comments and script-like elements are dropped.  Elements left
    open, stray end tags and a page cut off anywhere are read like a browser
    would, roughly: an end tag closes the nearest open element of its name.
    """
    lines: list[str] = []
    zones: list[int] = []
    if not page:
        return lines, zones
    text: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, furniture, article
    chrome = article = 0
    pos, end = 0, len(page)

    def flush():
        if text:
            line = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append(line)
                zones.append(CHROME if chrome else ARTICLE if article else OPEN)

    def pop():
        nonlocal chrome, article
        _, c, a = stack.pop()
        chrome -= c
        article -= a

    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            text.append(page[pos:])
            break
        if lt > pos:
            text.append(page[pos:lt])
        m = _MARK.match(page, lt)
        if m is None:
            text.append("<")
            pos = lt + 1
            continue
        if m.end() == lt + 4 and page.startswith("<!--", lt):
            if page.startswith("<!-->", lt) or page.startswith("<!--->", lt):
                pos = page.index(">", lt) + 1
            else:
                close = page.find("-->", lt + 4)
                pos = end if close < 0 else close + 3
            continue
        if m.group(1):
            close = page.find(">", lt)
            pos = end if close < 0 else close + 1
            continue
        pos = m.end()
        closing, name, attrs = (m.group(2), m.group(3), m.group(4)) if m.group(3) else (m.group(6), m.group(7), m.group(8))
        name = name.lower()
        block = name in _BLOCKS
        if block:
            flush()
        elif name in _SPACED:
            text.append(" ")
        if closing:
            if name in _VOID:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(c for _, c, _ in stack[k:]) or any(a for _, _, a in stack[k:]):
                        flush()
                    while len(stack) > k:
                        pop()
                    break
                if not block and stack[k][0] in _CONTAINERS:
                    break  # an inline end tag closes nothing outside its block
            continue
        if name in _VOID or (attrs.endswith("/") and name in ("path", "circle", "rect", "use")):
            continue
        if block:  # an open paragraph, list item and so on ends here
            ends = {"p"}
            if name in ("li", "option", "tr"):
                ends = {"p", name}
            elif name in ("dd", "dt"):
                ends = {"p", "dd", "dt"}
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in ends:
                    while len(stack) > k:
                        pop()
                    break
                if stack[k][0] in _CONTAINERS:
                    break
        if name in _RAW:
            close = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.I).search(page, pos)
            pos = end if close is None else close.end()
            text.append(" ")
            continue
        gone = name in _DROPPED or _furniture(name, attrs, article > 0)
        inside = name in ("article", "main") or (name != "body" and 'role="main"' in attrs)
        if name == "body":
            while stack and stack[-1][0] == "head":
                pop()
        if gone or inside:
            flush()
        stack.append((name, gone, inside))
        chrome += gone
        article += inside
    flush()
    return lines, zones


# ------------------------------------------------------------------ alignment
def _rows(a: list[int], b: list[int]) -> list[int]:
    """Bit rows of the LCS table: in row i, a zero at bit j says that column j adds one to the length."""
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v, out = full, [full]
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
        out.append(v)
    return out


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """LCS length of a with each prefix of b."""
    v = _rows(a, b)[-1] if len(a) * len(b) < 1 << 27 else _last_row(a, b)
    bits = np.unpackbits(np.frombuffer(v.to_bytes((len(b) + 7) // 8 or 1, "little"), np.uint8), bitorder="little")[:len(b)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def _last_row(a: list[int], b: list[int]) -> int:
    at: dict[int, int] = {}
    for j, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & at.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v


def common_lines(a: list[int], b: list[int], limit: int = 1 << 28) -> tuple[list[int], list[int]]:
    """Indexes into a and b of one longest common subsequence.

    The table is kept as one bit a cell; beyond ``limit`` bits the problem is
    halved (Hirschberg), so memory stays bounded for pages of any length.
    """
    lo = 0
    while lo < len(a) and lo < len(b) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < len(a) - lo and hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    head = list(range(lo))
    tail_a, tail_b = list(range(len(a) - hi, len(a))), list(range(len(b) - hi, len(b)))
    in_a, in_b = set(a[lo:len(a) - hi]), set(b[lo:len(b) - hi])
    ia = [i for i in range(lo, len(a) - hi) if a[i] in in_b]
    ib = [i for i in range(lo, len(b) - hi) if b[i] in in_a]
    x, y = [a[i] for i in ia], [b[i] for i in ib]
    mid_a: list[int] = []
    mid_b: list[int] = []
    if x and y:
        if len(x) * len(y) > limit and len(x) > 1:
            half = len(x) // 2
            left = _lengths(x[:half], y)
            right = _lengths(x[half:][::-1], y[::-1])[::-1]
            cut = int(np.argmax(left + right))
            for off, (pa_, pb_) in ((0, common_lines(x[:half], y[:cut], limit)), (1, common_lines(x[half:], y[cut:], limit))):
                mid_a += [i + off * half for i in pa_]
                mid_b += [i + off * cut for i in pb_]
        else:
            table, i, j = _rows(x, y), len(x), len(y)
            while i and j:
                if table[i] >> (j - 1) & 1:
                    j -= 1
                elif not table[i - 1] >> (j - 1) & 1:
                    i -= 1
                else:
                    i, j = i - 1, j - 1
                    mid_a.append(i)
                    mid_b.append(j)
            mid_a.reverse()
            mid_b.reverse()
    return head + [ia[i] for i in mid_a] + tail_a, head + [ib[i] for i in mid_b] + tail_b


def template_lines(lines: list[int], long_: list[bool], other: list[int]) -> list[int] | None:
    """Lines that a page shares with a neighbour; None if the neighbour is a near copy of it."""
    mine, _ = common_lines(lines, other)
    weight = sum(long_)
    if len(mine) == len(lines) or (weight and 2 * sum(long_[i] for i in mine) > weight):
        return None
    return mine


# ----------------------------------------------------------------------- url
def url_key(url: str | None) -> tuple[str | None, str]:
    """(host, path order key) of a URL: segments in order, then query; no host where it cannot be read."""
    if not url:
        return None, ""
    try:
        parts = urlsplit(url.strip())
        host = parts.hostname
    except ValueError:
        return None, ""
    if not host:
        return None, ""
    segments = [s for s in parts.path.split("/") if s]
    return host, "/".join(segments) + "?" + parts.query


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


# ---------------------------------------------------------------------- rows
def _parse(batches):
    """mapInArrow body: (page_id, url, html) -> lines, zones, line hashes, host, path and a key of host, lines and zones."""
    for batch in batches:
        cols: dict[str, list] = {c: [] for c in ("k1", "k2", "host", "path", "lines", "zones", "hashes", "long")}
        for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist()):
            lines, zones = page_lines(page)
            host, path = url_key(url)
            hashes = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines]
            key = xxhash.xxh3_128(repr((host, hashes, zones))).intdigest()
            cols["k1"].append((key >> 64) - (1 << 63))
            cols["k2"].append((key & (1 << 64) - 1) - (1 << 63))
            cols["host"].append(host)
            cols["path"].append(path)
            keep = [z != CHROME for z in zones]
            cols["hashes"].append(hashes)
            cols["long"].append([k and x.count(" ") + 1 >= LONG_LINE for x, k in zip(lines, keep)])
            # chrome lines are not needed any more, but keep their place
            cols["lines"].append([x if k else "" for x, k in zip(lines, keep)])
            cols["zones"].append(zones)
        types = {"k1": pa.int64(), "k2": pa.int64(), "host": pa.string(), "path": pa.string(), "lines": pa.list_(pa.string()),
                 "zones": pa.list_(pa.int8()), "hashes": pa.list_(pa.int64()), "long": pa.list_(pa.bool_())}
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], *[pa.array(cols[c], t) for c, t in types.items()]],
                                         names=["page_id", "url", *types])


_PARSED = ("page_id {id}, url string, k1 long, k2 long, host string, path string, lines array<string>, zones array<tinyint>, "
           "hashes array<long>, long array<boolean>")


def _difference(table: pa.Table) -> pa.Table:
    """applyInArrow body: pages of a run in URL order (and ``REACH`` before and after) -> shared open lines of the run's own pages."""
    table = table.sort_by("at")
    hosts, paths, at = table["host"].to_pylist(), table["path"].to_pylist(), table["at"].to_pylist()
    hashes, long_, zones, own = (table[c].to_pylist() for c in ("hashes", "long", "zones", "own"))
    out: dict[str, list] = {"k1": [], "k2": [], "shared": []}
    for i in range(len(at)):
        if not own[i]:
            continue
        near = [j for j in range(max(0, i - REACH), min(len(at), i + REACH + 1))
                if j != i and hosts[j] == hosts[i] and abs(at[j] - at[i]) <= REACH]
        near.sort(key=lambda j: (-common_prefix(paths[i], paths[j]), abs(j - i), j))
        for j in near:
            mine = template_lines(hashes[i], long_[i], hashes[j])
            if mine is None:
                continue
            shared = [x for x in mine if zones[i][x] == OPEN]
            if shared:
                out["k1"].append(table["k1"][i].as_py())
                out["k2"].append(table["k2"][i].as_py())
                out["shared"].append(shared)
            break
    return pa.table({"k1": pa.array(out["k1"], pa.int64()), "k2": pa.array(out["k2"], pa.int64()),
                     "shared": pa.array(out["shared"], pa.list_(pa.int32()))})


def shared_lines(parsed: DataFrame, stages: Stages, run: int = RUN) -> DataFrame:
    """(k1, k2, shared): for pages of ``parsed``, the indexes of open lines that the nearest page of the host shares."""
    same = ["host", "hashes", "long", "zones"]  # equal wherever the key is
    pages = (parsed.where("host is not null and size(hashes) > 0").groupBy("k1", "k2")
             .agg(F.min("path").alias("path"), *[F.first(c).alias(c) for c in same]).withColumn("one", F.lit(1)))
    order = C.running_totals(pages, ["host", "path", "k1", "k2"], ["one"], stages, "order").withColumnRenamed("one_before", "at")
    runs = F.expr(f"transform(sequence(greatest(0, (at - {REACH}) div {run}), (at + {REACH}) div {run}), r -> struct(r as run, r = at div {run} as own))")
    dealt = order.select("*", F.explode(runs).alias("r")).select("host", "path", "k1", "k2", "hashes", "long", "zones", "at", "r.run", "r.own")
    return stages.put("shared", dealt.groupBy("run").applyInArrow(_difference, "k1 long, k2 long, shared array<int>"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by a newline; empty if none), n_chars.

    Null and empty html gives an empty text.  A page without a readable host,
    alone on its host, or with near copies only within reach has no partner:
    all its lines that are not chrome are kept.  Rows of a host with equal
    lines are one page in the alignment; ids may be null or repeat.  Other columns are ignored.
    An empty table gives an empty result.
    """
    stages = Stages(session(pages), "page-text")
    id_type = dict(pages.dtypes)[id_col]
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = stages.put("parsed", rows.mapInArrow(_parse, _PARSED.format(id=id_type)))
    shared = shared_lines(parsed, stages)
    stages.drop("order")
    few = shared.limit(C.BROADCAST_ROWS + 1).count() <= C.BROADCAST_ROWS and (
        (shared.agg(F.sum(F.size("shared"))).first()[0] or 0) <= 4 * C.BROADCAST_ROWS)
    joined = parsed.select("page_id", "url", "k1", "k2", "lines", "zones").join(
        F.broadcast(shared) if few else shared, ["k1", "k2"], "left")
    kept = F.expr(f"filter(lines, (x, i) -> zones[i] <> {CHROME} and not coalesce(array_contains(shared, i), false))")
    text = F.array_join(kept, "\n")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
