"""Main text of web pages by wrappers: union-free expressions inferred from the pages of a host.

A page is a tree of block elements with text slots.  Runs of like siblings are
folded into repeated groups.  Trees of one host are aligned, one after the
other: elements that both have are merged, what only one has becomes optional,
and a lone element beside a repeated one joins the group.  The wrapper also
counts the text and link text in each element over the host's pages; from names
and counts it is decided where the article lies and what in it is not article.
Pages are then read by their host's decision.  Where a page has no article or
main element to go by, strings that stay the same in a slot on most of the
host's pages are template, as in the expression, and not article.

Wrappers are merged within each task first, then by host in two steps, so a
host with a third of all pages sends few small wrappers, not its pages.
"""

from __future__ import annotations

import html
import json
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, prepare, small

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|xmp|iframe|noframes|svg|math|select|object|canvas|audio|video)\b(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>"
    r"|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option "
    "p pre search section summary table tbody td template tfoot th thead tr ul button label".split()
)
#: Elements that are never part of an article.
_NEVER = frozenset("nav footer aside form head noscript template dialog menu search button label fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbox adslot banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu breadcrumb breadcrumbs footer header masthead topbar toolbar sidebar "
    "rail cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus discussion share sharing social "
    "related recommended recommendations more-stories widget widgets pagination pager skip-link paywall disclaimer".split()
)
_ROOT = re.compile(r"(?:^|[-_])(?:article|post|entry|story|content)(?:[-_]?(?:body|text|content|main))?$|^main$")
#: Blocks below this depth stand in their ancestor there, still apart from each other; what is never article is left out at any depth.
_DEEPEST = 200
#: Bits of the table by which sequences of siblings are aligned; longer sequences are halved first.
_TABLE = 1 << 28
#: A string is template if its slot holds it on so many of a host's different pages, and on this share of them.
SAME_PAGES, SAME_SHARE = 3, 0.5


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


_names: dict[tuple[str, str], tuple[str, bool]] = {}


def _name(tag: str, attrs: str) -> tuple[str, bool]:
    """An element's name (tag, id, classes; digits alike) and whether it is never article."""
    got = _names.get((tag, attrs))
    if got is None:
        kept, drop = [], tag in _NEVER
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden":
                drop |= value not in ("false",) and not (key == "aria-hidden" and value != "true")
                continue
            words = re.sub(r"[0-9]+", "0", value).split()
            if key == "role":
                drop |= any(w in _ROLES for w in words)
                kept += ["@" + w for w in words]
                continue
            for w in words:
                parts = re.split(r"[-_]+", w)
                drop |= w in _JUNK or parts[0] in _JUNK or parts[-1] in _JUNK
            kept += [("#" if key == "id" else ".") + w for w in words]
        if tag in ("article", "main", "body", "html"):
            drop = False
        got = (tag + "".join(sorted(kept)), drop)
        if len(_names) < 100_000:
            _names[(tag, attrs)] = got
    return got


class Element:
    __slots__ = ("name", "drop", "parts", "block", "tag")

    def __init__(self, tag: str, name: str, drop: bool, block: bool):
        self.tag, self.name, self.drop, self.block = tag, name, drop, block
        self.parts: list = []  # elements and strings, in order


#: Tags that a page's article is never in, whatever else the page has.
_ASIDE = frozenset("nav footer aside head noscript template dialog menu search button label".split())
#: In an element's name: it would be dropped for its tag or class, but holds its page's article.
_HOLDS = "@holds-article"


def _rescue(root: Element) -> None:
    """Lists of tags and classes only break ties: where they would leave a page without its article, the element that holds it stays.

    If every article or main element of a page stands in a dropped one, those
    around the longest of them are kept if it has most of the text; so cards of
    other articles beside a page's text don't count.  If there is none, and
    nothing but dropped elements and headings has text, the one with the most is.
    """
    found: list[tuple[int, list[Element]]] = []  # length and dropped ancestors of each article or main
    apart: list[tuple[int, list[Element]]] = []  # of each outermost dropped element
    free = 0  # text outside of dropped elements

    def length(e: Element) -> int:
        total, open_ = 0, [e]
        while open_:
            for p in open_.pop().parts:
                if isinstance(p, str):
                    total += len(p.strip())
                else:
                    open_.append(p)
        return total

    open_: list[tuple[Element, list[Element], bool]] = [(root, [], False)]
    while open_:
        e, around, heading = open_.pop()
        for p in e.parts:
            if isinstance(p, str):
                free += 0 if around or heading else len(p.strip())
                continue
            if p.tag in ("article", "main"):
                if not around:
                    return  # lists don't hide this page's article
                if not any(x.tag in _ASIDE for x in around):
                    found.append((length(p), around))
            own = [*around, p] if p.drop else around
            if p.drop and not around and p.tag not in _ASIDE:
                apart.append((length(p), own))
            open_.append((p, own, heading or p.tag in ("header", "h1", "h2", "h3", "h4", "h5", "h6", "title")))
    size, around = max(found or apart, key=lambda x: x[0], default=(0, []))
    if size > 4 * free if found else size and not free:
        for e in around:
            e.drop, e.name = False, e.name + _HOLDS


def parse(page: str | None) -> Element:
    """A forgiving tree of a page; scripts, styles and the like are left out."""
    root = _tree(page)
    _rescue(root)
    return root


def _tree(page: str | None) -> Element:
    root = Element("", "", False, True)
    stack, at, page = [root], 0, page or ""
    below: list[dict[str, int]] = [{}]  # for each of stack the open elements that stand in it, by tag
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            stack[-1].parts.append(page[at : m.start()])
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing, attrs = tag.lower(), m[2] or m[5], m[4] or m[7] or ""
        block = tag in _BLOCK
        if closing:
            if below[-1].get(tag):
                below[-1][tag] -= 1
                if block:
                    stack[-1].parts.append(Element(tag, tag, False, True))
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:], below[k:]
                    break
                if stack[k].block and not block:
                    break  # an inline end tag doesn't close blocks
            continue
        if block:
            shut = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                "th": ("td", "th"), "option": ("option",)}.get(tag, ())
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut or (stack[k].tag == "p" and tag != "label" and tag != "button"):
                    del stack[k:], below[k:]
                    break
                if stack[k].block and stack[k].tag != "p":
                    break
        name, drop = _name(tag, attrs)
        own = Element(tag, name, drop, block)
        stack[-1].parts.append(own)
        if tag in _VOID or attrs.rstrip().endswith("/"):
            continue
        if len(stack) < _DEEPEST or (drop and not stack[-1].drop):
            stack.append(own)
            below.append({})
        else:
            below[-1][tag] = below[-1].get(tag, 0) + 1
    if at < len(page):
        stack[-1].parts.append(page[at:])
    return root


# ---------------------------------------------------------------- wrappers
# A node: [key, children, chars, link chars, pages, repeated, optional]; key "#" is a text slot.


def _skeleton(e: Element, in_link: bool, name: str) -> list:
    chars = links = 0
    kids: list[list] = []

    def walk(x: Element, link: bool) -> None:
        nonlocal chars, links
        for p in x.parts:
            if isinstance(p, str):
                n = len(p) - p.count(" ") - p.count("\n")
                if n:
                    chars += n
                    links += n * link
                    if not kids or kids[-1][0] != "#":
                        kids.append(["#", [], 0, 0, 1, 0, 0])
            elif p.block:
                kids.append(_skeleton(p, link, p.name))
            else:
                walk(p, link or p.tag == "a")

    walk(e, in_link)
    kids = fold(kids)
    return [name, kids, chars + sum(k[2] for k in kids if k[0] != "#"), links + sum(k[3] for k in kids if k[0] != "#"), 1, 0, 0]


def _joined(a: list, b: list, pages: int | None = None) -> list:
    return [a[0], align(a[1], b[1]), a[2] + b[2], a[3] + b[3], a[4] + b[4] if pages is None else pages, a[5] | b[5], a[6] | b[6]]


def fold(kids: list[list]) -> list[list]:
    """Runs of like siblings, and of like groups of two or three, become repeated ones."""
    for size in (1, 2, 3):
        out: list[list] = []
        for k in kids:
            out.append(k)
            while len(out) >= 2 * size and [x[0] for x in out[-size:]] == [x[0] for x in out[-2 * size : -size]]:
                tail = out[-size:]
                del out[-size:]
                for i in range(size):
                    merged = _joined(out[i - size], tail[i], pages=1)
                    merged[5] = 1
                    out[i - size] = merged
        kids = out
    return kids


def _rows(a: list, b: list) -> list[int]:
    """After each element of a: a bit for each element of b, 0 where a longest common subsequence grows there."""
    where: dict = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    mask = row = (1 << len(b)) - 1
    out = []
    for x in a:
        same = row & where.get(x, 0)
        row = ((row + same) | (row - same)) & mask
        out.append(row)
    return out


def common(a: list, b: list) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence of two sequences, by rows of bits; where all rows would be too many, a is halved and b cut where both halves find most."""
    if len(a) * len(b) > _TABLE and len(a) > 1:
        half = len(a) // 2
        grown = lambda row: np.concatenate([[0], np.cumsum(1 - np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8),
            bitorder="little")[: len(b)].astype(np.int64))])
        at = int(np.argmax(grown(_rows(a[:half], b)[-1]) + grown(_rows(a[half:][::-1], b[::-1])[-1])[::-1]))
        return common(a[:half], b[:at]) + [(i + half, j + at) for i, j in common(a[half:], b[at:])]
    rows = _rows(a[::-1], b[::-1])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[-i] == b[-j]:
            out.append((len(a) - i, len(b) - j))
            i, j = i - 1, j - 1
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """Both sequences as one expression: common nodes merged by a longest common subsequence, others optional."""
    keys_a, keys_b = [x[0] for x in a], [x[0] for x in b]
    if keys_a == keys_b:
        return [_joined(x, y) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for x, y in [*common(keys_a, keys_b), (len(a), len(b))]:
        out += [[*n[:6], 1] for n in a[i:x] + b[j:y]]
        if x < len(a):
            out.append(_joined(a[x], b[y]))
        i, j = x + 1, y + 1
    return fold(out)


def skeleton(page: str | None) -> list:
    return _skeleton(parse(page), False, "")


def decide(wrapper: list) -> dict:
    """Where on a host's pages the article lies: root, the path of its element (None: no such element is known)."""
    best: dict[int, tuple[float, str]] = {}

    def walk(node: list, path: str, dropped: bool) -> None:
        for k in node[1]:
            if k[0] == "#":
                continue
            tag = re.match(r"[a-z0-9:-]*", k[0])[0]
            own = path + ">" + k[0]
            drop = dropped or _dropped(k[0])
            if not drop:
                text = k[2] - k[3]
                marks = re.findall(r"[.#]([^.#@]+)", k[0])
                rank = 3 if tag == "article" else 2 if tag == "main" or "@main" in k[0] else 1 if tag in ("div", "section", "td") and any(_ROOT.search(x) for x in marks) else 0
                if rank and text > best.get(rank, (0, ""))[0]:
                    best[rank] = (text, own)
            walk(k, own, drop)

    walk(wrapper, "", False)
    if best:
        return {"root": best[max(best)][1]}
    node, path = wrapper, ""  # no names to go by: down to where most of the text stays
    left_out = lambda k: k[0] == "#" or k[0].startswith("header") or _dropped(k[0])
    while True:
        total = sum(k[2] - k[3] for k in node[1] if not left_out(k))
        heavy = [k for k in node[1] if not left_out(k) and not k[5] and k[2] - k[3] >= 0.7 * max(total, 1)]
        if not heavy or re.match(r"(p|ul|ol|dl|table|h[1-6])\b", heavy[0][0]):
            return {"root": path or None}
        node, path = heavy[0], path + ">" + heavy[0][0]


def _dropped(name: str) -> bool:
    if name.endswith(_HOLDS):
        return False
    tag = re.match(r"[a-z0-9:-]*", name)[0]
    marks = " ".join(re.findall(r"[.#]([^.#@]+)", name))
    roles = " ".join(re.findall(r"@([^.#@]+)", name))
    return _name(tag, f'class="{marks}" role="{roles}"' if marks or roles else "")[1]


def _slot(path: str, text: str) -> int:
    """A string in a slot of the wrapper, as a signed long."""
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass")) - (1 << 63)


def _blocks(e: Element, path: str, article: bool, out: list[tuple[str, str]]) -> None:
    """Adds (path, text) of e's blocks in page order, without what is never article; an article's own headers have its title and stay."""
    held: list[str] = []

    def end(path: str) -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((path, text))

    def walk(e: Element, path: str, article: bool) -> None:
        for p in e.parts:
            if isinstance(p, str):
                held.append(p)
            elif p.tag == "br":
                held.append(" ")
            elif p.drop or (p.tag == "header" and not article):
                end(path)
            elif p.block:
                end(path)
                own = path + ">" + p.name
                walk(p, own, article or p.tag == "article")
                end(own)
            else:
                walk(p, path, article)

    walk(e, path, article)
    end(path)


def slots_of(tree: Element) -> tuple[int, list[int]]:
    """A page's digest (of its longest block, so copies of an article are one page) and the strings in its slots."""
    out: list[tuple[str, str]] = []
    _blocks(tree, "", False, out)
    longest = max((text for _, text in out), key=len, default="")
    return _slot("", longest), sorted({_slot(*x) for x in out})


def text_of(page: str | None, decision: dict | None) -> str:
    """The article's blocks, one a line.  Without the decided element: the page's first article, main or body, or all of it."""
    tree = parse(page)
    roots: list[tuple[Element, str]] = []
    by_tag: dict[str, tuple[Element, str]] = {}
    want = (decision or {}).get("root")
    same = frozenset((decision or {}).get("same") or ())

    def seek(e: Element, path: str, dropped: bool) -> None:
        for p in e.parts:
            if isinstance(p, str):
                continue
            own = path + ">" + p.name if p.block else path
            drop = dropped or p.drop
            if not drop:
                if p.block and own == want:
                    roots.append((p, own))
                    continue
                by_tag.setdefault(p.tag, (p, own))
            seek(p, own, drop)

    seek(tree, "", False)
    if not roots:
        roots = [by_tag.get("article") or by_tag.get("main") or by_tag.get("body") or (tree, "")]
    out: list[tuple[str, str]] = []
    for r, path in roots:
        _blocks(r, path, r.tag == "article", out)
    if same:
        out = [x for x in out if _slot(*x) not in same]
    return "\n".join(text for _, text in out)


# ---------------------------------------------------------------- Spark

_KINDS = "host string, wrapper string"
_PARTS = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("page", pa.int64()), ("slots", pa.list_(pa.int64()))])


def _partial(batches):
    """A wrapper for each host of a task's pages, and the strings in the slots of pages that need them; when many hosts are open, those so far are sent on."""
    open_: dict[str, list] = {}

    def rows(host, wrapper=None, page=None, slots=None):
        n = len(host)
        cols = [host, wrapper or [None] * n, page or [None] * n, slots or [None] * n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _PARTS.types, strict=True)], schema=_PARTS)

    def sent():
        out = rows(list(open_), [json.dumps(w, separators=(",", ":")) for w in open_.values()])
        open_.clear()
        return out

    for b in batches:
        seen = []
        for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            tree = parse(page)
            own = _skeleton(tree, False, "")
            open_[host] = _joined(open_[host], own) if host in open_ else own
            seen.append((host, *slots_of(tree)))
        if seen:
            host, page, slots = (list(x) for x in zip(*seen, strict=True))
            yield rows(host, page=page, slots=slots)
        if len(open_) > 5000:
            yield sent()
    if open_:
        yield sent()


def _merge(key, frame):
    import pandas as pd

    wrapper = None
    for w in sorted(frame["wrapper"]):
        own = json.loads(w)
        wrapper = own if wrapper is None else _joined(wrapper, own)
    return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(wrapper, separators=(",", ":"))]})


def _merged(parts: DataFrame, fan: int = 64) -> DataFrame:
    """Tasks' wrappers -> (host, wrapper) as JSON."""
    some = parts.groupBy("host", F.pmod(F.xxhash64("wrapper"), F.lit(fan)).alias("part")).applyInPandas(_merge, _KINDS)
    return some.groupBy("host").applyInPandas(_merge, _KINDS)


def _parts(pages: DataFrame) -> DataFrame:
    kinds = "host string, wrapper string, page long, slots array<long>"
    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(_partial, kinds)


def infer(pages: DataFrame, fan: int = 64) -> DataFrame:
    """pages (url, html) -> (host, wrapper) as JSON.  A null url belongs to host ''."""
    prepare(pages.sparkSession)
    return _merged(_parts(pages).where("wrapper is not null").select("host", "wrapper"), fan)


def template_strings(slots: DataFrame) -> DataFrame:
    """(host, page, slots) of pages -> (same_host, same): the strings that stay the same in their slot on most of a host's different pages.

    A host has at most 1 / SAME_SHARE times as many as its pages have on average.
    """
    pages = slots.groupBy("host").agg(F.count_distinct("page").alias("pages"))
    each = slots.select("host", "page", F.explode("slots").alias("slot")).distinct().groupBy(F.col("host").alias("h"),
        "slot").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SAME_PAGES)
    often = each.join(pages, F.col("h") == F.col("host")).where(F.col("n") >= SAME_SHARE * F.col("pages"))
    return often.groupBy(F.col("h").alias("same_host")).agg(F.array_sort(F.collect_list("slot")).alias("same"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages (page_id, url, html); a null or empty page, or one without article text, has text ''.

    A page is read alike wherever it stands and however often: rows that repeat
    each have their text, and copies of an article count once in what is
    template.  Very long pages and deep nesting are read whole; other columns
    of pages are left out.
    """
    prepare(pages.sparkSession)
    parts = cut(_parts(pages))

    def decided(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"own_host": b.column(0), "root": [decide(json.loads(w))["root"] for w in b.column(1).to_pylist()]},
                schema=pa.schema([("own_host", pa.string()), ("root", pa.string())]))

    roots = _merged(parts.where("wrapper is not null").select("host", "wrapper")).mapInArrow(decided, "own_host string, root string")
    same = template_strings(parts.where("page is not null").select("host", "page", "slots"))
    decisions = cut(roots.join(same, F.col("own_host") == F.col("same_host"), "left").select("own_host", F.to_json(F.struct("root", "same")).alias("decision")))
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(small(decisions), F.col("host") == F.col("own_host"),
        "left").select("page_id", "url", "html", "decision")
    kind = rows.drop("html", "decision").schema

    def run(batches):
        known: dict[str | None, dict | None] = {}
        for b in batches:
            texts = []
            for page, said in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if said not in known:
                    known[said] = json.loads(said) if said else None
                texts.append(text_of(page, known[said]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, T.StructType([*kind.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
