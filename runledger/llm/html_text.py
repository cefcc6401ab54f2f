"""Main text of web pages by wrappers inferred for each host.

A page is a stream of tokens: tags of block elements and texts. Its neighbouring elements of one form become
repeated groups. The streams of a host's pages are aligned one after another: what agrees is joined, what only some
pages have becomes optional, texts that differ become slots. The result, a union-free regular expression, is the
host's wrapper. On pages that don't mark up their main text it says which container carries the host's running text, and
which texts inside are the host's own template.

Pages of equal forms are joined in tasks, then by (host, form, part); different forms are aligned in groups of
about FAN, round after round, so a hot host reaches the last alignment as a few wrappers, not as its pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

#: Wrappers a task keeps before it passes them on, parts in which those of equal forms are joined first, and wrappers of different forms aligned in one group.
FORMS_IN_TASK, PARTS, FAN = 2000, 64, 256
#: Pages of different contents that a host must have before a text that all its pages share counts as template.
TEMPLATE_PAGES = 5
#: Optional tokens that a wrapper keeps; the lightest others become gaps.
MOST_OPTIONAL, GAP = 4096, "?"
#: Bytes of hosts' rules that are broadcast at most; beyond, pages and rules meet in a shuffle.
BROADCAST_BYTES = 32 << 20

BLOCKS = set("html body div p section article main header footer nav aside form ul ol li dl dt dd table thead tbody tfoot tr td th caption h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address fieldset legend details summary dialog menu hr center hgroup search".split())
RAW = set("script style title textarea noscript template iframe svg math object canvas audio video select option datalist button".split())
VOID = set("br hr img input meta link area base col embed source track wbr".split())
DROP_TAGS = set("head nav footer aside form menu dialog search fieldset".split())
DROP_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROP_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs topbar "
    "footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social follow related recommended recommendations "
    "comment comments commentlist respond replies discussion disqus pagination pager paging widget widgets toolbar search skip copyright legal disclaimer hidden print tags".split()
)
#: Names that also stand for a page's frame, which may hold the main text.
LAYOUT = frozenset("sidebar side header footer menu nav topbar widget widgets banner".split())
WITHOUT = frozenset("has with no without".split())
MAIN_TAGS = {"article", "main"}
CLOSED_BY_BLOCK = {"p"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}

_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("sig", "tag", "drop", "names", "parts", "up")

    def __init__(self, sig: str, tag: str, drop: bool, up: Node | None, names: frozenset = frozenset()):
        self.sig, self.tag, self.drop, self.names, self.up = sig, tag, drop, names, up
        self.parts: list[Node | str] = []  # in page order


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(text)}


def _signature(tag: str, attrs: str) -> tuple[str, bool, frozenset]:
    """The form of an element (tag, class, id; digits left out), whether it is no part of a main text, and by which names alone if so."""
    if not attrs or attrs.isspace():
        return tag, tag in DROP_TAGS, frozenset()
    a = _attributes(attrs)
    names = f"{a.get('id', '')} {a.get('class', '')}".split()
    words = [w.lower() for n in names for w in _NAME.findall(n)]
    drop = tag in DROP_TAGS or bool(set(a.get("role", "").lower().split()) & DROP_ROLES) or "hidden" in a or a.get("aria-hidden") == "true"
    drop = drop or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")))
    found = frozenset() if tag in ("html", "body") else DROP_NAMES.intersection(words)
    if found <= LAYOUT and not WITHOUT.isdisjoint(words):  # as in with-sidebar
        found = frozenset()
    return ".".join([tag, *words[:4]]), drop or bool(found), frozenset() if drop else found


def parse(page: str) -> Node:
    """The tree of block elements; inline elements leave their texts, raw ones nothing. Missing end tags are implied."""
    root = top = Node("", "", False, None)
    at, n = 0, len(page)
    dropped_inline: list[str] = []

    def add(text: str) -> None:
        if text and not dropped_inline:
            if top.parts and isinstance(top.parts[-1], str):
                top.parts[-1] += text
            else:
                top.parts.append(text)

    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(entities.unescape(page[at:]))
            break
        if m.start() > at:
            add(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        closing, tag = m[1], m[2].lower()
        if tag in RAW:
            if not closing and not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag == "br" or tag == "hr":
            add("\n")
            continue
        if tag in VOID:
            continue
        if tag not in BLOCKS:
            # An inline element can be hidden or an advert too; it counts till its end tag or the block's end.
            if closing:
                if dropped_inline and dropped_inline[-1] == tag:
                    dropped_inline.pop()
            elif dropped_inline and dropped_inline[-1] == tag or m[3] and not m[3].isspace() and tag != "a" and _signature(tag, m[3])[1]:
                dropped_inline.append(tag)
            continue
        dropped_inline.clear()
        if closing:
            x = top
            while x is not root and x.tag != tag:
                x = x.up
            if x is not root:
                top = x.up
            continue
        if top.tag in CLOSED_BY_BLOCK:
            top = top.up
        if tag in SAME_LEVEL:
            x = top
            while x is not root and x.tag not in SCOPE[tag]:
                if x.tag in SAME_LEVEL[tag]:
                    top = x.up
                x = x.up
        if tag in ("html", "body") and any(p.tag == tag for p in _chain(top)):
            continue
        sig, drop, names = _signature(tag, m[3])
        if drop and tag in MAIN_TAGS and not any(p.tag in MAIN_TAGS for p in _chain(top)) and not re.search(r"comment|repl|respon", sig):
            drop = False
        if "header" in sig and any(p.tag in MAIN_TAGS for p in _chain(top)):
            drop = drop and bool(DROP_NAMES.difference({"header"}).intersection(sig.split(".")[1:]))  # an article's own heading
        elif tag == "header":
            drop = True
        node = Node(sig, tag, drop, top, names)
        top.parts.append(node)
        top = node
    return root


def _chain(node: Node):
    while node is not None:
        yield node
        node = node.up


# --- wrappers: [pages, hashes of some different contents, tokens] ---
# A token is [form, pages, repeated, optional, text, characters]. Forms: "<sig" and ">sig" open and close an element, "#" is a text, GAP a
# stretch of optional elements of which only the characters are kept. text is a literal (a long one's hash), or None for a slot. Marks
# of an element stand on both its tags.

def _form(text: str) -> str:
    return text if len(text) <= 200 else "\0" + hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def contents(root: Node) -> str:
    """A hash of the page's texts."""
    texts: list[str] = []
    _collect(root, None, texts)
    return hashlib.sha256("\n".join(texts).encode("utf-8", "replace")).hexdigest()[:20]


def token_stream(root: Node) -> list[list]:
    """A page as an expression: its tokens in page order, with neighbouring elements of one form made one repeated group."""
    out: list[list] = []
    opened: list[int] = []
    last: list[tuple[str, int, int] | None] = [None]  # for each open level the element closed last, with its first and next token
    todo: list[tuple[Node | str, bool]] = [(p, False) for p in reversed(root.parts)]
    while todo:
        p, closing = todo.pop()
        if isinstance(p, str):
            t = " ".join(p.split())
            if t:
                out.append(["#", 1, False, False, _form(t), len(t)])
        elif closing:
            out.append([">" + p.sig, 1, False, False, None, 0])
            start = opened.pop()
            last.pop()
            before = last[-1]
            if before and before[0] == p.sig and before[2] == start:
                group = align(out[before[1] : start], out[start:], same_page=True)
                group[0][2] = group[-1][2] = True
                start = before[1]
                out[start:] = group
            last[-1] = (p.sig, start, len(out))
        elif not p.drop:
            opened.append(len(out))
            last.append(None)
            out.append(["<" + p.sig, 1, False, False, None, 0])
            todo.append((p, True))
            todo += [(x, False) for x in reversed(p.parts)]
    return out


def _levels(tokens: list[list]) -> tuple[list[int], dict[tuple[int, str], list[int]]]:
    """Where the element or text that starts at a token ends; and, by the element around it (its first token) and form, the places of tokens."""
    ends, places, around = list(range(len(tokens))), {}, [-1]
    for i, t in enumerate(tokens):
        places.setdefault((around[-1], t[0]), []).append(i)
        if t[0][0] == "<":
            around.append(i)
        elif t[0][0] == ">":
            ends[around.pop()] = i
    places[-1, ">"] = [len(tokens)]
    return ends, places


def _next(places: list[int] | None, at: int) -> int | None:
    i = bisect_left(places, at) if places else 0
    return places[i] if places and i < len(places) else None


def align(a: list[list], b: list[list], same_page: bool = False) -> list[list]:
    """Align two expressions, of different pages or of one page's repeated elements.

    Both are read from the front. Where tokens agree they become one, and texts that differ a slot. Where they don't, the
    token of either side is looked for further on in the same element of the other, and what lies between becomes optional, on the
    side where that is shorter; an element or text that the other side lacks is optional too.
    """
    def both(s: list, t: list) -> list:
        return [s[0], max(s[1], t[1]) if same_page else s[1] + t[1], s[2] or t[2], s[3] or t[3], s[4] if s[4] == t[4] else None, s[5] + t[5]]

    if len(a) == len(b) and all(s[0] == t[0] for s, t in zip(a, b, strict=True)):
        return [both(s, t) for s, t in zip(a, b, strict=True)]
    (ends_a, places_a), (ends_b, places_b) = _levels(a), _levels(b)
    out: list[list] = []
    around, i, j = [(-1, -1)], 0, 0
    while i < len(a) or j < len(b):
        x, y = a[i][0] if i < len(a) else ">", b[j][0] if j < len(b) else ">"
        if x == y:
            out.append(both(a[i], b[j]))
            if x[0] == "<":
                around.append((i, j))
            elif x[0] == ">":
                around.pop()
            i, j = i + 1, j + 1
            continue
        in_a, in_b = _next(places_a.get((around[-1][0], y)), i), _next(places_b.get((around[-1][1], x)), j)
        if in_a is None and in_b is None:
            to_a, to_b = ends_a[i] + 1, ends_b[j] + 1
        elif in_b is None or in_a is not None and in_a - i <= in_b - j:
            to_a, to_b = in_a, j
        else:
            to_a, to_b = i, in_b
        out += [[*t[:3], True, *t[4:]] for t in (*a[i:to_a], *b[j:to_b])]
        i, j = to_a, to_b
    return out


def lighten(tokens: list[list]) -> list[list]:
    """The expression with at most about MOST_OPTIONAL optional tokens: the lightest optional elements become gaps that keep their weight.

    What all pages have stays whatever its length, so an expression is about as long as the shortest page at most, and MOST_OPTIONAL.
    """
    optional = sum(t[3] and t[0] != GAP for t in tokens)
    if optional <= MOST_OPTIONAL:
        return tokens
    ends, blocks, i = _levels(tokens)[0], [], 0
    while i < len(tokens):
        if tokens[i][3]:
            blocks.append((sum(t[5] for t in tokens[i : ends[i] + 1]), i, ends[i] + 1))
            i = ends[i]
        i += 1
    gaps: dict[int, tuple[int, int]] = {}
    for w, start, end in sorted(blocks):
        if optional <= MOST_OPTIONAL // 2:
            break
        optional -= sum(t[0] != GAP for t in tokens[start:end])
        gaps[start] = (end, w)
    out, i = [], 0
    while i < len(tokens):
        end, w = gaps.get(i, (i + 1, tokens[i][5]))
        t = [GAP, 1, True, True, None, w] if i in gaps else tokens[i]
        out.append(t)
        i = end
    return _join_gaps(out)


def _join_gaps(tokens: list[list]) -> list[list]:
    out: list[list] = []
    for t in tokens:
        if t[0] == GAP and out and out[-1][0] == GAP:
            out[-1] = [*out[-1][:5], out[-1][5] + t[5]]
        else:
            out.append(t)
    return out


def join_hosts(a: list, b: list) -> list:
    """Merge what is known of a host from some pages and from others."""
    return [a[0] + b[0], sorted({*a[1], *b[1]})[:TEMPLATE_PAGES], align(a[2], b[2])]


def container(known: list) -> list[str]:
    """Path of the element that holds most of the running text: down while one child has most of what is there, and the element no text of its own but the host's."""
    _, different, tokens = known
    weight, children, around, own = {-1: 0}, {-1: []}, [-1], set()
    for i, t in enumerate(tokens):
        if t[0][0] == "<":
            children[around[-1]].append(i)
            around.append(i)
            weight[i], children[i] = 0, []
        elif t[0][0] == ">":
            done = weight[around.pop()]
            weight[around[-1]] += done
        else:
            weight[around[-1]] += t[5]
            if t[0] == "#" and (t[4] is None or len(different) < TEMPLATE_PAGES):
                own.add(around[-1])
    path, at = [], -1
    while children[at] and at not in own:
        child = max(children[at], key=lambda i: (weight[i], -i))
        tag = tokens[child][0][1:].split(".")[0]
        if weight[child] < 0.6 * weight[at] or tokens[child][2] or tag in ("p", "ul", "ol", "table", "blockquote", "pre") or tag[0] == "h" and tag[1:].isdigit():
            break
        path.append(tokens[child][0][1:])
        at = child
    return path


def template_texts(known: list) -> list[list]:
    """Paths with their text where all pages of the host have it, once and the same, though enough of them differ."""
    pages, different, tokens = known
    found: list[list] = []
    path: list[str] = []
    bad = 0  # repeated or optional elements around
    for t in tokens if len(different) >= TEMPLATE_PAGES else []:
        here = bool(t[2] or t[3] or t[1] != pages)
        if t[0][0] == "<":
            path.append(t[0][1:])
            bad += here
        elif t[0][0] == ">":
            path.pop()
            bad -= here
        elif t[0] == "#" and t[4] and not bad and not here:
            found.append([list(path), t[4]])
    return found


def rules(known: list) -> str:
    return json.dumps([container(known), template_texts(known)], ensure_ascii=False)


def _trie(texts: list[list]) -> dict | None:
    """Template texts by path, "" for those that end there."""
    top: dict = {}
    for path, text in texts:
        at = top
        for sig in path:
            at = at.setdefault("<" + sig, {})
        at.setdefault("", set()).add(text)
    return top or None


def main_text(page: str, host_rules: str | None) -> str:
    """The page's main text; blocks in page order, parted by one space."""
    root = parse(page)
    where, template = json.loads(host_rules) if host_rules else ([], [])
    out: list[str] = []
    regions = _regions(root)
    if not regions and _open_frames(root):
        regions = _regions(root)
    if regions:  # what a page marks up as its main text stays whole
        for r in regions:
            _collect(r, None, out)
    else:
        node, fixed = root, _trie(template)
        for sig in where:
            nxt = next((p for p in node.parts if isinstance(p, Node) and p.sig == sig and not p.drop), None)
            if nxt is None:
                break
            node, fixed = nxt, fixed and fixed.get("<" + sig)
        _collect(node, fixed, out)
    return " ".join(" ".join(out).split())


def _open_frames(node: Node) -> bool:
    """Keep elements dropped for a frame's name that hold an article; true if there is one below."""
    found, todo = False, [node]
    while todo:
        for p in todo.pop().parts:
            if isinstance(p, Node) and p.tag in MAIN_TAGS and not p.drop:
                found = True
                for x in _chain(p):
                    if x is node:
                        break
                    x.drop = False
            elif isinstance(p, Node) and (not p.drop or p.names and p.names <= LAYOUT):
                todo.append(p)
    return found


def _regions(root: Node) -> list[Node]:
    """Elements marked up as main content: those in <main> if any, else articles; outermost ones."""
    found: dict[str, list[Node]] = {"main": [], "article": []}

    todo: list[tuple[Node, frozenset]] = [(root, frozenset())]
    while todo:
        node, inside = todo.pop()
        if node.tag in found:
            if node.tag not in inside:
                found[node.tag].append(node)
            inside = inside | {node.tag}
        todo += [(p, inside) for p in reversed(node.parts) if isinstance(p, Node) and not p.drop]
    if found["main"] and found["article"]:
        inside = [a for a in found["article"] if any(p in found["main"] for p in _chain(a))]
        return inside or found["main"]
    return found["main"] or found["article"]


def _collect(node: Node, fixed: dict | None, out: list[str]) -> None:
    """The element's texts in page order, but those that fixed (by _trie) has."""
    todo = [(p, fixed) for p in reversed(node.parts)]
    while todo:
        p, fixed = todo.pop()
        if isinstance(p, str):
            t = " ".join(p.split())
            if t and not (fixed and _form(t) in fixed.get("", ())):
                out.append(t)
        elif not p.drop:
            below = fixed and fixed.get("<" + p.sig)
            todo += [(x, below) for x in reversed(p.parts)]


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _together(known: Iterable[list]) -> list:
    known = iter(known)
    out = next(known)
    for w in known:
        out = join_hosts(out, w)
    return out


def _aligned(known: Iterable[list]) -> list:
    """_together for pages of different forms, which may leave many optional parts."""
    known = iter(known)
    out = next(known)
    for w in known:
        out = join_hosts(out, w)
        out[2] = lighten(out[2])
    return out


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, rules) for each host of pages (host, html).

    Pages of equal forms are joined first, which is the same in any order. Different forms are aligned in the order of their
    hashes, in rounds of groups of about FAN, so that the result doesn't depend on how pages are dealt to tasks.
    """
    def in_task(batches):
        known: dict[tuple[str, int], list] = {}

        def flush():
            rows = [(h, f, json.dumps(w)) for (h, f), w in known.items()]
            known.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["host", "form", "wrapper"])

        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                for h, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    root = parse(page or "")
                    tokens = token_stream(root)
                    forms = "\n".join(f"{t[0]}{t[2]:d}{t[3]:d}" for t in tokens)
                    key = h, int.from_bytes(hashlib.sha256(forms.encode("utf-8", "replace")).digest()[:8], "big") >> 1
                    w = [1, [contents(root)], tokens]
                    known[key] = join_hosts(known[key], w) if key in known else w
                if len(known) > FORMS_IN_TASK:
                    yield flush()
        if known:
            yield flush()

    def by_form(pdf: pd.DataFrame) -> pd.DataFrame:
        w = _together(json.loads(x) for x in pdf["wrapper"])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "form": [pdf["form"].iloc[0]], "wrapper": [json.dumps(w)]})

    def by_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("form", kind="stable")
        each = [_together(json.loads(x) for x in g) for _, g in pdf.groupby("form", sort=True)["wrapper"]]
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "form": [pdf["group"].iloc[0]], "wrapper": [json.dumps(_aligned(each))]})

    def by_host(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "rules": [rules(json.loads(by_group(pdf)["wrapper"].iloc[0]))]})

    schema = "host string, form long, wrapper string"
    parts = pages.select("host", "html").mapInArrow(in_task, schema)
    parts = parts.groupBy("host", "form", F.pmod(F.xxhash64("wrapper"), F.lit(PARTS))).applyInPandas(by_form, schema)
    parts = materialize(parts, "html-forms")
    groups = parts.select("host", "form").distinct().groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("groups"))
    groups = materialize(groups, "html-groups")
    left = groups.agg(F.max("groups")).first()[0] or 0
    group = F.pmod("form", "groups")
    while left > 1:
        rows = parts.join(broadcast_if_small(groups), "host").withColumn("group", group)
        parts = materialize(rows.groupBy("host", "group").applyInPandas(by_group, schema), "html-forms")
        left, group = -(-left // FAN) if left > FAN else 1, F.floor(F.col("form") / FAN)
    return parts.withColumn("group", F.lit(0).cast("long")).groupBy("host").applyInPandas(by_host, "host string, rules string")


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html is empty and gives an empty text; pages without a host share one wrapper; repeated rows each
    give a row; an empty table gives an empty result; other columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    wrappers = materialize(infer_wrappers(rows), "html-wrappers")

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                texts = [main_text(h or "", r) for h, r in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    size = wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("rules"))).first()[0] or 0
    found = rows.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host", "left").select("page_id", "url", "html", "rules")
    return found.mapInArrow(run, "page_id long, url string, text string, n_chars long")
