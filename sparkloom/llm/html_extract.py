"""Main text of web pages by union-free regular expressions (wrappers) per host.

A page is a stream of tags and texts. A wrapper is a sequence of items: a tag, a text slot, or
a repeated group of items; each item may be optional. There is no union.

1. Within a page, equal neighbouring stretches of items are folded into repeated groups, from
   the inside out.
2. Pages of a host with the same items are one wrapper: a text slot whose texts differ becomes
   variable. This doesn't depend on any order, so it is done in every task, and then across tasks.
3. The different wrappers of a host are aligned with one another, in the order of their items' digests and
   in a tree whose pieces are ranges of the digest. Equal items match, also a group with its single
   occurrence; what only one side has becomes optional, or is taken into an equal group. A host of any size
   meets in small pieces, and a wrapper depends on the host's pages alone.
4. In the wrapper, the element that holds most of the variable text outside of furniture
   (menus, headers, footers, sidebars, notices, adverts, forms, comments) is the host's main
   element; `article` and `main` elements come first.
5. Pages are read again with the main element of their host, and matched with its wrapper. A
   block goes if each of its texts is one that its slot has on every page with that slot, two
   different pages at least. `article` and `main` elements stay whole but for furniture: the rest is the page's.

Class words only count where a whole word of the class, id or role says so: its parts (at - and _) must be
marks, which words for a box may follow. So `cookie-notice` and `comment-list` are furniture, and `story-header`
and `share-price` are not.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, small_side

# Element names by their role in HTML.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "select", "button", "xmp", "noembed", "noframes"}
FURNITURE = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "head", "title"} | RAW
MAIN = ("article", "main")
BLOCKS = {
    "address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3",
    "h4", "h5", "h6", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | FURNITURE
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id or role that mark furniture.
MARKS = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
    "footer", "gdpr", "header", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "replies",
    "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Words that only say what kind of box a mark has, where they follow it.
BOXES = {
    "area", "articles", "bar", "block", "box", "button", "buttons", "container", "form", "group", "inner", "item", "items", "left", "link", "links", "list", "message",
    "panel", "posts", "right", "section", "slot", "stories", "text", "thread", "unit", "wrap", "wrapper",
}
#: Different wrappers of a host that are aligned in one piece, about.
PIECE = 32
#: Bits of a table of the alignment that are held at once; a larger one is halved first.
TABLE = 1 << 28

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW | {"title"}}
_SPACE = re.compile(r"[\s\x1c-\x1f]+")
_PART = re.compile(r"[-_]+")


def _marks(attributes: str) -> str:
    """The furniture word of a tag's attributes, or nothing; `main` for role=main."""
    if not attributes or not attributes.strip():
        return ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "hidden"
        if name == "role" and value in ("main", "article"):
            return "main"
        for word in value.split():
            if mark := _mark_of([w for w in _PART.split(word) if w]):
                return mark
    return ""


def _mark_of(parts: list[str]) -> str:
    """The mark of a class word: all its parts are marks, or follow a mark and name its box, or are `site` and marks. The
    box of a `header` may be that of the article's title, so it doesn't count."""
    if len(parts) > 1 and parts[0] == "site":
        parts = parts[1:]
        return parts[0] if all(w in MARKS for w in parts) else ""
    if not parts or parts[0] not in MARKS:
        return ""
    rest = MARKS if parts[0] == "header" else MARKS | BOXES
    return parts[0] if all(w in rest for w in parts[1:]) else ""


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind `<` or `>` for tags, with their mark, and `#` for texts as they stand."""
    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            yield "#", "", page[at : m.start()]
        at = m.end()
        name = m[2] or m[5]
        if name:
            name, slash, rest = name.lower(), m[1] or m[4], m[3] or m[6] or ""
            if slash:
                yield ">", name, ""
            else:
                yield "<", name, _marks(rest)
                if name in _RAW_END:
                    end = _RAW_END[name].search(page, at)
                    at = end.end() if end else len(page)
                    yield ">", name, ""
        elif m[0].startswith("<![CDATA["):
            yield "#", "", m[0][9:-3]
    if at < len(page):
        yield "#", "", page[at:]


def _furniture(name: str, mark: str) -> bool:
    return name in FURNITURE or bool(mark) and mark != "main"


class _Stack:
    """Open elements; end tags close what they can, and blocks close paragraphs."""

    def __init__(self):
        self.open: list[tuple[str, str, bool, bool]] = []  # name, mark, within furniture, block

    def start(self, name: str, mark: str) -> None:
        if name in BLOCKS:
            # A paragraph, item or cell ends where the next of its kind or another block starts.
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p" or name == self.open[i][0] and name in ("li", "dd", "dt", "td", "th", "tr", "option"):
                    del self.open[i:]
                    break
                if self.open[i][3]:
                    break
        if name not in VOID:
            self.open.append((name, mark, self.furniture() or _furniture(name, mark), name in BLOCKS))

    def end(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                return
            if self.open[i][0] in MAIN and name not in MAIN + ("body", "html", "div", "section"):
                return

    def furniture(self) -> bool:
        return bool(self.open) and self.open[-1][2]


# ---------------------------------------------------------------- wrappers
# An item is [key, optional, weight]; key is "<name.mark", ">name", "#path" or ("+", keys of the group). The
# weight of a text slot has the number of characters seen (n), the characters of each text that was in it on every
# page so far, by digest (same), and the digest of the page while there was one page only, else null (page).


def _item_keys(items: list) -> tuple:
    return tuple(i[0] for i in items)


class _Folding:
    """Items so far, folded; repeats of any length are found by the three keys that they end with."""

    def __init__(self):
        self.items: list = []
        self.keys: list = []
        self.ends: dict = {}  # last three keys, of the items up to a place or within the group there: places

    def _end(self, at: int) -> tuple | None:
        key = self.keys[at]
        return key[1][-3:] if isinstance(key, tuple) else None

    def push(self, item: list) -> None:
        self.items.append(item)
        self.keys.append(item[0])
        at = len(self.keys) - 1
        if at >= 2:
            self.ends.setdefault(tuple(self.keys[-3:]), []).append(at)
        if isinstance(item[0], tuple) and len(item[0][1]) >= 3:
            self.ends.setdefault(self._end(at), []).append(at)

    def pop(self, n: int) -> list:
        gone = self.items[-n:]
        for _ in range(n):
            at = len(self.keys) - 1
            if isinstance(self.keys[at], tuple) and len(self.keys[at][1]) >= 3:
                self.ends[self._end(at)].pop()
            if at >= 2:
                self.ends[tuple(self.keys[-3:])].pop()
            del self.items[-1], self.keys[-1]
        return gone

    def lengths(self) -> Iterator[int]:
        """Lengths, rising, of the stretches at the end that may repeat what stands before them."""
        n = len(self.keys)
        yield from range(1, min(3, n))
        if n > 3:
            last = None
            for at in reversed(self.ends.get(tuple(self.keys[-3:]), ())):
                if n - 1 - at >= 3 and at != last:
                    yield n - 1 - at
                last = at

    def fold(self) -> bool:
        """One step; whether there was one."""
        keys, n = self.keys, len(self.keys)
        last = keys[-1]
        for k in self.lengths():
            before = keys[-k - 1]
            if isinstance(before, tuple) and len(before[1]) == k and before[1][-1] == last and before[1] == tuple(keys[-k:]):
                taken = self.pop(k)
                _absorb(self.items[-1], taken)
                return True
            if before == last and 2 * k <= n and keys[-2 * k] == keys[-k] and keys[-2 * k : -k] == keys[-k:] and not (k == 1 and isinstance(last, tuple)):
                taken = self.pop(k)
                first = self.pop(k)
                group = [("+", tuple(i[0] for i in first)), False, [_weights(i) for i in first]]
                _absorb(group, taken)
                self.push(group)
                return True
        return False


def _fold(items: list) -> list:
    """Repeats of neighbouring stretches become groups."""
    out = _Folding()
    for item in items:
        out.push(item)
        while out.fold():
            pass
    return out.items


def _weights(item: list):
    return item[2]


def _merge_weight(a, b):
    """The weight of a slot of two sides that match: a text stays the same if both have it."""
    if isinstance(a, list):
        return [_merge_weight(x, y) for x, y in zip(a, b, strict=True)]
    if a is None:
        return b
    if b is None:
        return a
    return {"n": a["n"] + b["n"], "same": {k: n + b["same"][k] for k, n in a["same"].items() if k in b["same"]}, "page": a["page"] if a["page"] == b["page"] else None}


def _join_weight(a, b) -> None:
    """The weight a of a group's slot takes in that of a repeat beside it. What was seen on one page only
    isn't known to stay the same where the other is of other pages."""
    if isinstance(a, list):
        for x, y in zip(a, b, strict=True):
            _join_weight(x, y)
    elif a is not None:
        a["n"] += b["n"]
        if a["page"] != b["page"]:
            if a["page"] is not None:
                a["same"].clear()
            a["page"], taken = None, b["same"] if b["page"] is None else {}
        else:
            taken = b["same"]
        for k, n in taken.items():
            a["same"][k] = a["same"].get(k, 0) + n
        for k, places in b.get("at", {}).items():
            a["at"].setdefault(k, []).extend(places)


def _absorb(group: list, items: list) -> None:
    for w, i in zip(group[2], items, strict=True):
        _join_weight(w, _weights(i))


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def describe(page: str, places: bool = False) -> list:
    """The folded items of a page; with places, text slots also have the numbers of their tokens by digest (at)."""
    items, stack, whole = [], _Stack(), _digest(page)
    for number, (kind, name, rest) in enumerate(tokens(page)):
        if kind == "<":
            stack.start(name, rest)
            items.append([f"<{name}.{rest}", False, None])
        elif kind == ">":
            stack.end(name)
            items.append([f">{name}", False, None])
        elif rest and not rest.isspace():
            # A slot is known by the elements it stands in, as far as they matter.
            path = "/".join(f"{n}.{m}" if m else n for n, m, _, block in stack.open if block or m)
            text = _digest(" ".join(rest.split()))
            weight = {"n": len(rest), "same": {text: len(rest)}, "page": whole}
            items.append([f"#{path}", False, weight | {"at": {text: [number]}} if places else weight])
    return _fold(items)


def align(wrapper: list | None, page: list) -> list:
    """The wrapper of both: matched items, and the others as optional ones in their order."""
    if wrapper is None:
        return page
    if _item_keys(wrapper) == _item_keys(page):
        return [[a[0], a[1] or b[1], _merge_weight(a[2], b[2])] for a, b in zip(wrapper, page, strict=True)]
    page, wrapper = _as_groups(page, wrapper), _as_groups(wrapper, page)
    out, i, j = [], 0, 0
    for x, y in [*_pairs(_item_keys(wrapper), _item_keys(page)), (len(wrapper), len(page))]:
        out += [[k, True, w] for k, _, w in wrapper[i:x]] + [[k, True, w] for k, _, w in page[j:y]]
        if x < len(wrapper):
            out.append([wrapper[x][0], wrapper[x][1] or page[y][1], _merge_weight(wrapper[x][2], page[y][2])])
        i, j = x + 1, y + 1
    return _fold(out)


def _pairs(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, at any length: a row of the table is an integer with a bit for each
    step along b (Hyyrö's bit-parallel rule), and tables that don't fit memory are halved (Hirschberg)."""
    start, end = 0, min(len(a), len(b))
    while start < end and a[start] == b[start]:
        start += 1
    tail = 0
    while tail < end - start and a[-tail - 1] == b[-tail - 1]:
        tail += 1
    out = [(i, i) for i in range(start)]
    todo = [(start, len(a) - tail, start, len(b) - tail)]
    while todo:
        i, i_end, j, j_end = todo.pop()
        n, m = i_end - i, j_end - j
        if not n or not m:
            continue
        if n == 1 or n * m <= TABLE:
            out += [(i + x, j + y) for x, y in _traced(a[i:i_end], b[j:j_end])]
            continue
        half = n // 2
        before = _lengths(a[i : i + half], b[j:j_end])
        after = _lengths(a[i + half : i_end][::-1], b[j:j_end][::-1])
        cut = max(range(m + 1), key=lambda y: before[y] + after[m - y])
        todo += [(i + half, i_end, j + cut, j_end), (i, i + half, j, j + cut)]
    return out + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def _rows(a: tuple, b: tuple) -> Iterator[int]:
    """The table's rows; bit y is clear where the length grows from b[:y] to b[:y + 1]."""
    places: dict = {}
    for y, key in enumerate(b):
        places.setdefault(key, []).append(y)
    width = (len(b) + 7) // 8
    masks = {}
    for key in set(a) & places.keys():
        bits = bytearray(width)
        for y in places[key]:
            bits[y >> 3] |= 1 << (y & 7)
        masks[key] = int.from_bytes(bits, "little")
    all_ones = (1 << len(b)) - 1
    row = all_ones
    for key in a:
        if both := row & masks.get(key, 0):
            row = ((row + both) | (row - both)) & all_ones
        yield row


def _lengths(a: tuple, b: tuple) -> list[int]:
    """Lengths of the longest common subsequences of a with each start of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    out, bits = [0], row.to_bytes((len(b) + 7) // 8, "little")
    for y in range(len(b)):
        out.append(out[-1] + 1 - (bits[y >> 3] >> (y & 7) & 1))
    return out


def _traced(a: tuple, b: tuple) -> list[tuple[int, int]]:
    width = (len(b) + 7) // 8
    rows = [row.to_bytes(width, "little") for row in _rows(a, b)]
    out, x, y = [], len(a), len(b)
    while x and y:
        at, bit = y - 1 >> 3, 1 << (y - 1 & 7)
        if rows[x - 1][at] & bit:
            y -= 1
        elif x > 1 and not rows[x - 2][at] & bit:
            x -= 1
        else:
            x, y = x - 1, y - 1
            out.append((x, y))
    return out[::-1]


def _as_groups(items: list, other: list) -> list:
    """Single occurrences of the other side's groups become groups."""
    groups: dict = {}
    for g in sorted({i[0][1] for i in other if isinstance(i[0], tuple)}, key=len, reverse=True):
        groups.setdefault(g[0], []).append(g)
    if not groups:
        return items
    out, at, keys = [], 0, _item_keys(items)
    while at < len(items):
        for g in groups.get(keys[at], ()):
            if keys[at : at + len(g)] == g:
                out.append([("+", g), any(i[1] for i in items[at : at + len(g)]), [_weights(i) for i in items[at : at + len(g)]]])
                at += len(g)
                break
        else:
            out.append(items[at])
            at += 1
    return out


def dump(wrapper: list) -> str:
    return json.dumps(wrapper)


def load(text: str) -> list:
    key = lambda k: (k[0], tuple(key(x) for x in k[1])) if isinstance(k, list) else k
    return [[key(k), o, w] for k, o, w in json.loads(text)]


def template(wrapper: list) -> list:
    """The wrapper with only the texts that stay the same, for `constants`."""

    def kept(weight):
        if isinstance(weight, list):
            return [kept(w) for w in weight]
        return weight and {"same": sorted(weight["same"]) if weight["page"] is None else []}

    return [[k, o, kept(w)] for k, o, w in wrapper]


def constants(page: list, known: list) -> set[int]:
    """Numbers of the tokens of a page (described with places) that stay the same by the host's template."""
    page, known = _as_groups(page, known), _as_groups(known, page)
    found: set[int] = set()

    def walk(a, b) -> None:
        if isinstance(a, list):
            for x, y in zip(a, b, strict=True):
                walk(x, y)
        elif a:
            for k in a["same"]:
                found.update(b["at"].get(k, ()))

    for i, j in _pairs(_item_keys(known), _item_keys(page)):
        walk(known[i][2], page[j][2])
    return found


def _own(name: str, mark: str) -> bool:
    """An element whose whole text is the page's own."""
    return name in MAIN or mark == "main"


def main_element(wrapper: list) -> str:
    """`name.mark` of the host's main element: article or main if a text slot that varies stands in
    one, else the innermost block element that holds most of the variable text outside of furniture."""
    mass: dict[str, int] = {}

    def walk(key, weight) -> None:
        if isinstance(key, tuple):
            for k, w in zip(key[1], weight, strict=True):
                walk(k, w)
        elif key.startswith("#") and weight:
            mass[key[1:]] = mass.get(key[1:], 0) + weight["n"] - (sum(weight["same"].values()) if weight["page"] is None else 0)

    for key, _, weight in wrapper:
        walk(key, weight)
    inside: dict[str, int] = {}
    for path, n in mass.items():
        steps = path.split("/") if path else []
        if any(_furniture(*(s.split(".") + [""])[:2]) for s in steps):
            continue
        for s in set(steps):
            inside[s] = inside.get(s, 0) + n
    for s in sorted(inside, key=lambda s: (-inside[s], s)):
        if s.split(".")[0] in MAIN or s.endswith(".main"):
            return s
    best = max(inside.values(), default=0)
    # Containers: elements that hold other blocks; the one deepest down that still holds nearly all.
    depth = {s: max(p.split("/").index(s) for p in mass if s in p.split("/")) for s in inside if s.split(".")[0] in ("body", "div", "section", "td", "center")}
    whole = [s for s in depth if inside[s] >= 0.9 * best]
    return max(whole, key=lambda s: (depth[s], inside[s], s), default="")


# ---------------------------------------------------------------- extraction


def extract(page: str | None, main: str, known: list | None = None) -> str:
    """Blocks of the main element, or of the whole body where the page has none, without furniture and
    what stays the same by the host's template. A page of nothing else keeps its text."""
    if not page:
        return ""
    inside = _blocks(page, main) if main else None
    if inside is None:
        for name in (*MAIN, ""):
            inside = _blocks(page, name)
            if inside is not None:
                break
    if known and not all(own for _, _, own in inside):
        same = constants(describe(page, places=True), known)
        inside = [b for b in inside if b[2] or not same.issuperset(b[1])] or inside
    return "\n\n".join(text for text, _, _ in inside)


def _blocks(page: str, main: str) -> list[tuple[str, list[int], bool]] | None:
    """(text, numbers of its tokens, whether all are within an element of the page's own)."""
    stack, blocks, current, places, seen = _Stack(), [], [], [], not main
    name_of, _, mark_of = main.partition(".")
    all_own, own = _own(name_of, mark_of), True

    def flush() -> None:
        nonlocal own
        if current:
            text = _SPACE.sub(" ", html_lib.unescape("".join(current))).strip()
            if text:
                blocks.append((text, places.copy(), own))
            current.clear()
            places.clear()
            own = True

    is_main = lambda n, m: n == name_of and m == mark_of
    depth = None if main else 0  # number of open elements when the main one was opened
    for number, (kind, name, rest) in enumerate(tokens(page)):
        if kind == "#":
            if depth is not None and not stack.furniture():
                current.append(rest)
                if not rest.isspace():
                    places.append(number)
                    own = all_own or own and any(_own(n, m) for n, m, _, _ in stack.open)
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            current.append(" ")
        if kind == "<":
            stack.start(name, rest)
            if depth is None and is_main(name, rest) and not (stack.open and len(stack.open) > 1 and stack.open[-2][2]):
                depth, seen = len(stack.open), True
        else:
            stack.end(name)
        if main and depth is not None and len(stack.open) < depth:
            flush()
            depth = None
    flush()
    return blocks if seen else None


# ---------------------------------------------------------------- Spark


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))


def _bare(page: str) -> bool:
    """Whether a page has no article or main element outside of furniture."""
    stack = _Stack()
    for kind, name, rest in tokens(page):
        if kind == "<":
            if name in MAIN and not rest and not stack.furniture():
                return False
            stack.start(name, rest)
        elif kind == ">":
            stack.end(name)
    return True


_PARTS = "host string, digest string, wrapper string, bare boolean"


def _merged(a: list | None, b: list) -> list:
    """One wrapper of two with the same keys; the order of the two doesn't matter."""
    return b if a is None else [[x[0], x[1] or y[1], _merge_weight(x[2], y[2])] for x, y in zip(a, b, strict=True)]


def _describe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[tuple, list] = {}  # host and keys: wrapper, and whether a page has no element of its own
    held = 0

    def out() -> pa.RecordBatch:
        digest = lambda keys: hashlib.blake2b(repr(keys).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()
        return _rows_of([(host, digest(keys), dump(w), b) for (host, keys), (w, b) in found.items()])

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if page.is_valid:
                text = page.as_py()
                items = describe(text)
                place = (host, _item_keys(items))
                if place not in found:
                    held += len(items) + 10
                wrapper, bare = found.get(place, (None, False))
                found[place] = _merged(wrapper, items), bare or _bare(text)
        if held > 500_000:
            yield out()
            found, held = {}, 0
    yield out()


def _runs(same: Callable[[list, list], list], length: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of _PARTS, sorted by host and digest, with each run of rows that agree in the host and the first digits
    of the digest (all, if length is None) made one by `same`. It is named by its first digest."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, first, text, wrapper, bare, done = None, None, None, None, False, []

        def close() -> None:
            if run is not None:
                done.append((run[0], first, dump(wrapper) if text is None else text, bare))

        for batch in batches:
            for host, digest, new, b in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if (host, digest[:length]) != run:
                    close()
                    run, first, text, wrapper, bare = (host, digest[:length]), digest, new, None, b
                    continue
                if text is not None:
                    wrapper, text = load(text), None
                wrapper, bare = same(wrapper, load(new)), bare or b
            if len(done) > 1000:
                yield _rows_of(done)
                done.clear()
        close()
        yield _rows_of(done)

    return joined


def _rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["host", "digest", "wrapper", "bare"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, wrapper (JSON), main, known (JSON, compressed): one row for each host of pages. known is the
    template; null where all pages give an element of their own, whose text all stays. Rows depend on the
    pages alone, however they are dealt and ordered."""
    narrow = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    parts = materialise(narrow.mapInArrow(_describe_batches, _PARTS), "html-parts")
    equal = parts.repartition("host", "digest").sortWithinPartitions("host", "digest").mapInArrow(_runs(_merged, None), _PARTS)
    equal = materialise(equal, "html-equal")
    most = equal.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    digits = 0  # hexadecimal digits of the digest that make a piece
    while PIECE * 16**digits < most:
        digits += 1
    for length in range(digits, -1, -1):
        equal = equal.repartition("host", F.substring("digest", 1, length)).sortWithinPartitions("host", "digest").mapInArrow(_runs(align, length), _PARTS)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [load(w) for w in pdf["wrapper"]]
            main = [main_element(w) for w in made]
            own = [_own(*(m.split(".") + [""])[:2]) for m in main]
            known = [zlib.compress(dump(template(w)).encode()) if b or not o else None for w, b, o in zip(made, pdf["bare"], own, strict=True)]
            yield pd.DataFrame({"host": pdf["host"], "wrapper": pdf["wrapper"], "main": main, "known": known})

    return equal.mapInPandas(choose, "host string, wrapper string, main string, known binary")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text, n_chars.

    A null, empty or text-free page has the empty text. A null url, or one without a host, is of
    the host ''. Pages without the host's main element give their article, else main, else body.
    White space in a block becomes one space; blocks are joined by an empty line. Rows that
    repeat are extracted each, and count as one page for what stays the same. Of elements that hold equally
    much the deepest is the main one, then the last by name. Pages of any length are read and aligned whole.
    Other columns are ignored, whatever their names; an empty table gives an empty result."""
    known = materialise(wrappers(pages, url_col, html_col).select("host", "main", "known"), "html-main")
    # The main elements can be sent to all executors; templates are larger and only for the hosts that need one.
    main = small_side(known.select(F.col("host").alias("known_host"), "main"), 200_000)
    templates = small_side(known.where("known IS NOT NULL").select(F.col("host").alias("template_host"), "known"), 2_000)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    rows = rows.join(main, rows["host"] == F.col("known_host"), "left").join(templates, rows["host"] == F.col("template_host"), "left")
    rows = rows.select("id", "url", "html", F.coalesce("main", F.lit("")).alias("main"), "known")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = lru_cache(64)(lambda known: load(zlib.decompress(known).decode()))
        for batch in batches:
            texts = []
            for h, m, k in zip(batch.column("html"), batch.column("main").to_pylist(), batch.column("known"), strict=True):
                texts.append(extract(h.as_py(), m, opened(k.as_py()) if k.is_valid else None))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    out = rows.mapInArrow(extracted, f"id {kind}, url string, text string, n_chars long")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.col("text"), "n_chars")
