"""Main text of web pages by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tokens, tags (by name and class) and texts. Repeats within a page are folded into groups; then
the streams of a host's pages are aligned one after another. Where they differ, a text becomes a slot, a group that
stands against one copy of its body takes it in, and whatever only one side has becomes optional. The wrapper of a
host comes from all its pages: equal streams are counted first, then aligned in salted groups, and the groups' wrappers
likewise until one is left. All pages are parsed by it; where a page and the wrapper part, they go on from the nearest
place at which they meet again. Each slot is judged over all pages by the containers it stands in and, on pages without
a main container of their own, by what the wrapper tells: a block that different pages share is not theirs, nor is a
repeated group whose blocks are links alone. Then a text has its slot's verdict for its kind of page, and a text that
the wrapper has no place for is judged by its own containers.

Defined results: null html is an empty page, with text '' and 0 characters; a null or odd url has the empty host;
broken and missing end tags close with their containers; repeated rows give repeated results; an empty table gives no
rows; columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections import Counter
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

GROUP = 32
MOST_BROADCAST_HOSTS = 5_000
MOST_FOLDED = 24
MOST_DEPTH = 24

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe)\b.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S | re.I)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
# Elements by their role in a page.
_INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var wbr".split())
_CONTAINERS = frozenset("article aside body dialog div fieldset figure footer form header main menu nav ol section table tbody td tr ul".split())
_OUT = frozenset("aside button dialog footer form header head menu nav option select title".split())
_OUT_CLASS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comment\w*|cookie\w*|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notice\w*|popup|promo\w*|related|repl(?:y|ies)|share|sidebar|social|sponsor\w*|subscribe|toolbar|widget\w*)(?:$|[\s_-])",
    re.I,
)
_MAIN = frozenset(("article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Page:
    """Symbols, texts and places of the tokens of a page. Places: 'x' outside, 'm' in the main container, 'b' elsewhere."""

    __slots__ = ("linked", "places", "symbols", "texts")

    def __init__(self, html: str):
        self.symbols, self.texts, self.places, self.linked = [], [], [], []
        in_link = False
        stack: list[tuple[str, str]] = []
        place, hidden, at = "b", None, 0
        for m in _TOKEN.finditer(html):
            if m.start() > at:
                self._text(html[at : m.start()], "x" if hidden else place, in_link)
            at = m.end()
            name = m[3]
            if not name:
                continue
            name = name.lower()
            if name == "a":
                in_link = not m[2]
            if name in ("head", "title", "button", "option"):
                hidden = (name if not m[2] else None) if hidden in (None, name) or name == "head" else hidden
            if m[2]:
                if name in _CONTAINERS and any(s[0] == name for s in stack):
                    while stack.pop()[0] != name:
                        pass
                    place = stack[-1][1] if stack else "b"
                self._tag("</" + name)
                continue
            label = " ".join(x.strip("\"'") for x in _CLASS.findall(m[4])) if m[4] else ""
            if name == "body":
                hidden = None
            if name in _CONTAINERS and not m[4].endswith("/"):
                if place == "x" or name in _OUT or (label and name != "body" and _OUT_CLASS.search(label)):
                    place = "x"
                elif name in _MAIN or place == "m":
                    place = "m"
                stack.append((name, place))
            self._tag(f"<{name} {re.sub(r'[0-9]+', '', label)}".rstrip())
        if at < len(html):
            self._text(html[at:], "x" if hidden else place, in_link)

    def _tag(self, symbol: str) -> None:
        self.symbols.append(symbol)
        self.texts.append("")
        self.places.append("")
        self.linked.append(False)

    def _text(self, raw: str, place: str, in_link: bool) -> None:
        text = entities.unescape(raw)
        if text.strip():
            self.symbols.append("T")
        elif self.symbols:
            self.symbols.append(" ")
        else:
            return
        self.texts.append(text)
        self.places.append(place)
        self.linked.append(in_link)

    def blocks(self) -> list[tuple[int, bool]]:
        """By token, for texts, the digest of the block's whole text and whether the block consists of links alone, as
        no heading is taken to."""
        out = [(0, False)] * len(self.symbols)
        block: list[int] = []
        heading = False
        for k, s in enumerate([*self.symbols, "</body"]):
            if s in ("T", " "):
                block.append(k)
            elif (name := s.lstrip("</").split(" ")[0]) not in _INLINE:
                if block:
                    told = _short(" ".join("".join(self.texts[t] for t in block).split()))
                    links = not heading and all(self.linked[t] for t in block if self.symbols[t] == "T")
                    for t in block:
                        out[t] = told, links
                    block.clear()
                heading = name in _HEADINGS and s[1] != "/"
        return out

    def shown(self, kept: list[bool]) -> str:
        parts = []
        for s, t, k in zip(self.symbols, self.texts, kept, strict=True):
            if s in ("T", " "):
                parts.append(t if k or s == " " else " ")
            elif s.lstrip("</").split(" ")[0] not in _INLINE:
                parts.append(" ")
        return " ".join("".join(parts).split())


# Wrappers are lists of items: a symbol, ["+", items] or ["?", items].


def fold(symbols: list, most: int = MOST_FOLDED) -> list:
    """Runs of equal neighbouring blocks as groups, short blocks first."""
    items = [s for s in symbols if s != " "]
    for size in range(1, most + 1):
        if not any(map(eq, items, items[size:])):
            continue
        k, out = 0, []
        while k < len(items):
            if k + size >= len(items) or items[k + size] != items[k]:
                out.append(items[k])
                k += 1
                continue
            block = items[k : k + size]
            end = k + size
            while items[end : end + size] == block:
                end += size
            if end - k > size and block != ["T"]:
                body = block[0][1] if size == 1 and isinstance(block[0], list) and block[0][0] == "+" else block
                out.append(["+", body])
                k = end
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def _head(item) -> str:
    while isinstance(item, list):
        item = item[1][0]
    return item


def _size(items: list) -> int:
    return sum(1 + _size(x[1]) if isinstance(x, list) else 1 for x in items)


def _depth(items: list) -> int:
    return 1 + max((_depth(x[1]) for x in items if isinstance(x, list)), default=0)


def _alike(a, b) -> int:
    """How well two items match: 0 not at all."""
    if isinstance(a, str) or isinstance(b, str):
        return 3 if a == b and a != "T" else 2 if a == b else 0
    return 2 if a[0] == b[0] and _head(a) == _head(b) else 0


def align(a: list, b: list) -> list:
    """The wrapper that covers what both cover."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            score = _alike(a[i], b[j])
            row[j] = max(below[j], row[j + 1], below[j + 1] + score if score else 0)
    out: list = []
    gap_a: list = []
    gap_b: list = []

    def close() -> None:
        if len(gap_a) == 1 and gap_b and gap_a[0][0] == "+" and _head(gap_a[0]) == _head(gap_b[0]):
            out.append(["+", align(gap_a[0][1], gap_b[0][1] if len(gap_b) == 1 and isinstance(gap_b[0], list) else gap_b)])
        elif len(gap_b) == 1 and gap_a and gap_b[0][0] == "+" and _head(gap_a[0]) == _head(gap_b[0]):
            out.append(["+", align(gap_a, gap_b[0][1])])
        else:
            known = [(x, align(x[1], gap_b)) for x in gap_a if gap_b and isinstance(x, list) and x[0] == "?" and _head(x) == _head(gap_b[0])]
            at, both = min(known, key=lambda k: _size(k[1]) - _size(k[0][1]), default=(None, []))
            if at is not None and _depth(both) <= MOST_DEPTH:  # an optional block that is there already
                gap_a[:] = [["?", both] if x is at else x for x in gap_a]
                gap_b.clear()
            for gap in (gap_a, gap_b):
                if gap:
                    out.extend(gap if all(isinstance(x, list) and x[0] == "?" for x in gap) else [["?", list(gap)]])
        gap_a.clear()
        gap_b.clear()

    i = j = 0
    while i < n and j < m:
        score = _alike(a[i], b[j])
        if score and best[i][j] == best[i + 1][j + 1] + score:
            close()
            out.append(a[i] if isinstance(a[i], str) or a[i] == b[j] else [a[i][0], align(a[i][1], b[j][1])])
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            gap_a.append(a[i])
            i += 1
        else:
            gap_b.append(b[j])
            j += 1
    gap_a.extend(a[i:])
    gap_b.extend(b[j:])
    close()
    return out


class Parser:
    """Gives the text tokens of a page the slots of a wrapper. A slot is the place of a T in the wrapper; `repeated` has
    those in groups."""

    def __init__(self, wrapper: list):
        self.count, self.repeated = 0, set()
        self.items = self._numbered(wrapper, False)
        self.heads = [_head(x) for x in wrapper]

    def _numbered(self, items: list, repeated: bool) -> list:
        out = []
        for x in items:
            if isinstance(x, list):
                out.append((x[0], self._numbered(x[1], repeated or x[0] == "+")))
            else:
                out.append((x, self.count if x == "T" else -1))
                if x == "T":
                    if repeated:
                        self.repeated.add(self.count)
                    self.count += 1
        return out

    def parse(self, symbols: list[str]) -> list[int]:
        """Slots, -1 for tags and for texts without a place."""
        self.slots = [-1] * len(symbols)
        self.seen = [k for k, x in enumerate(symbols) if x != " "]
        stream = [symbols[k] for k in self.seen]
        places: dict[str, list[int]] = {}
        for k, x in enumerate(stream):
            places.setdefault(x, []).append(k)
        i = at = 0
        while i < len(self.items) and at < len(stream):
            got = self._match(self.items[i], stream, at)
            if got is not None:
                i, at = i + 1, got
            elif self.items[i][0] == "?":
                i += 1
            else:
                meet = self._meet(places, i, at)
                if meet is None:
                    break
                i, at = meet
        return self.slots

    def _meet(self, places: dict[str, list[int]], i: int, at: int) -> tuple[int, int] | None:
        """From an item and a token that don't match: the pair of an item and a token from there on that costs the fewest
        skipped items and tokens. Texts are everywhere and no such place."""
        best, cost = None, None
        for j in range(i, len(self.items)):
            if cost is not None and j - i >= cost:
                break
            on = places.get(self.heads[j], ()) if self.heads[j] != "T" else ()
            k = bisect_left(on, at + (j == i))
            if k < len(on) and (cost is None or j - i + on[k] - at < cost):
                best, cost = (j, on[k]), j - i + on[k] - at
        return best

    def _match(self, item: tuple, stream: list[str], at: int) -> int | None:
        kind, what = item
        if kind not in ("+", "?") or not isinstance(what, list):
            if at < len(stream) and stream[at] == kind:
                if kind == "T":
                    self.slots[self.seen[at]] = what
                return at + 1
            return None
        end = None
        while True:
            here = at if end is None else end
            k = here
            for x in what:
                got = self._match(x, stream, k)
                if got is None:
                    if x[0] == "?" and isinstance(x[1], list):
                        continue
                    k = None
                    break
                k = got
            if k is None or k == here:
                return end
            end = k
            if kind == "?":
                return end


def merged(streams: list[list]) -> list:
    """The wrapper that covers all of the folded streams or wrappers."""
    out: list = []
    for k, x in enumerate([x for x in streams if x]):
        out = x if k == 0 else align(out, x)
    return out


def _short(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()[:8], "little", signed=True)


class Seen:
    """What pages show of the slots of a wrapper. By (slot, whether the page has a main container): how often outside,
    in the main container and elsewhere, the least and greatest block by digest, up to three different pages' whole texts, and how
    often in repeated blocks of links alone."""

    def __init__(self, parser: Parser):
        self.parser, self.found = parser, {}

    def add(self, page: Page) -> None:
        main = "m" in page.places
        whole = 0 if main else _short(page.shown([x == "b" for x in page.places]))
        blocks = [] if main else page.blocks()
        for k, (slot, place) in enumerate(zip(self.parser.parse(page.symbols), page.places, strict=True)):
            if slot >= 0:
                f = self.found.get((slot, main))
                if f is None:
                    f = self.found[(slot, main)] = [0, 0, 0, 1 << 63, -1 << 63, set(), 0]
                f["xmb".index(place)] += 1
                if not main:
                    t, links = blocks[k]
                    f[3], f[4] = min(f[3], t), max(f[4], t)
                    if len(f[5]) < 3:
                        f[5].add(whole)
                    f[6] += links and slot in self.parser.repeated


def infer(pages: list[str]) -> dict:
    """The wrapper of pages of one host, and which of its slots bear main text (twice the slot, plus 1 for pages with
    a main container), and whether any page has a main container."""
    parsed = [Page(p) for p in pages]
    streams = Counter(json.dumps(fold(p.symbols)) for p in parsed)
    wrapper = merged([json.loads(x) for x in sorted(streams, key=lambda x: (-streams[x], x))])
    seen = Seen(Parser(wrapper))
    for p in parsed:
        seen.add(p)
    keep = []
    for (slot, main), (x, m, b, low, high, on, links) in seen.found.items():
        # without a main container, neither a text that different pages share nor a list of links is theirs
        if (m >= x and m >= b) if main else (b >= x and not ((low == high or links == x + m + b) and len(on) >= 3)):
            keep.append(2 * slot + main)
    return {"wrapper": wrapper, "keep": keep, "main": any("m" in p.places for p in parsed)}


class Wrapper:
    def __init__(self, wrapper: list, keep: list[int]):
        self.parser, self.keep = Parser(wrapper), frozenset(keep)

    def text(self, html: str) -> str:
        page = Page(html)
        main = "m" in page.places
        fits = "m" if main else "b"
        kept = [2 * s + main in self.keep and p != "x" if s >= 0 else p == fits for s, p in zip(self.parser.parse(page.symbols), page.places, strict=True)]
        return page.shown(kept)


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _streams(batches):
    for b in batches:
        known: dict[tuple, str] = {}
        count: dict[tuple[str, str], int] = {}
        for html, name in zip(b.column("html").to_pylist(), b.column("__host").to_pylist(), strict=True):
            symbols = tuple(Page(html).symbols)
            stream = known.get(symbols)
            if stream is None:
                stream = known[symbols] = json.dumps(fold(list(symbols)))
            count[(name, stream)] = count.get((name, stream), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["__host", "wrapper", "n"])


def _merge_group(t: pa.Table) -> pa.Table:
    rows = sorted(zip(t.column("n").to_pylist(), t.column("wrapper").to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
    made = json.dumps(merged([json.loads(r[1]) for r in rows]))
    return pa.table({"__host": pa.array([t.column("__host")[0].as_py()]), "wrapper": pa.array([made]), "n": pa.array([sum(r[0] for r in rows)])})


def wrappers(pages: DataFrame) -> tuple[DataFrame, int]:
    """(__host, wrapper, n), from all pages, and the number of hosts."""
    kind = "__host string, wrapper string, n long"
    made = pages.select("__host", "html").mapInArrow(_streams, kind).groupBy("__host", "wrapper").agg(F.sum("n").alias("n"))
    made = written(made, "streams")
    hosts, groups = made.groupBy("__host").agg(F.count(F.lit(1)).alias("k")).agg(F.count(F.lit(1)), F.max("k")).first()
    groups = groups or 0
    while True:
        groups = -(-groups // GROUP)
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(max(groups, 1)))
        made = written(made.withColumn("salt", salt).groupBy("__host", "salt").applyInArrow(_merge_group, kind), "wrappers")
        if groups <= 1:
            return made, hosts


def _observed(batches):
    kind = pa.array([], pa.list_(pa.int64())).type
    for b in batches:
        seen: dict[str, Seen] = {}
        for html, name, found in zip(*[b.column(c).to_pylist() for c in ("html", "__host", "wrapper")], strict=True):
            if name not in seen:
                seen[name] = Seen(Parser(json.loads(found)))
            seen[name].add(Page(html))
        rows = [(name, slot, main, x, m, o, None if main else low, None if main else high, sorted(on), links) for name, s in seen.items() for (slot, main), (x, m, o, low, high, on, links) in s.found.items()]
        cols = list(zip(*rows, strict=True)) or [[]] * 10
        types = [pa.string(), pa.int32(), pa.bool_(), *[pa.int64()] * 5, kind, pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["__host", "slot", "main", "x", "m", "b", "low", "high", "pages", "links"])


def verdicts(pages: DataFrame) -> DataFrame:
    """(__host, keep) as in infer(), from all `pages`, which have their wrappers."""
    seen = pages.select("html", "__host", "wrapper").mapInArrow(_observed, "__host string, slot int, main boolean, x long, m long, b long, low long, high long, pages array<long>, links long")
    sums = [F.sum(c).alias(c) for c in ("x", "m", "b", "links")]
    seen = seen.groupBy("__host", "slot", "main").agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("on"))
    kept = F.when(F.col("main"), F.expr("m >= x AND m >= b")).otherwise(F.expr("b >= x AND NOT ((low = high OR links = x + m + b) AND on >= 3)"))
    return seen.where(kept).groupBy("__host").agg(F.collect_list(F.col("slot") * 2 + F.col("main").cast("int")).alias("keep"))


def _extract(batches):
    known: dict[str, Wrapper] = {}
    for b in batches:
        hosts, found, keep = (b.column(c) for c in ("__host", "wrapper", "keep"))
        out = []
        for k, (html, name) in enumerate(zip(b.column("html").to_pylist(), hosts.to_pylist(), strict=True)):
            w = known.get(name)
            if w is None:
                if len(known) > 2000:
                    known.clear()
                w = known[name] = Wrapper(json.loads(found[k].as_py()), keep[k].as_py() or [])
            out.append(w.text(html))
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"],
        )


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars. Wrappers are broadcast if there are few hosts, which is counted; else joined."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("__host", host(F.col("url")))
    made, hosts = wrappers(rows)
    near = F.broadcast if hosts <= MOST_BROADCAST_HOSTS else lambda df: df
    made = made.select("__host", "wrapper")
    judged = written(made.join(verdicts(rows.join(near(made), "__host")), "__host", "left"), "verdicts")
    return rows.join(near(judged), "__host").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op5_html_wrapper(spark, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
