"""Main text of pages by wrappers: union-free regular expressions inferred from the token streams of each host.

A page's tags and texts become a token stream without texts, whose adjacent repeats are folded into repeated groups. The different streams of
a host are aligned one after another: equal tokens meet, texts become slots, what only some have becomes optional, and runs that repeat in
one and stand alone in the other become the repeated group. The result is the host's wrapper. It is inferred from distinct streams in
groups of bounded size, whose wrappers are aligned in the next round, so a host with most of all pages is many groups.

A second pass lays each page on its host's wrapper and sums up, by place in the wrapper, the text, the text in links, and whether it is the same on
every page. The host's main place is chosen from these sums, the third pass extracts it from each page. A page without that place is
judged by its own sums.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclelens.llm.common import BROADCAST_IDS, mapped, table, written

#: Streams or wrappers that one task aligns.
FOLD = 64
#: Elements deeper than this count as parts of the one at this depth; their texts stay.
DEPTH = 96
#: Longest run of siblings that is looked for as a repeated group, and most pairs of siblings that an alignment compares.
PERIOD, PAIRS = 4, 250_000
#: Share of a place's text that one of its children must hold to be the main place instead.
MOST = 0.6

# Element names and class words by role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output picture q rp rt ruby s samp small source span strike "
    "strong sub sup time track tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
DROPPED = frozenset("head title script style noscript template iframe noembed noframes svg canvas object audio video nav menu aside footer form button select textarea input dialog xmp".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promoted promotion banner banners cookie cookies consent gdpr notice notices "
    "notification notifications alert alerts comment comments commentlist replies disqus respond sidebar sidebars aside menu menus submenu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer share sharing social related recommended recommendations newsletter subscribe signup popup modal overlay "
    "pagination pager toolbar skip login search complementary contentinfo dialog".split()
)
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th", "tbody", "thead"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"},
}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "body": set()}

TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HEADING = re.compile(r"h[1-6]")


class Node:
    """An element with its children, or a text (tag `#`, undecoded)."""

    __slots__ = ("at", "children", "dropped", "key", "main", "tag", "text")

    def __init__(self, tag: str, key: str = "#", text: str = "", main: bool = False, dropped: bool = False):
        self.tag, self.key, self.text, self.main, self.dropped = tag, key, text, main, dropped
        self.children: list[Node] = []
        self.at = -1


def element(tag: str, attributes: str) -> Node:
    """An element by its start tag. Its key is the tag and the words of class and id, digits as #; main and dropped say what name and words tell."""
    if "=" not in attributes:
        return Node(tag, tag, main=tag in ("article", "main"), dropped=tag in DROPPED)
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    named = " ".join(found.get(n, "") for n in ("class", "id"))
    words = {w.lower() for n in ("class", "id", "role") for w in WORD.findall(found.get(n, ""))}
    key = re.sub(r"\d+", "#", ".".join([tag, *sorted(set(named.split()))]))
    main = tag in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articleBody"
    container = tag in ("html", "body", "main")
    return Node(tag, key, main=main, dropped=tag in DROPPED or (not container and bool(words & WORDS)))


def parsed(page: str) -> Node:
    """The tree of a page, whatever it is: missing end tags are supplied, stray ones and comments are left out, raw elements are not looked into."""
    root = Node("", "")
    stack, at, end = [root], 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        start = m.start() if m else end
        if start > at:
            stack[-1].children.append(Node("#", text=page[at:start]))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if any(n.tag == name for n in stack):
                while stack.pop().tag != name:
                    pass
            continue
        stop, closes = HOLDERS.get(name, {"article", "td", "th", "button", "object"}), CLOSED_BY.get(name, () if name in INLINE else {"p"})
        k = len(stack) - 1
        while k and closes and stack[k].tag not in stop:
            if stack[k].tag in closes:
                del stack[k:]
            k -= 1
        node = element(name, m[3] or m[6] or "")
        stack[-1].children.append(node)
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            node.children.append(Node("#", text=page[at : close.start() if close else end]))
            at = close.end() if close else end
        elif name not in VOID and not (m[3] or m[6] or "").endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    return root


# A wrapper is [key, quantifier, children]: quantifier is "", "?", "+" or "*"; key "#" is a text slot, key "(" a group whose children repeat together.


def _more(q: str, absent: bool, repeats: bool) -> str:
    return {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[absent or q in ("?", "*"), repeats or q in ("+", "*")]


def _names(nodes: list) -> tuple:
    return tuple(n[0] if n[0] != "(" else ("(", *_names(n[2])) for n in nodes)


def merged(a: list, b: list) -> list:
    """What matches whatever one of two expressions of one key does."""
    q = _more("", a[1] in ("?", "*") or b[1] in ("?", "*"), a[1] in ("+", "*") or b[1] in ("+", "*"))
    return [a[0], q, aligned(a[2], b[2]) if a[2] != b[2] else a[2]]


def collapsed(nodes: list) -> list:
    """Adjacent repeats of up to PERIOD siblings become repeated groups, the shortest first."""
    for period in range(1, PERIOD + 1):
        names, out, i = _names(nodes), [], 0
        if len(names) < 2 * period:
            break
        while i < len(nodes):
            j = i + period
            run = nodes[i:j]
            while len(run) == period and names[j : j + period] == names[i : i + period]:
                run = [merged(x, y) for x, y in zip(run, nodes[j : j + period], strict=True)]
                j += period
            if len(run) < period or j == i + period:
                out.append(nodes[i])
                i += 1
            else:
                out.append([run[0][0], _more(run[0][1], False, True), run[0][2]] if period == 1 else ["(", "+", run])
                i = j
        nodes = out
    return nodes


def _grouped(nodes: list, like: list) -> list:
    """Runs of siblings that are a repeated group on the other side become that group."""
    for group in like:
        if group[0] != "(" or any(n[0] == "(" and _names(n[2]) == _names(group[2]) for n in nodes):
            continue
        wanted, names, n = _names(group[2]), _names(nodes), len(group[2])
        for i in range(len(nodes) - n + 1):
            if names[i : i + n] == wanted:
                nodes = [*nodes[:i], ["(", "", nodes[i : i + n]], *nodes[i + n :]]
                break
    return nodes


def aligned(a: list, b: list) -> list:
    """Two sequences as one: a longest common subsequence of keys meets, the rest is optional. Very long ones meet by their common ends alone."""
    a, b = _grouped(a, b), _grouped(b, a)
    x, y = _names(a), _names(b)
    if x == y:
        return collapsed([merged(p, q) for p, q in zip(a, b, strict=True)])
    n, m = len(x), len(y)
    pairs: list[tuple[int, int]] = []
    if n * m <= PAIRS:
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < n and j < m:
            if x[i] == y[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        head = next((k for k in range(min(n, m)) if x[k] != y[k]), min(n, m))
        tail = next((k for k in range(min(n, m) - head) if x[n - 1 - k] != y[m - 1 - k]), min(n, m) - head)
        pairs = [(k, k) for k in range(head)] + [(n - k, m - k) for k in range(tail, 0, -1)]
    out, i, j = [], 0, 0
    for p, q in [*pairs, (n, m)]:
        out += [[w[0], _more(w[1], True, False), w[2]] for w in [*a[i:p], *b[j:q]]]
        if p < n:
            out.append(merged(a[p], b[q]))
        i, j = p + 1, q + 1
    return collapsed(out)


def stream(node: Node) -> list:
    """A tree as an expression: white space alone is no slot; what is never shown is not looked into."""
    children = [] if node.tag in RAW else [stream(c) for c in node.children if c.tag != "#" or c.text.strip()]
    return [node.key, "", collapsed(children)]


def as_text(wrapper: list) -> str:
    return json.dumps(wrapper, separators=(",", ":"), ensure_ascii=False)


class Wrapper:
    """A wrapper with its places numbered: place 0 is the page, and a child is found by its parent's place and its key."""

    def __init__(self, text: str):
        self.below: list[list[tuple[str, int]]] = []
        self._number(json.loads(text))

    def _number(self, w: list) -> int:
        at = len(self.below)
        self.below.append([])
        for child in self._flat(w[2]):
            if child[0] != "#":
                self.below[at].append((child[0], self._number(child)))
        return at

    def _flat(self, nodes: list) -> Iterator[list]:
        for n in nodes:
            if n[0] == "(":
                yield from self._flat(n[2])
            else:
                yield n

    def lay(self, root: Node) -> None:
        """Gives each element of a page its place (-1: none): the next one of its key after its elder sibling's, else the first."""
        root.at = 0
        todo = [root]
        while todo:
            node = todo.pop()
            below, last = (self.below[node.at] if node.at >= 0 else []), -1
            for c in node.children:
                if c.tag == "#":
                    continue
                fits = [k for k, (key, _) in enumerate(below) if key == c.key]
                last = next((k for k in fits if k >= last), fits[0] if fits else last)
                c.at = below[last][1] if fits else -1
                todo.append(c)


def _texts(root: Node) -> Iterator[tuple[tuple[Node, ...], str]]:
    """The texts that are shown, each with the elements around it; what is dropped is left out."""
    todo: list[tuple[Node, tuple[Node, ...]]] = [(root, ())]
    while todo:
        node, around = todo.pop()
        if node.tag == "#":
            yield around, node.text
        elif not node.dropped or not around:
            inside = (*around, node)
            todo += [(c, inside) for c in reversed(node.children)]


def sums(root: Node) -> dict[int, list]:
    """By place: shown characters, those in links, a mark of the texts, whether the place is named as main (2: article, 1: main), depth, parent."""
    out: dict[int, list] = {}
    for around, text in _texts(root):
        text = text.strip()
        n = len(text)
        if not n:
            continue
        linked = any(a.tag == "a" for a in around)
        mark = mark_of(text)
        for depth, a in enumerate(around):
            if a.at < 0 or a.tag in INLINE:
                continue
            s = out.setdefault(a.at, [0, 0, 0, (2 if a.tag != "main" else 1) if a.main else 0, depth, next((p.at for p in reversed(around[:depth]) if p.tag not in INLINE), -1)])
            s[0] += n
            s[1] += n if linked else 0
            s[2] = (s[2] * 31 + mark) & (2**62 - 1)
    return out


def mark_of(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) * 1_000_003 + len(text)


def main_place(places: list[tuple[int, float, int, int, int]]) -> int:
    """The main place among (place, characters that count, named, depth, parent), or -1 where there is no text.

    An article with most text, else a main element, else the deepest place that still holds most of the text above it.
    """
    named = [p for p in places if p[2] and p[1] > 0]
    if named:
        return max(named, key=lambda p: (p[2], p[1], -p[3], -p[0]))[0]
    below: dict[int, list] = {}
    for p in places:
        below.setdefault(p[4], []).append(p)
    here = max(places, key=lambda p: (-p[3], p[1], -p[0]), default=None)
    while here and (inner := max(below.get(here[0], []), key=lambda p: (p[1], -p[0]), default=None)) and inner[1] >= MOST * here[1] > 0:
        # A single paragraph is not a main place: its siblings belong to the text as well.
        if not below.get(inner[0]):
            break
        here = inner
    return here[0] if here else -1


def counted(s: list) -> float:
    return s[0] - s[1]


def main_text(root: Node, place: int) -> str:
    """The blocks at the main place, joined by a line feed. A header within an article gives its headings alone, any other one nothing."""
    if not any(place in [a.at for a in around] for around, t in _texts(root) if t.strip()):
        own = Wrapper(as_text(stream(root)))
        own.lay(root)
        place = main_place([(p, counted(s), s[3], s[4], s[5]) for p, s in sums(root).items()])
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        words = html.unescape("".join(parts)).split()
        if words:
            blocks.append(" ".join(words))
        parts.clear()

    todo: list[tuple[Node | None, bool, bool, bool]] = [(root, False, False, False)]
    while todo:
        node, inside, in_header, in_article = todo.pop()
        if node is None:
            flush()
        elif node.tag == "#":
            if inside and not in_header:
                parts.append(node.text)
        elif not node.dropped or node.at == place:
            if node.tag == "br" and inside:
                parts.append(" ")
            inside, in_article = inside or node.at == place, in_article or node.main
            header = in_header or node.tag == "header" or "header" in node.key.split(".")[1:]
            header = header and not (in_article and HEADING.fullmatch(node.tag))
            block = node.tag not in INLINE
            if block:
                flush()
                todo.append((None, False, False, False))
            todo += [(c, inside, header, in_article) for c in reversed(node.children)]
    flush()
    return "\n".join(blocks)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([as_text(stream(parsed(t))) for t in batch.column("html").to_pylist()], pa.string())], names=["host", "wrapper"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for texts in batch.column("wrappers").to_pylist():
            whole, *rest = [json.loads(t) for t in texts]
            for w in rest:
                whole = merged(whole, w)
            out.append(as_text(whole))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], names=["host", "wrapper"])


def inferred(pages: DataFrame) -> DataFrame:
    """(host, wrapper), one row for each host of `pages` (page_id, host, html): rounds of alignments of at most about FOLD expressions."""
    at = written(mapped(pages.select("host", "html"), _streams, "host string, wrapper string").distinct(), "wrapper-streams")
    while True:
        counts = at.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return at
        # Expressions are dealt by their text, so a group holds the same ones however the pages lie; none is far over FOLD.
        dealt = at.join(counts, "host").withColumn("part", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("n") * 2 / FOLD)))
        dealt = dealt.withColumn("part", F.when(F.col("n") <= FOLD, 0).otherwise(F.col("part")))
        lists = dealt.groupBy("host", "part").agg(F.array_sort(F.collect_list("wrapper")).alias("wrappers"))
        at = written(mapped(lists.select("host", "wrappers"), _fold, "host string, wrapper string").distinct(), "wrapper-rounds")


class Known:
    """The wrappers that a task has met last, parsed."""

    def __init__(self, most: int = 256):
        self.most, self.held = most, {}

    def get(self, text: str) -> Wrapper:
        if text not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            self.held[text] = Wrapper(text)
        return self.held[text]


SUMS = "host string, place int, chars long, linked long, mark long, named int, depth int, parent int"


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Known()
    for batch in batches:
        out: dict[str, list] = {n.split()[0]: [] for n in SUMS.split(", ")}
        for host, page, wrapper in zip(*(batch.column(n).to_pylist() for n in ("host", "html", "wrapper")), strict=True):
            root = parsed(page)
            known.get(wrapper).lay(root)
            for place, s in sums(root).items():
                for name, v in zip(out, [host, place, *s], strict=True):
                    out[name].append(v)
        types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chosen = [main_place([(p["place"], p["counts"], p["named"], p["depth"], p["parent"]) for p in places]) for places in batch.column("places").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(chosen, pa.int32())], names=["host", "main"])


def chosen(laid: DataFrame) -> DataFrame:
    """(host, main): the main place of each host. Text that is the same on all of several pages counts only where nothing else does."""
    by_place = mapped(laid, _sums, SUMS).groupBy("host", "place").agg(
        F.sum(F.col("chars") - F.col("linked")).alias("chars"), F.count("*").alias("pages"), F.min("mark").alias("least"), F.max("mark").alias("most"),
        F.max("named").alias("named"), F.min("depth").alias("depth"), F.min("parent").alias("parent"),
    )
    same = (F.col("pages") > 2) & (F.col("least") == F.col("most"))
    counts = F.when(same, F.col("chars") / F.col("pages") * 0.01).otherwise(F.col("chars")).cast("double")
    # As many places as the host's wrapper has.
    places = by_place.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("place", counts.alias("counts"), "named", "depth", "parent"))).alias("places"))
    return written(mapped(places, _places, "host string, main int"), "wrapper-places")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Known()
    for batch in batches:
        out = []
        for page, wrapper, main in zip(*(batch.column(n).to_pylist() for n in ("html", "wrapper", "main")), strict=True):
            root = parsed(page)
            known.get(wrapper).lay(root)
            out.append(main_text(root, -2 if main is None else main))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each row of `pages`: the main text by the wrapper of the page's host.

    Null or empty html gives an empty text, repeated rows and ids give a row each, a null url or one without a host shares the wrapper of all
    such pages, an empty table gives none; other columns are not looked at. A page is held whole with its tree; nothing is cut, however long it is.
    Elements that name or words mark as menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments are left out
    anywhere, and so is what lies outside the main place. Text that is split in blocks by elements stays in page order.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host"))
    wrappers = inferred(rows)

    def beside(df: DataFrame) -> DataFrame:
        small = wrappers.select(F.col("host").alias("of"), "wrapper")
        return df.join(F.broadcast(small) if small.count() <= BROADCAST_IDS // 50 else small, F.col("host") == F.col("of")).drop("of")

    mains = chosen(beside(rows).select("host", "html", "wrapper"))
    wrappers = written(wrappers.join(mains, "host", "left"), "wrappers")
    small = F.broadcast(wrappers.withColumnRenamed("host", "of")) if wrappers.count() <= BROADCAST_IDS // 50 else wrappers.withColumnRenamed("host", "of")
    laid = rows.join(small, F.col("host") == F.col("of")).select("page_id", "url", "html", "wrapper", "main")
    return mapped(laid, _extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


OP12_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS body FROM pages
), b AS (
  SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?b>', '', 'g')) AS parts FROM a
), c AS (
  SELECT page_id, url, list_filter(list_transform(parts, lambda x:
    trim(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM b
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM c
"""
