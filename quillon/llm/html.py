"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is cut into blocks at block-level tags. A classifier's cost of calling a
block content or boilerplate, from its place in the tree, its names, its links
and its length, becomes its capacity to the source or the sink. Smoothness
edges join blocks that stand next to each other and blocks to the elements that
hold them, weaker the further up. The blocks on the source's side of the
minimum cut are the content.

Character references are decoded, white space inside a block becomes one space,
and blocks are joined in page order by two newlines. Null and empty html give
an empty text. Markup may end anywhere: what a cut-off tag has is dropped,
elements left open end with the page. Pages are read one by one, repeated or
not; other columns than page_id, url and html are ignored; an empty table
gives an empty result. Long and deeply nested pages take time in proportion.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

# a quote has a meaning right after an equals sign only
_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)|=)*+>|[^>]*>|[^>]*\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr frame keygen".split())
_SKIP = frozenset("script style noscript template iframe object svg canvas audio video select textarea button datalist title head noembed noframes applet map".split())
_RAW = frozenset("script style noscript iframe textarea title noembed noframes".split())
_CHROME = frozenset("nav aside footer form menu dialog search fieldset".split())
_CLOSES = {"li": ("li", "ul", "ol", "menu", "dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr", "table"), "th": ("td th", "tr", "table")}
#: Elements that hold text of their own: their names weigh little against it.
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote td th dd dt figcaption b i em strong code q cite sub sup mark abbr time".split())
_BAD = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side nav navbar navigation menu breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager comment comments respond disqus discussion toolbar alert disclaimer copyright skip hidden paywall outbrain taboola".split())
#: What a name that begins like boilerplate may end with and still mean it.
_PARTS = frozenset("box boxes wrapper wrap container inner outer content list block section area bar unit slot item items text body title heading header button buttons btn form link links group panel module icon icons post posts article articles story stories news row col column left right top bottom main image img label policy message card cards tab tabs video frame zone space tag tags feed stream thread reply count field input region holder".split())
_GOOD = frozenset("article content main story post entry body text prose".split())
_BAD_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog form menu menubar toolbar".split())
#: A name that begins so says what a page has or lacks, not what the element is.
_STATES = frozenset("with has have no without is not hide show".split())
NEAR, APART, HOLD = 0.6, 0.15, 0.4
#: Votes of an element's tag and names; an article inside an element of more than STRONG votes against begins anew.
CHROME, NAMED, MENTIONED, HINTED, STRONG = -8.0, -6.0, -1.5, -0.5, -5.0


def _named(names: str) -> tuple[bool, bool, bool, bool]:
    """Whether class and id names say that an element is boilerplate, mention it, hint at it (social-history), or speak for content."""
    bad = mentions = hints = good = False
    for name in names.split():
        words = [w.lower() for w in _WORDS.findall(name)]
        if not words or words[0] in _STATES:
            continue
        praised = not _GOOD.isdisjoint(words)
        # the last word says what it is
        part = words[-1] in _PARTS or len(words[-1]) <= 2
        if words[-1] in _BAD or (words[0] in _BAD and part and not praised):
            bad = True
        elif words[0] in _BAD and not praised:
            hints = True
        elif not _BAD.isdisjoint(words):
            mentions = True
        else:
            good = good or praised
    return bad, mentions, hints, good


class _Element:
    __slots__ = ("block", "links", "name", "parent", "skip", "votes")

    def __init__(self, name, parent, attributes):
        self.name, self.parent = name, parent
        self.block = self if parent is None or name in _BLOCK else parent.block
        self.skip = (parent is not None and parent.skip) or name in _SKIP
        self.links = (parent is not None and parent.links) or name == "a"
        votes = parent.votes if parent else 0.0
        inside = votes >= 2
        if name in _CHROME or (name == "header" and not inside):
            votes = min(votes, CHROME)
        elif name in ("article", "main"):
            votes = max(votes, 2.0) + 1 if votes > STRONG else votes
        if attributes and name not in ("body", "html", "article", "main", "a"):
            found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attributes)}
            bad, mentions, hints, good = _named(f"{found.get('class', '')} {found.get('id', '')}")
            style = found.get("style", "").replace(" ", "").lower()
            role = found.get("role", "").lower()
            if "hidden" in found or "display:none" in style or "visibility:hidden" in style:
                self.skip = True
            # readers see what is hidden from screen readers only: text stays, boxes are likelier decoration
            mentions = mentions or (found.get("aria-hidden", "").lower() == "true" and name in _BLOCK and name not in _TEXT)
            if role in _BAD_ROLES:
                votes = min(votes, CHROME)
            elif bad and name in _TEXT:
                votes += MENTIONED
            elif bad and not good:
                votes = min(votes, NAMED)
            elif bad or mentions:
                votes += MENTIONED
            elif hints:
                votes += HINTED
            elif (role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody" or good) and votes > STRONG:
                votes = max(votes, 1.0) + 1
        self.votes = votes


def blocks(page: str) -> list[tuple[str, _Element, float]]:
    """Text, holding element and share of linked characters of each block, in page order."""
    top = _Element("", None, "")
    opened: Counter = Counter()
    out: list[tuple[str, _Element, float]] = []
    parts: list[str] = []
    linked = total = 0

    def flush():
        nonlocal linked, total
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((text, top.block, linked / max(total, 1)))
            parts.clear()
        linked = total = 0

    def put(text):
        nonlocal linked, total
        if text and not top.skip:
            parts.append(text)
            n = len(text.strip())
            total += n
            if top.links:
                linked += n

    def leave():
        nonlocal top
        opened[top.name] -= 1
        top = top.parent

    def up_to(name):
        while top.name != name:
            leave()
        leave()

    def ends_at(e, names, stops):
        """The nearest of the blocks around that has one of the names; without stops the nearest block only, else none beyond a stop."""
        while e.parent is not None:
            if e.name in names:
                return e
            if stops is None or e.name in stops:
                return None
            e = e.parent.block
        return None

    at = 0
    while True:
        m = _TAG.search(page, at)
        if m is None:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if not m[3].endswith(">"):  # the page ends inside the tag
            break
        if name in _BLOCK:
            flush()
        if m[1]:
            if opened[name]:
                while top.name != name:
                    leave()
                leave()
            continue
        if name == "br" or (name in _VOID and name == "hr"):
            put(" ")
            continue
        if name in _VOID:
            continue
        if name in _BLOCK:  # what a start tag ends
            stops = _CLOSES.get(name)
            if opened["p"] and ends_at(top.block, ("p",), None):
                up_to("p")
            if stops and any(opened[x] for x in stops[0].split()) and (e := ends_at(top.block, stops[0].split(), stops[1:])):
                up_to(e.name)
        element = _Element(name, top, m[3][:-1])
        if m[3].endswith("/>") and name not in _BLOCK:
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        top = element
        opened[name] += 1
    flush()
    return out


def classifier(text: str, holder: _Element, linked: float) -> float:
    """Log odds of being content."""
    words = text.count(" ") + 1
    odds = -0.6 + min(words, 40) * 0.06 - 3.5 * linked
    if text[-1] in ".!?\"'”»…:;)" and words > 3:
        odds += 0.6
    if holder.name in ("h1", "h2", "h3", "h4", "h5", "h6"):
        odds += 1.0
    elif holder.name in ("p", "pre", "blockquote"):
        odds += 0.8
    if holder.votes <= STRONG:
        return holder.votes
    return odds + 2 * holder.votes


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side. Blocking flows along shortest paths (Dinic)."""
    n = len(source)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a, b, forward, back):
        out[a].append(len(to))
        to.append(b)
        cap.append(forward)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for v in range(n):
        through = min(source[v], sink[v])
        if source[v] > through:
            link(s, v, source[v] - through, 0.0)
        if sink[v] > through:
            link(v, t, sink[v] - through, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for v in queue:
            for e in out[v]:
                if cap[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[v] >= 0 for v in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-12)
                v = to[path[k] ^ 1]
                del path[k:]
                continue
            while at[v] < len(out[v]):
                e = out[v][at[v]]
                if cap[e] > 1e-12 and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            else:
                if v == s:
                    break
                e = path.pop()
                v = to[e ^ 1]
                at[v] += 1
                continue
            path.append(e)
            v = to[e]


def extract(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    odds = [classifier(*b) for b in found]
    source, sink = [max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds]
    edges: list[tuple[int, int, float]] = []
    holders: dict[int, int] = {}

    def node(e):
        """Elements are nodes without costs of their own, tied to the elements around them."""
        below = None
        while True:
            k = holders.get(id(e))
            known = k is not None
            if not known:
                k = holders[id(e)] = len(source)
                source.append(0.0)
                sink.append(0.0)
            if below is None:
                first = k
            else:
                edges.append((below, k, HOLD / 2))
            if known or e.parent is None or e.parent.parent is None:
                return first
            below, e = k, e.parent

    for i, (_, holder, _) in enumerate(found):
        around = holder.parent or holder
        edges.append((i, node(around), HOLD))
        if i:
            before = found[i - 1][1]
            edges.append((i - 1, i, NEAR if (before.parent or before) is around else APART))
    side = minimum_cut(source, sink, edges)
    return "\n\n".join(text for (text, _, _), inside in zip(found, side) if inside)


def main_texts(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [extract(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = pages.select("page_id", "url", "html")
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars bigint"
    return pages.mapInArrow(run, schema)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))
