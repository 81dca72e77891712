"""HTML extraction with a site style tree.

All pages of one host are merged into one tree of style nodes (an element's path of
tags with their classes). Over the host's different pages each node gathers how its
children are laid out and what text its branch holds, and each text block at a node
on how many pages it stands. Entropies of these give importance between 0, for what
every page repeats, and 1: of a node from the spread of its layouts and branch
texts, of a block from how evenly it is spread over the node's pages (a text on c of
m pages has 1 - log c / log m). Tags, roles and names are evidence that weighs a
node's importance: what they call menu, header, footer, sidebar, notice, advert, form
or reader comments counts little, what stands in an article or main element much,
and what stands outside the article of a page that has one little. Nodes and blocks
whose weighed importance is below ``LEAST_IMPORTANCE`` are removed with all below
them. Entropy alone would keep menus and adverts whose words differ on every page.

A class or id is a name of boilerplate as a whole token only: such words alone or
joined, with words of place or of wrapping around them (``site-footer``, not
``entry-header``). Inside an article it must be unambiguous to decide alone, as must
be the class of a heading and the id of a section; ids of headings and of sections
inside an article are anchors and name nothing, nor do classes of html, body and
main. A form around the page's article or main heading is no form.

The tree is aggregated by (host, node, layout, text), so a host with a third of
all pages is spread out; per host only what may be removed comes back, to all
workers if it is below ``BROADCAST_NODES`` rows, else by a join on host.
Null html counts as empty and gives an empty text; pages without a host are one
site; copies of a page count once in the tree; repeated rows give a row each;
unclosed, crossing and unknown tags are tolerated, and parsing takes time in
proportion to a page's length, however it is nested; an svg or template that closes
itself or has no end tag ends where it begins; a very long page is one row within
its task; other columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.llm import kernels as K

#: Different pages of a host that must have a node before it is judged, outside and inside an article.
LEAST_PAGES, LEAST_PAGES_INSIDE = 4, 10
LEAST_IMPORTANCE = 0.2
CONTENT_SHARE = 0.9
#: Weights of importance by evidence: clear boilerplate, a name that may mean it, the inside of an article, the outside of it.
CLEAR, DOUBTFUL, INSIDE, OUTSIDE = 0.15, 0.25, 4.0, 0.15
#: Nodes and blocks of all hosts that are sent to every worker; with more, pages are joined with them by host.
BROADCAST_NODES = 100_000
HOST = r"^.*?://([^/?#]*)"

# Tags and names, by how they are treated.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
DROPPED_TAGS = {"aside", "button", "dialog", "footer", "form", "head", "header", "menu", "nav", "search", "select"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "dialog"}
DROPPED_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "disqus", "footer", "form", "header",
    "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "replies", "share", "sidebar", "signup", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget",
}
#: Names that mean boilerplate inside an article too, as do two names joined.
CLEAR_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comments", "disqus", "masthead", "navbar", "navigation", "newsletter", "popup", "sidebar", "signup", "sponsored", "subscribe", "toolbar",
}
PLACES = ("site", "main", "global", "top", "bottom", "left", "right", "primary", "secondary")
WRAPPERS = ("area", "bar", "box", "button", "buttons", "container", "icons", "inner", "item", "items", "links", "list", "outer", "overlay", "posts", "section", "slot", "unit", "wrap", "wrapper", "[0-9]+", *PLACES)
UNNAMED = {"html", "body", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
CLOSES_P = BLOCK - {"body", "button", "caption", "dd", "dt", "html", "head", "legend", "li", "option", "optgroup", "select", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: What a start tag closes, and where the search for it ends.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
P_SCOPE = {"td", "th", "caption", "button", "table", "html"}

#: A tag up to its end, or up to a quote that never closes.
_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(>?)|[!?][^>]*(?:>|\Z))""", re.S)
_REST = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+(>?)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_ANY = "|".join(sorted(DROPPED_NAMES))
_NAMED = re.compile(rf"(?:(?:{'|'.join(PLACES)})[-_]+)*(?:{_ANY})(?:[-_]+(?:{_ANY}|{'|'.join(WRAPPERS)}))*")
_PART = re.compile(r"[-_]+")
#: Start and end tags of svg and template, outside comments and raw text.
_ISLAND = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|xmp)(?=[\s/>]).*?(?:</\1\s*>|\Z)|<(/?)(svg|template)(?=[\s/>])((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|["']|\Z)""", re.S | re.I)


def boilerplate(name: str, clear: bool) -> bool:
    """Does a whole class or id name boilerplate; with ``clear``, without doubt."""
    if not _NAMED.fullmatch(name):
        return False
    parts = _PART.split(name)
    return not clear or any(w in CLEAR_NAMES for w in parts) or sum(w in DROPPED_NAMES for w in parts) > 1


def islands(source: str) -> dict[int, int]:
    """Where each svg and template ends, by the end of its start tag; those that close themselves or never close are missing."""
    open_: dict[str, list[int]] = {"svg": [], "template": []}
    out = {}
    for found in _ISLAND.finditer(source):
        if not found[3]:
            continue
        stack = open_[found[3].lower()]
        if found[2]:
            if stack:
                out[stack.pop()] = found.end()
        elif not found[4].endswith("/"):
            stack.append(found.end())
    return out


def digest(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


class Page:
    """A page's style nodes in order (parent, label, path, weight of evidence) and its stream of texts and breaks."""

    def __init__(self, source: str):
        self.parent, self.label, self.tag, self.weight, self.inside = [-1], [""], [""], [1.0], [False]
        self.path = [0]
        self.paths: dict[tuple[int, str], int] = {}
        self.stream: list[tuple[int, str | None]] = []
        self.open = [0]
        self.where: dict[str, list[int]] = {}
        self.forms: set[int] = set()
        at, end = 0, len(source)
        closed: dict[int, int] | None = None
        while at < end:
            found = _TAG.search(source, at)
            stop = found.start() if found else end
            attributes = found[3] if found else None
            after = found.end() if found else end
            if attributes is not None and not found[4]:
                # a quote without an end is a character like any other
                more = None
                while after < end and not (more := _REST.match(source, after + 1))[1]:
                    after = more.end()
                if more is None or not more[1]:
                    self.stream.append((self.open[-1], source[at:]))
                    break
                attributes, after = source[found.start(3) : more.end() - 1], more.end()
            if stop > at:
                self.stream.append((self.open[-1], source[at:stop]))
            if not found:
                break
            at = after
            tag = (found[2] or "").lower()
            if not tag:
                continue
            if found[1]:
                self._close((tag,), ())
                if tag in BLOCK:
                    self.stream.append((self.open[-1], None))
            elif tag in ("svg", "template"):
                if closed is None:
                    closed = islands(source)
                at = closed.get(at, at)
            elif tag in RAW:
                closing = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                at = closing.end() if closing else end
            elif tag in VOID:
                self.stream.append((self.open[-1], " " if tag in ("br", "wbr") else None if tag == "hr" else ""))
            else:
                self._open(tag, attributes)
        for i in self.forms:
            self.weight[i] = CLEAR

    def _last(self, tags) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def _close(self, tags, scope) -> None:
        """End the innermost open element of the tags and all in it, unless one of the scope is further in."""
        last = self._last(tags)
        if last and last > self._last(scope):
            for i in self.open[last:]:
                self.where[self.tag[i]].pop()
            del self.open[last:]

    def _open(self, tag: str, attributes: str) -> None:
        classes, ids, role, hidden = [], [], "", False
        if attributes.strip():
            for key, value in _ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key == "hidden":
                    hidden = True
                elif key == "role":
                    role = value.strip("\"'").lower()
                elif key == "class":
                    classes += value.strip("\"'").lower().split()
                elif key == "id":
                    ids += value.strip("\"'").lower().split()
        if tag in CLOSES_P:
            self._close(("p",), P_SCOPE)
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        names = classes + ids
        article = bool(self.where.get("article"))
        inside = article or bool(self.where.get("main"))
        weight = 0.0 if hidden else CLEAR if role in DROPPED_ROLES or tag in DROPPED_TAGS and tag != "form" and not (tag == "header" and inside) else 1.0
        if names and weight == 1.0 and tag not in UNNAMED:
            told = classes if tag in HEADINGS or article and tag == "section" else names
            sure = [n for n in told if boilerplate(n, article or tag in HEADINGS or tag == "section" and n not in classes)]
            weight = CLEAR if sure else DOUBTFUL if any(boilerplate(n, False) for n in told) else 1.0
        if tag not in BLOCK and weight > CLEAR:
            return
        if tag in ("article", "main", "h1"):
            for place in reversed(self.where.get("form", ())):
                if self.open[place] not in self.forms:
                    break  # those further out are around an earlier one
                self.forms.remove(self.open[place])
        top = self.open[-1]
        label = tag + "".join(f".{n}" for n in sorted(set(names)))
        path = self.paths.get((top, label))
        if path is None:
            path = self.paths[top, label] = digest(str(self.path[top]), label)
        own = len(self.parent)
        self.parent.append(top)
        self.label.append(label)
        self.tag.append(tag)
        self.path.append(path)
        self.weight.append(weight)
        self.inside.append(inside)
        if tag == "form" and not inside and weight == 1.0:
            self.forms.add(own)
        elif tag == "form":
            self.weight[own] = min(weight, CLEAR)
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append(own)
        if tag in BLOCK:
            self.stream.append((own, None))

    def nodes(self) -> list[tuple[int, int, int]]:
        """(path, layout, text) of each style node, over all its places on the page: labels of its children, and the text of its branch."""
        own: list[list[str]] = [[] for _ in self.parent]
        for i, part in self.stream:
            if part:
                own[i].append(part)
        branch = [""] * len(self.parent)
        below: list[list[str]] = [[] for _ in self.parent]
        layout: dict[int, list[str]] = {}
        text: dict[int, list[str]] = {}
        for i in range(len(self.parent) - 1, 0, -1):
            words = " ".join("".join(own[i]).split())
            branch[i] = f"{digest(words, *reversed(below[i])):x}" if words or below[i] else ""
            if branch[i]:
                below[self.parent[i]].append(branch[i])
                text.setdefault(self.path[i], []).append(branch[i])
        for i in range(1, len(self.parent)):
            layout.setdefault(self.path[i], [])
            names = layout.setdefault(self.path[self.parent[i]], [])
            if not names or names[-1] != self.label[i]:
                names.append(self.label[i])
        return [(p, digest(*names), digest(*text.get(p, ()))) for p, names in layout.items() if p]

    def blocks(self) -> Iterator[tuple[int, list[int], str]]:
        """Each block of text: the node of its first piece, the stream places of its pieces, and its words."""
        held: list[int] = []
        for k, (_, part) in enumerate([*self.stream, (0, None)]):
            if part is None:
                if held and (words := " ".join("".join(self.stream[j][1] for j in held).split())):
                    yield self.stream[held[0]][0], held, words
                held = []
            elif part:
                held.append(k)

    def main(self, low: dict[int, float], inside: dict[int, float], least: float = LEAST_IMPORTANCE) -> str:
        """Kept texts, one line a block; ``low`` and ``inside`` hold the importance, if it is not 1, of nodes and blocks, outside and inside articles."""
        gone, within = [False], [False]
        for i in range(1, len(self.parent)):
            up = self.parent[i]
            main = self.tag[i] in ("article", "main")
            weight = self.weight[i] * (INSIDE if self.inside[i] and self.weight[i] > CLEAR else 1.0)
            importance = 1.0 if main else (inside if self.inside[i] else low).get(self.path[i], 1.0)
            gone.append(gone[up] or importance * weight < least)
            within.append(within[up] or main and not gone[i])
        outside = OUTSIDE if any(within) else 1.0
        repeated = set()
        if low or inside:
            for i, held, words in self.blocks():
                importance = (inside if within[i] else low).get(digest(str(self.path[i]), "", words), 1.0)
                if importance * (INSIDE if within[i] else outside) < least:
                    repeated.update(held)
        out, block = [], []
        for k, (i, part) in enumerate([*self.stream, (0, None)]):
            if part is None:
                if block and (words := entities.unescape("".join(block)).split()):
                    out.append(" ".join(words))
                block = []
            elif not gone[i] and (within[i] or outside >= least) and k not in repeated:
                block.append(part)
        return "\n".join(out)


def _columns(pages: DataFrame) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit("")))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def style_tree(pages: DataFrame) -> DataFrame:
    """Per host, style nodes (path) and text blocks at them that more than one page has: different pages of the node, and importance."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(source)
                own = digest(source)
                rows += [(host, path, None, layout, text, own) for path, layout, text in set(page.nodes())]
                rows += {(host, page.path[i], digest(str(page.path[i]), "", words), None, None, own) for i, _, words in page.blocks()}
            kinds = [pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(6)], ["host", "path", "block", "layout", "text", "page"])

    found = K.map_arrow(_columns(pages).select("host", "html"), nodes, "host string, path long, block long, layout long, text long, page long").distinct()
    counts = K.settled(found.groupBy("host", "path", "block", "layout", "text").agg(F.count("*").alias("c")).where("block is null or c > 1"))
    elements, blocks = counts.where("block is null"), counts.where("block is not null")

    def entropy(what: str) -> DataFrame:
        each = elements.groupBy("host", "path", what).agg(F.sum("c").alias("c"))
        both = each.groupBy("host", "path").agg(F.sum("c").alias("pages"), F.sum(F.col("c") * F.log("c")).alias("s"))
        value = F.when(F.col("pages") > 1, (F.log("pages") - F.col("s") / F.col("pages")) / F.log("pages")).otherwise(1.0)
        return both.select("host", "path", "pages", value.alias(f"{what}_entropy"))

    importance = (1 - CONTENT_SHARE) * F.col("layout_entropy") + CONTENT_SHARE * F.col("text_entropy")
    tree = entropy("layout").join(entropy("text").drop("pages"), ["host", "path"]).select("host", "path", "pages", importance.alias("importance"), F.lit(False).alias("is_block"))
    spread = 1 - F.log("c") / F.log("pages")
    return tree.unionByName(blocks.join(tree.select("host", "path", "pages"), ["host", "path"]).select("host", F.col("block").alias("path"), "pages", spread.alias("importance"), F.lit(True).alias("is_block")))


def _judged(rows) -> tuple[dict[int, float], dict[int, float]]:
    """Importance of nodes and blocks outside and inside articles, of (path, pages, importance)."""
    return {p: v for p, n, v in rows if n >= LEAST_PAGES}, {p: v for p, n, v in rows if n >= LEAST_PAGES_INSIDE}


def extract(pages: DataFrame, least_importance: float = LEAST_IMPORTANCE, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    most = F.when(F.col("is_block"), least_importance).otherwise(least_importance / DOUBTFUL)
    tree = K.settled(style_tree(pages).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < most)))
    few = tree.limit(broadcast_nodes + 1).collect()
    rows = _columns(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "host")
    known: dict[str, list] | None = None
    if len(few) <= broadcast_nodes:
        known = {}
        for r in few:
            known.setdefault(r.host, []).append((r.path, r.pages, r.importance))
        rows = rows.withColumn("low", F.lit(None).cast("array<struct<path:long,pages:long,importance:double>>"))
    else:
        low = tree.groupBy("host").agg(F.collect_list(F.struct("path", "pages", "importance")).alias("low"))
        rows = rows.join(low, "host", "left").select("page_id", "url", "html", "host", "low")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites: dict[str, tuple[dict[int, float], dict[int, float]]] = {}
        for batch in batches:
            found = []
            for source, host, low in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                if known is None:
                    judged = _judged([tuple(r.values()) for r in low or ()])
                else:
                    if host not in sites:
                        sites[host] = _judged(known.get(host, ()))
                    judged = sites[host]
                found.append(Page(source).main(*judged, least_importance))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return K.map_arrow(rows, texts, "page_id long, url string, text string, n_chars long")
