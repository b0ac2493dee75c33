"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree of style nodes (tag with class and id, by path). A node's presentation
importance is the entropy of its children's style sequences over the host's pages, its content importance that of its
text; an inner node takes the mean of its leaves. Copies of a page count once. What a host shows is weighed with what other
hosts show under the same path and with a prior that counts like a few pages: text inside an article or main element is
important, text outside it on a page that has one is not, and elsewhere nothing is known. So a host of one page and a host
of a million go by one rule.

Roles that markup states (navigation, advert, form, script, reader comments ...) are removed on every page. A compound name
is only a sign: it counts by how many of its parts name boilerplate, and less where its branch is running text.
A header is the article's own where it stands inside one. Pages are read twice, once for the tree and once for the text:
keeping what was read would cost more disk than reading costs time.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator, Set
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.skew import join_counted
from vellumspark.llm.store import staged

# Element roles of HTML, and words that name boilerplate in class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
DROPPED = frozenset("aside button canvas datalist dialog fieldset footer form head header iframe input menu nav noscript object optgroup option script select style svg template textarea title".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg"
MAIN = frozenset(("article", "main"))
WHOLE = frozenset(("html", "body", "main"))
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies cookie-banner consent disqus footer header masthead menu nav navbar navigation newsletter "
    "notice notices pagination pager popup promo promotion related share sharing sidebar side-bar social sponsor sponsored subscribe subscription toolbar widget".split()
)
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

# Paths start anew, from a hash of the path so far, at every such level, so that they stay short at any depth. A node's
# importance is that of the leaves of its own stretch of levels; no nodes are merged.
STRETCH = 64

# Names of reader comments, alone or as part of a compound; what readers' reviews are called; words of
# compounds that name a place or a container and say nothing of what is in it; words that make a name the state of an element.
COMMENTS = frozenset("comment comments commentlist disqus".split())
REPLIES = frozenset("respond replies reader-reviews user-reviews customer-reviews".split())
PLACES = frozenset(
    "area articles bar block bottom box btn button buttons container content entry group icon icons inner item items left link links list main outer page panel post posts primary region right row secondary "
    "section signup site slot sticky text top unit wrap wrapper zone".split()
)
STATES = frozenset("has with without no is".split())
RUNNING_WORDS = 20

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
# A quote opens a value only after "="; possessive, so a failed match costs one pass.
REST = re.compile(r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""")
CLOSING = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW.split("|")}
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """Markup in page order as (start, end, slash, tag, attributes); comments and declarations have no tag.

    Raw elements such as scripts come as one piece without a tag, content included. Linear in the page: where markup is
    so broken that quotes hide all further ends of tags, the next ">" ends a tag from there on.
    """
    at, strict = 0, True
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            yield at, (end := len(page) if end < 0 else end + 3), "", "", ""
            at = end
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            yield at, (end := len(page) if end < 0 else end + 1), "", "", ""
            at = end
            continue
        m = TAG.match(page, at)
        if not m:
            at += 1
            continue
        rest = REST.match(page, m.end()) if strict else None
        if rest is None:
            strict = False
            end = page.find(">", m.end()) + 1
            if not end:
                return
        else:
            end = rest.end()
        tag = m[2].lower()
        if tag in CLOSING and not m[1]:
            close = CLOSING[tag].search(page, end)
            yield at, (end := close.end() if close else len(page)), "", "", ""
        else:
            yield at, end, m[1], tag, page[m.end() : end - 1]
        at = end


@dataclass
class Sign:
    """What a compound name says of a branch (0 to 1, the share of its parts that name boilerplate), and the branch's words."""

    weight: float
    words: int = 0
    running: int = 0

    @property
    def strong(self) -> bool:
        """Whether the name outweighs the text: nearly all of it names boilerplate, and the branch is not running text."""
        return self.weight * (0.5 if self.running * 2 > self.words else 1.0) > 0.7


@dataclass
class Node:
    tag: str
    path: str
    inner: bool
    dropped: bool
    sign: Sign | None
    main: bool
    parent: Node | None = None
    children: list[str] = field(default_factory=list)


@dataclass
class Block:
    node: Node
    text: str
    dropped: bool
    main: bool

    @property
    def paths(self) -> list[tuple[str, bool]]:
        """Paths of the style nodes above the text, outermost first, and whether each lies inside an article or main element."""
        out, n = [], self.node
        while n.parent is not None:
            out.append((n.path, n.inner))
            n = n.parent
        return out[::-1]


def _sign(name: str, heads: tuple[str, ...]) -> float:
    """Weight of one name: 2 for a role of its own, else the share of boilerplate among the parts that say something."""
    parts = [p for p in re.split("[-_]+", name) if p and p not in heads]
    if not STATES.isdisjoint(parts):
        return 0.0
    known = sum(p in NAMES for p in parts)
    if name in NAMES and name not in heads or name in REPLIES or not COMMENTS.isdisjoint(parts) or 0 < known == len(parts):
        return 2.0
    return known / sum(p in NAMES or p not in PLACES for p in parts) if known else 0.0


def _node(tag: str, attributes: str, parent: Node) -> Node:
    """The style node of an element. `dropped` is inherited; a sign ends at an article or main element.

    No name removes an article or main element, or the body, itself.
    """
    style, dropped, weight = tag, tag in DROPPED and not (tag == "header" and parent.main), 0.0
    for name, *values in ATTRIBUTE.findall(attributes) if attributes else ():
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            dropped |= value in ROLES
            continue
        names = value.split()
        style += f"{'.' if name.lower() == 'class' else '#'}{' '.join(names)}"
        if tag not in WHOLE and tag not in MAIN:
            heads = ("header", "masthead") if parent.main else ()
            weight = max([weight, *(_sign(w, heads) for w in names)])
    main = tag in MAIN
    sign = None if main else parent.sign
    if 0 < weight < 2 and (sign is None or weight > sign.weight):
        sign = Sign(weight)
    path = f"{parent.path}/{style.replace('/', '|')}"
    return Node(tag, path, parent.main and not main, dropped or weight >= 2 or parent.dropped, sign, parent.main or main, parent)


def parse(page: str) -> tuple[list[Block], list[tuple[str, str]]]:
    """Text blocks in page order with the style nodes above each, and (path, child styles) of every closed node."""
    root = Node("", "", False, False, None, False)
    stack, blocks, text = [root], [], []
    shapes: list[tuple[str, str]] = []
    opened: Counter[str] = Counter()
    linked, in_link = 0, False

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            if words:
                top = stack[-1]
                blocks.append(Block(top, words, top.dropped, top.main))
                if top.sign:
                    n = words.count(" ") + 1
                    top.sign.words += n
                    top.sign.running += n if n >= RUNNING_WORDS and linked * 3 < sum(map(len, text)) else 0
            text.clear()
        linked = 0

    def close(tags: set[str] | frozenset[str], floor: frozenset[str] = frozenset()) -> None:
        if not any(opened[t] for t in tags):
            return
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in floor:
                return
            if stack[at].tag in tags:
                flush()
                while len(stack) > at:
                    n = stack.pop()
                    opened[n.tag] -= 1
                    shapes.append((n.path, " ".join(n.children)))
                return

    at = 0
    for start, end, slash, tag, attributes in tags(page):
        if start > at:
            text.append(page[at:start])
            linked += start - at if in_link else 0
        at = end
        if not tag:
            continue
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = not slash
            continue
        if slash:
            close({tag})
            continue
        flush()
        if tag in ENDS_PARAGRAPH:
            close({"p"}, frozenset(("td", "th", "button")))
        if tag in CLOSES:
            close(set(CLOSES[tag].split()), frozenset(("ul", "ol", "dl", "table")))
        child = _node(tag, attributes, stack[-1])
        if len(stack) % STRETCH == 0:
            child.path = f"{_hash(stack[-1].path):x}/{child.path.rpartition('/')[2]}"
        stack[-1].children.append(child.path.rpartition("/")[2])
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(child)
            opened[tag] += 1
    text.append(page[at:])
    flush()
    while len(stack) > 1:
        n = stack.pop()
        shapes.append((n.path, " ".join(n.children)))
    return blocks, shapes


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - 2**63


FEATURES = "host string, page long, features array<struct<path: string, kind: string, value: long>>"
FEATURES_ARROW = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.string()), ("value", pa.int64())]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: the hash of its html, and per style node the hash of its own text and of its children's styles."""
    for batch in batches:
        hosts, pages, features = [], [], []
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            page = page.as_py() or ""
            blocks, shapes = parse(page)
            own: dict[str, list[str]] = {}
            for b in blocks:
                if b.node.path:
                    own.setdefault(b.node.path, []).append(b.text)
            seen: dict[str, list[str]] = {}
            for path, shape in shapes:
                seen.setdefault(path, []).append(shape)
            hosts.append(host)
            pages.append(_hash(page))
            features.append([{"path": path, "kind": kind, "value": _hash("\n".join(parts))} for kind, found in (("content", own), ("style", seen)) for path, parts in found.items()])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(features, FEATURES_ARROW)], names=["host", "page", "features"])


def style_importance(pages: DataFrame, gamma: float = 0.9) -> DataFrame:
    """Importance of every style node of every host: host, path, pages, importance (0: the same on all pages, 1: always new)
    and peak, the entropy of the most varied text below it.

    pages has host and html. Pages of a host with the same html count once; two different ones among n of a host are taken
    for one with odds n^2 / 2^65. Counts are combined before the shuffles after that; what is grouped per host is style
    nodes, not pages.
    """
    each = pages.select("host", "html").mapInArrow(_features, FEATURES).groupBy("host", "page").agg(F.first("features").alias("features"))
    rows = each.select("host", F.inline("features"))
    counts = rows.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n"))
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"))
    # Entropy with logarithms to the base of the number of pages; one page alone tells nothing and counts as important.
    entropy = F.when(F.col("pages") > 1, (F.ln("pages") - F.col("nlogn") / F.col("pages")) / F.ln("pages")).otherwise(1.0)
    nodes = sums.select("host", "path", "kind", "pages", entropy.alias("entropy"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    # One pass: a node's text counts for all nodes above it, its children's styles for itself.
    told = lambda path, style, *content: F.struct(path.alias("path"), style.alias("style"), *(c.cast("double").alias(n) for c, n in zip(content, ("n", "entropy"))))
    none = F.lit(None)
    texts = F.transform(above, lambda p: told(p, none.cast("double"), F.col("pages"), F.col("entropy")))
    spread = nodes.select("host", F.inline(F.when(F.col("kind") == "content", texts).otherwise(F.array(told(F.col("path"), F.col("entropy"), none, none)))))
    by_node = spread.groupBy("host", "path").agg(
        (F.sum(F.col("n") * F.col("entropy")) / F.sum("n")).alias("content"), F.max("n").cast("long").alias("pages"), F.max("entropy").alias("peak"), F.max("style").alias("style")
    )
    importance = F.lit(1 - gamma) * F.coalesce("style", F.lit(1.0)) + F.lit(gamma) * F.col("content")
    return by_node.where("pages is not null").select("host", "path", "pages", importance.alias("importance"), "peak")


def weighed_branches(known: DataFrame, low: float = 0.3, same: float = 0.05, prior: float = 4.0, others: float = 8.0) -> DataFrame:
    """Per host: paths of branches that go (low), that go even inside an article (same), and that stay outside one (fresh).

    n pages of a host are n - 1 observations of a node's importance; those of other hosts under the same path count like
    `others` more at most, and what is assumed beforehand like `prior` more: 1 inside an article or main element, 0 outside
    it, a half on pages without one. A branch goes where the mean is below `low` and so is all its text. Inside an article it
    must also be nearly the same everywhere (importance below `same`).
    """
    known = staged(known, "style-nodes")
    seen = F.col("pages") - 1
    everywhere = known.where("pages > 1").groupBy("path").agg(F.sum(seen).alias("_w"), F.sum(seen * F.col("importance")).alias("_s"), F.sum(seen * F.col("peak")).alias("_p"))
    # Nodes that no host has on two pages tell nothing and are not sent.
    counted = staged(everywhere.join(known.groupBy("path").agg(F.count("*").alias("n")), "path"), "style-paths")
    rest = F.col("_w") - seen
    share = F.when(rest > 0, F.least(rest, F.lit(others)) / rest).otherwise(0.0)
    mean = lambda total, own: (seen * F.col(own) + share * (F.col(total) - seen * F.col(own)))
    weighed = join_counted(known, counted, ["path"]).select("host", "path", (seen + share * rest).alias("w"), mean("_s", "importance").alias("s"), mean("_p", "peak").alias("p"))
    after = lambda assumed: (F.col("s") + prior * assumed) / (F.col("w") + prior)
    dull = F.col("p") < low * F.col("w")
    pick = lambda which: F.collect_list(F.when(which, F.col("path")))
    return weighed.groupBy("host").agg(
        pick(dull & (after(0.5) < low)).alias("low"),
        pick(dull & (after(1.0) < low) & (F.col("s") < same * F.col("w"))).alias("same"),
        pick(after(0.0) >= low).alias("fresh"),
    )


def main_text(page: str, low: Set[str], same: Set[str], fresh: Set[str] = frozenset()) -> str:
    """Blocks of a page joined by newlines, without boilerplate roles and low-importance branches.

    Inside an article or main element a branch below it goes if it is in `same`. Outside of one text stays, on a page that has
    text in one, only if its node is in `fresh`; on a page without, unless a branch around it is in `low`. A branch that a
    compound name tells for boilerplate goes too, but such names alone never empty a page; one whose name tells it in part
    goes by `low` inside an article as well.
    """
    blocks = [b for b in parse(page)[0] if not b.dropped]
    signed = [b.node.sign is not None and b.node.sign.strong for b in blocks]
    if all(signed):
        signed = [False] * len(blocks)
    has_main = any(b.main and not gone for b, gone in zip(blocks, signed))
    states: dict[int, tuple[bool, bool]] = {}

    def within(node: Node) -> tuple[bool, bool]:
        """Whether a node lies in a branch that is low, and in one that is the same everywhere inside its article."""
        climb = []
        while node.parent is not None and id(node) not in states:
            climb.append(node)
            node = node.parent
        state = states.get(id(node), (False, False))
        for n in reversed(climb):
            state = states[id(n)] = state[0] or n.path in low and not (n.main and not n.inner), state[1] or n.inner and n.path in same
        return state

    out = []
    for b, gone in zip(blocks, signed):
        if gone:
            continue
        dull, repeated = within(b.node)
        if b.main:
            cut = repeated or dull and b.node.sign is not None
        else:
            cut = b.node.path not in fresh if has_main else dull
        if not cut:
            out.append(b.text)
    return "\n".join(out)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        lists = zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)))
        for page, found in zip(batch.column(2), lists):
            texts.append(main_text(page.as_py() or "", *(frozenset(x or ()) for x in found)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_pages(pages: DataFrame, low: float = 0.3, same: float = 0.05, prior: float = 4.0, salts: int = 64, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: page_id, url, text.

    Branches go by their importance on the host, weighed with other hosts and a prior: see weighed_branches(), main_text().
    Character references are decoded, white space in a block becomes one space, blocks are joined by a newline in page order.

    Null and empty html give an empty text, a null url belongs to the host "". Rows that repeat an id are separate pages.
    Other columns are not read. An empty table gives no rows. A host of any size costs `salts` rows in the join.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    by_host = weighed_branches(style_importance(rows), low, same, prior)
    # Pages of a host are dealt over salts and its style nodes repeated for each, so that a large host is many tasks wide.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    by_host = by_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = rows.join(by_host, ["host", "salt"], "left").select("page_id", "url", "html", "low", "same", "fresh")
    return joined.mapInArrow(_extract, "page_id long, url string, text string")
