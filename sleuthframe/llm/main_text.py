"""Main text of web pages, with a style tree for each site.

Pages are parsed to elements. The pages of one host are merged into a style
tree, whose nodes are paths of tags and classes. A node's own importance is the
entropy of what its pages put there (its own text, or else which children it
has), in units of its number of pages: what is the same everywhere is 0. Pages of a
host that put the same at every node count once. A few pages tell little, so a
node's importance is weighed against that of one seen on PRIOR pages, all
different: the fewer pages, the nearer to 1, at every number of pages alike. A branch
is as important as its most important node. A page loses the branches that their
tags, classes or first headings name as navigation, notices, adverts, forms,
comments and the like, and outside of article and main elements the blocks that hold nothing but
branches of low importance; if it has an article or main element, only those are
left. An article within comments, asides, footers or lists of other pages is
theirs; within anything else that is left open it begins afresh. A name of several
words (header-fixed) is about the last that doesn't say where; on an element that
holds most of the page's text, or main, it doesn't count, for that is a wrapper
named by what stands beside the article. The footer of a quotation is the article's.

A null html counts as empty; a page without text gives an empty string. Pages
with a null or odd url form a site of their own. Repeated rows are extracted
row by row; an empty table gives an empty result. Only page_id, url and html
are read, so other columns may have any names.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm.common import dealt_join, pieces, shared_folder, table, written

#: Pages, all different, that a node is thought to have been seen on before the first one.
PRIOR = 2.0
LEAST_IMPORTANCE = 0.2
#: Rows of the low-importance table that may be sent to every worker; more are joined by shuffling.
BROADCAST_NODES = 100_000

#: What a tag looks like once its name is told; the second is for one whose quotes aren't closed.
TAG = re.compile(r"</?(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.IGNORECASE)
LOOSE_TAG = re.compile(r"</?(?P<tag>[a-z][^\s/>]*+)(?P<rest>[^>]*+)>", re.IGNORECASE)
#: Elements that are left out with all they hold; select and textarea are parts of forms.
RAW = {t: re.compile(rf"</{t}\s*+>", re.IGNORECASE) for t in "script style noscript template iframe svg textarea title select".split()}
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"br", "html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: What an open p, or an open list or table item, is not looked for beyond.
P_ENDS, ITEM_ENDS = BLOCKS - {"p"}, frozenset(("ul", "ol", "dl", "table", "div"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_TAGS = frozenset("aside button dialog fieldset footer form head label menu nav".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words of class names and ids: what readers write and lists of other pages; what stands beside an article; and other noise.
READERS_NAMES = frozenset("comment comments replies reply disqus respond related recommended recommendations teaser teasers".split())
BESIDE_NAMES = frozenset("sidebar side footer nav navbar navigation menu widget widgets breadcrumb breadcrumbs pagination pager".split())
OTHERS_NAMES = READERS_NAMES | BESIDE_NAMES
NOISE_NAMES = OTHERS_NAMES | frozenset("ad ads advert adverts advertisement adsense banner cookie cookies consent gdpr header masthead modal newsletter notice popup promo share sharing skip social sponsor sponsored subscribe toolbar".split())
OTHERS_TAGS = frozenset("aside footer nav menu dialog".split())
#: Words that say where or what a part is and leave open of what: the word before them decides.
SAYS_WHERE = frozenset("left right top bottom upper lower center middle fixed sticky floating primary secondary main wrap wrapper container inner outer area block box bar panel pane row column col grid list item items section region zone slot unit site page global mobile desktop content body posts post articles article stories news reading links link buttons button icon icons form text title label message signup count trail overlay dialog small large".split())
#: A name that begins so says what an element lacks or does, or, with header, that it is part of the article.
SAYS_NOT = frozenset("has no not with without is hide hides show shows after before".split())
OWN_PARTS = frozenset("article entry post story content section chapter".split())
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: First headings of parts that readers wrote or that lead to other pages, as far as they follow a number.
READERS_HEADING = re.compile(r"\W*\d*\s*(?:(?:reader|user|all|your|latest|recent|leave a|post a|add a)\s+)?(?:comments?|replies|responses|kommentare?|leserkommentare|commentaires?|comentarios?|related (?:articles|posts|stories|pages)|you may also like|read (?:more|next))\W*\d*\W*", re.IGNORECASE)
#: Nested elements that a path tells apart; those further in are told by this one.
DEEPEST = 100


@functools.lru_cache(100_000)
def told(names: str) -> tuple[frozenset[str], bool]:
    """The words of noise that an element's class names and id are about, and
    whether all of them come from names of several words. A name is taken apart at
    hyphens, underscores and capitals; it is about its last word but for those
    that say where, so a `social-history` is a history and `header-fixed` a header."""
    found, compound = set(), True
    for name in names.split():
        parts = [p.lower() for p in NAME_PARTS.findall(name)]
        if not parts or parts[0] in SAYS_NOT:
            continue
        n = len(parts)
        while n > 1 and (parts[n - 1] in SAYS_WHERE or len(parts[n - 1]) < 2):
            n -= 1
        about = parts[n - 1]
        if about not in NOISE_NAMES or parts[0] in OWN_PARTS and about in ("header", "side"):
            continue
        found.add(about)
        compound &= len(parts) > 1
    return frozenset(found), compound


class Piece:
    """A run of text in a page: its element's path and what encloses it."""

    __slots__ = ("block", "noise", "path", "scoped", "text")

    def __init__(self, path: tuple[str, ...], block: int, noise: bool, scoped: bool, text: str):
        self.path, self.block, self.noise, self.scoped, self.text = path, block, noise, scoped, text


class Element:
    """An element of a page: what its tag says; own and article, how much text is
    in it outside of links and within articles; first, its first text and the
    element of that; holds, the tags in it that matter; state, what judge() says."""

    __slots__ = ("article", "depth", "first", "hidden", "holds", "link", "names", "own", "parent", "path", "quoted", "role", "scope", "state", "tag")

    def __init__(self, parent: Element | None, tag: str, names: str = "", role: str = "", hidden: bool = False):
        self.parent, self.tag, self.names, self.role, self.hidden = parent, tag, names, role, hidden
        self.depth = parent.depth + 1 if parent else 0
        self.link = tag == "a" or bool(parent and parent.link)
        self.scope = tag in ("article", "main") or bool(parent and parent.scope)
        self.quoted = tag in ("blockquote", "figure") or bool(parent and parent.quoted)
        self.own = self.article = 0
        self.holds: frozenset[str] = frozenset()
        self.first: tuple[Element, str] | None = None
        self.path: tuple[str, ...] = ()
        self.state = (False, False, False)


def elements(html: str) -> tuple[list[Element], list[tuple[Element, int, str]]]:
    """The elements of a page in order, and its texts: (element, block, text).
    Missing end tags are supplied, end tags without a start are dropped, and where
    no > follows any more nothing is a tag."""
    root = Element(None, "")
    made, stack, texts = [root], [root], []
    is_open: dict[str, int] = {}
    at, block, last = 0, 0, html.rfind(">")

    def text(to: int) -> None:
        raw = html[at:to]
        if raw and not raw.isspace():
            texts.append((stack[-1], block, entities.unescape(raw)))
            own = stack[-1]
            while own is not None and own.first is None:
                own.first, own = (stack[-1], texts[-1][2]), own.parent
        elif raw and texts:
            texts[-1] = (*texts[-1][:2], texts[-1][2] + " ")

    def close(k: int) -> None:
        for e in stack[k:]:
            is_open[e.tag] -= 1
        del stack[k:]

    def close_nearest(tags: tuple[str, ...], within: frozenset[str]) -> None:
        if any(is_open.get(t) for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    close(k)
                    break
                if stack[k].tag in within:
                    break

    seek = 0
    while (lt := html.find("<", seek)) >= 0:
        seek = lt + 1
        if html.startswith("<!--", lt):
            text(lt)
            end = html.find("-->", lt + 4)
            at = seek = end + 3 if end >= 0 else len(html)
            continue
        if lt > last:
            break
        if html.startswith(("<!", "<?"), lt):
            text(lt)
            at = seek = html.find(">", lt) + 1
            continue
        m = TAG.match(html, lt) or LOOSE_TAG.match(html, lt)
        if not m:
            continue
        text(lt)
        at = seek = m.end()
        tag, rest, ends = m["tag"].lower(), m["rest"], html[lt + 1] == "/"
        if tag in RAW and not ends:
            after = RAW[tag].search(html, at)
            at = seek = after.end() if after else len(html)
            continue
        if tag in BLOCKS:
            block += 1
        if ends:
            if is_open.get(tag):
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close_nearest(("p",), P_ENDS)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            close_nearest(("dt", "dd") if tag in ("dt", "dd") else (tag,), ITEM_ENDS)
        found = {a.lower(): b or c or d or "" for a, b, c, d in ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".strip() if tag not in ("html", "body") else ""
        hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        own = Element(stack[-1], tag, names, found.get("role", "").lower(), hidden)
        label = f"{tag}.{found['class'].split()[0]}" if found.get("class", "").strip() else tag
        own.path = (*stack[-1].path, label) if own.depth <= DEEPEST else stack[-1].path
        made.append(own)
        if not rest.endswith("/") or tag in BLOCKS:
            stack.append(own)
            is_open[tag] = is_open.get(tag, 0) + 1
    text(len(html))
    return made, texts


def judge(made: list[Element], texts: list[tuple[Element, int, str]]) -> None:
    """Whether each element is noise, holds what belongs to other pages or readers,
    and is in an article; parents come before what they hold."""
    for e, _, text in texts:
        n = len(text)
        e.own += 0 if e.link else n
        e.article += n if e.scope else 0
    for e in reversed(made[1:]):
        e.parent.own += e.own
        e.parent.article += e.article
        e.parent.holds |= e.holds | {e.tag} & {"main", "article"}
    whole = made[0]
    for e in made[1:]:
        noise, others, scoped = e.parent.state
        about, compound = told(e.names) if e.names else (frozenset(), False)
        readers = bool(about & READERS_NAMES) or reads_so(e, scoped)
        if about and not about & READERS_NAMES:
            # a wrapper is named by what it has beside the article
            wraps = e.article * 2 >= whole.article if whole.article else e.own * 5 >= whole.own * 4 > 0
            if "main" in e.holds or compound and wraps:
                about = frozenset()
        if e.tag in ("article", "main") and not (others or scoped and noise) and not (about & OTHERS_NAMES):
            e.state = (False, False, True)
            continue
        tag_says = e.tag in NOISE_TAGS and not (e.tag == "footer" and e.parent.quoted) or e.tag == "header" and not scoped
        others = others or readers or bool(about & OTHERS_NAMES) or e.tag in OTHERS_TAGS and tag_says
        e.state = (noise or others or tag_says or e.hidden or e.role in NOISE_ROLES or bool(about), others, scoped)


def reads_so(e: Element, scoped: bool) -> bool:
    """Whether the first text of a section or div is a heading that tells of
    comments or of other pages. In an article, where it may be about comments, it
    must have a number or articles below it."""
    if e.tag not in ("section", "div") or e.first is None or not READERS_HEADING.fullmatch(e.first[1]):
        return False
    head = e.first[0]
    for _ in range(3):
        if head is e or head.tag in HEADINGS:
            break
        head = head.parent
    return head is not e and head.tag in HEADINGS and (not scoped or "article" in e.holds or any(c.isdigit() for c in e.first[1]))


def parse(html: str) -> list[Piece]:
    """The texts of a page in order. An article or main begins afresh, whatever
    was left open around it."""
    made, texts = elements(html)
    judge(made, texts)
    return [Piece(e.path, block, e.state[0], e.state[2], text) for e, block, text in texts]


def features(parts: list[Piece]) -> dict[str, str]:
    """What a page puts at each node: its own texts, or the labels below it."""
    texts: dict[tuple[str, ...], list[str]] = {}
    below: dict[tuple[str, ...], list[str]] = {}
    for p in parts:
        texts.setdefault(p.path, []).append(" ".join(p.text.split()))
        for k in range(len(p.path)):
            labels = below.setdefault(p.path[:k], [])
            if not labels or labels[-1] != p.path[k]:
                labels.append(p.path[k])
    return {"/".join(n): "\n".join(texts[n]) for n in texts} | {"/".join(n): ">".join(c) for n, c in below.items() if n and n not in texts}


def extract(html: str, low: frozenset[str] = frozenset()) -> str:
    """The main text of a page, given its site's nodes of low importance."""
    dropped: dict[tuple[str, ...], bool] = {}

    def branch(path: tuple[str, ...]) -> bool:
        if path not in dropped:
            dropped[path] = any("/".join(path[:k]) in low for k in range(1, len(path) + 1))
        return dropped[path]

    parts = [p for p in parse(html) if not p.noise]
    if low:
        # a sentence keeps its inline elements, so a block stays or goes whole
        stays = {p.block for p in parts if not p.text.isspace() and (p.scoped or not branch(p.path))}
        parts = [p for p in parts if p.block in stays]
    if any(p.scoped and not p.text.isspace() for p in parts):
        parts = [p for p in parts if p.scoped]
    blocks: list[list[str]] = []
    last = None
    for p in parts:
        if p.block != last:
            blocks.append([])
            last = p.block
        blocks[-1].append(p.text)
    return " ".join(t for t in (" ".join("".join(b).split()) for b in blocks) if t)


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def _nodes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, nodes, features) of the pages that differ within each piece of
    a batch; page is a hash of what the page puts at all its nodes."""
    for batch in batches:
        for part in pieces(batch, "html", 8_000_000):
            seen: dict[tuple[str, int], tuple[list[str], list[int]]] = {}
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                found = sorted((node, _digest(value)) for node, value in features(parse(html)).items())
                seen.setdefault((host, _digest(repr(found))), ([n for n, _ in found], [v for _, v in found]))
            yield pa.record_batch(
                [pa.array([h for h, _ in seen], pa.string()), pa.array([p for _, p in seen], pa.int64()), pa.array([n for n, _ in seen.values()], pa.list_(pa.string())), pa.array([v for _, v in seen.values()], pa.list_(pa.int64()))],
                ["host", "page", "nodes", "features"],
            )


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple, frozenset[str]] = {}
    for batch in batches:
        for part in pieces(batch, "html", 8_000_000):
            texts = []
            for html, low in zip(part.column("html").to_pylist(), part.column("low").to_pylist(), strict=True):
                key = tuple(low or ())
                if key not in known:
                    known.clear() if len(known) > 1000 else None
                    known[key] = frozenset(key)
                texts.append(extract(html, known[key]))
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])


def site_nodes(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of every branch of every site's style tree."""
    seen = pages.select("host", "html").mapInArrow(_nodes, "host string, page bigint, nodes array<string>, features array<bigint>")
    seen = seen.groupBy("host", "page").agg(F.first(F.struct("nodes", "features")).alias("s"))
    counts = seen.select("host", F.explode(F.arrays_zip("s.nodes", "s.features")).alias("f")).groupBy("host", F.col("f.nodes").alias("node"), F.col("f.features").alias("feature")).agg(F.count("*").alias("n"))
    sums = counts.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    own = sums.select("host", F.split("node", "/").alias("path"), "pages", F.when(F.col("pages") > 1, 1 - F.col("nlogn") / (F.col("pages") * F.log("pages"))).otherwise(1.0).alias("own"))
    own = own.withColumn("own", (F.col("own") * F.col("pages") + PRIOR) / (F.col("pages") + PRIOR))
    above = own.select("host", "pages", "own", F.explode(F.transform(F.sequence(F.lit(1), F.size("path")), lambda k: F.array_join(F.slice("path", F.lit(1), k), "/"))).alias("node"))
    return above.groupBy("host", "node").agg(F.max("pages").alias("pages"), F.max("own").alias("importance"))


def main_text(df: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """(page_id, url, text, n_chars) of each page of df."""
    url = F.col("url").cast("string")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    pages = df.select("page_id", url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host.alias("host"))
    low = site_nodes(pages).filter(F.col("importance") < least)
    low = written(low.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("low")), shared_folder(df.sparkSession))
    few = (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= BROADCAST_NODES
    joined = pages.join(F.broadcast(low), "host", "left") if few else dealt_join(pages, low, "host", "html", "left")
    joined = joined.select("page_id", "url", "html", "low")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars bigint")


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
