"""Operator 13: the main text of web pages, by site style trees.

The elements of a host's pages that have the same path of tags and classes are one node of the host's style tree. A node's
presentation is the sequence of its children (runs of equal ones count once), its content are its own blocks of text and
its links. From how these are spread over the host's pages, as entropies in units of log(pages), follow:

- presentation: how much the node's styles vary; with a single page, 1;
- content: 1 less the mean entropy of its features: what stands on every page tells nothing;
- a branch, for a page: (1 - DECAY^styles) x presentation + DECAY^styles x the mean of its own content and its children.

The first two are sums over the host's pages, counted by Spark, so a host of any size has no task of its own. The
third follows the page's own branch from the leaves up, in the page's row. What HTML itself says comes before all counts:
scripts, forms, menus and the like are noise, by tag, role or class, and an article or main element is content.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.common import cut, in_small_batches, partitions, table

DECAY = 0.9
#: Branches of less importance are removed.
LEAST_IMPORTANCE = 0.35

# Tags of HTML, and the words by which pages name what is not their main text.
BLOCKS = set(
    "html head body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside form fieldset legend"
    " blockquote pre figure figcaption address details summary hgroup center dialog menu search noscript script style template iframe object svg canvas video audio select"
    " option optgroup textarea button title dir frameset noframes".split()
)
BREAKS = {"br", "hr"}
NOISE_TAGS = set("head title script style noscript template iframe object svg canvas video audio nav footer aside form fieldset select option optgroup textarea button dialog menu search frameset noframes".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar status".split())
NOISE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar submenu breadcrumb breadcrumbs masthead topbar toolbar"
    " header footer foot sidebar aside rail widget widgets cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login"
    " search share sharing social related recommended recommendations pagination pager comment comments commentlist reply replies respond disqus discussion form copyright legal disclaimer skip"
    " script style".split()
)
CONTENT_WORDS = set("article entry post content story".split())
SAYS_NOT = {"has", "no", "not", "with", "without"}
#: An open element that one of these ends by itself, and the elements beyond which it does not look.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
NEUTRAL, NOISE, MAIN, ROOT = range(4)


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


@lru_cache(maxsize=1 << 16)
def _child_key(parent: int, label: str) -> int:
    return _hash(f"{parent}/{label}")


@lru_cache(maxsize=1 << 14)
def _label(tag: str, classes: str, name: str) -> str:
    """Numbers in names tell pages apart, not places."""
    return " ".join([tag, *sorted(set(re.sub(r"\d+", "", classes).split())), "#" + re.sub(r"\d+", "", name)])


@lru_cache(maxsize=1 << 14)
def prior(tag: str, classes: str, name: str, role: str, inside_main: bool) -> int:
    """What the element's tag, role, classes and id say of it."""
    if tag in NOISE_TAGS or role.lower() in NOISE_ROLES or (tag == "header" and not inside_main):
        return NOISE
    if tag in ("html", "body"):
        return ROOT
    for said in (*classes.split(), name):
        words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", said)]
        if not words or words[0] in SAYS_NOT:
            continue
        found = NOISE_WORDS.intersection(words[:1] if tag in ("article", "main") else words)
        if found - {"header"} or (found and not inside_main and not CONTENT_WORDS.intersection(words)):
            return NOISE
    return MAIN if tag in ("article", "main") or role.lower() in ("main", "article") else NEUTRAL


class Page(HTMLParser):
    """Elements in page order: key (of the path), parent's number and prior; blocks: (element, text); links: (element, target)."""

    def __init__(self, html: str, host: str) -> None:
        super().__init__(convert_charrefs=True)
        self.keys, self.parents, self.priors, self.styles = [_hash(host)], [-1], [NEUTRAL], [[]]
        self.blocks: list[tuple[int, str]] = []
        self.links: list[tuple[int, str]] = []
        self._open: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, inside an article
        self._count: Counter[str] = Counter()
        self._text: list[str] = []
        self.feed(html.replace("<![", "<!"))
        self.close()
        self._flush()

    def _flush(self) -> None:
        if self._text:
            if text := " ".join("".join(self._text).split()):
                self.blocks.append((self._open[-1][1], text))
            self._text = []

    def _pop(self, to: int) -> None:
        self._flush()
        for tag, _, _ in self._open[to:]:
            self._count[tag] -= 1
        del self._open[to:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = {k: v or "" for k, v in attrs} if attrs else {}
        if tag in BREAKS:
            self._flush()
            return
        _, parent, inside = self._open[-1]
        if tag in ("a", "img") and (target := named.get("href") or named.get("src")):
            self.links.append((parent, target))
        what = prior(tag, named.get("class", ""), named.get("id", ""), named.get("role", ""), inside)
        if tag not in BLOCKS and (what == NEUTRAL or tag in ("img", "input", "link", "meta", "wbr", "source", "track", "area", "base", "col", "embed", "param")):
            return
        self._flush()
        if tag in BLOCKS and self._count["p"]:
            self._end("p", {"table", "td", "th"})
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            while any(self._count[t] for t in ends) and self._end_nearest(ends, until):
                pass
        _, parent, inside = self._open[-1]
        label = _label(tag, named.get("class", ""), named.get("id", ""))
        self.styles[parent].append(label)
        self._open.append((tag, len(self.keys), inside or what == MAIN))
        self._count[tag] += 1
        self.keys.append(_child_key(self.keys[parent], label))
        self.parents.append(parent)
        self.priors.append(what)
        self.styles.append([])

    def _end_nearest(self, tags: set[str], until: set[str]) -> bool:
        for i in range(len(self._open) - 1, 0, -1):
            if self._open[i][0] in tags:
                self._pop(i)
                return True
            if self._open[i][0] in until:
                return False
        return False

    def _end(self, tag: str, until: set[str] = frozenset()) -> None:
        if self._count[tag]:
            self._end_nearest({tag}, until)

    def handle_endtag(self, tag: str) -> None:
        if tag in BREAKS:
            self._flush()
        elif self._count[tag]:
            self._end(tag)
        elif tag in BLOCKS:
            self._flush()

    def handle_data(self, data: str) -> None:
        self._text.append(data)

    def values(self) -> Counter:
        """(key, kind, value) to its count: PAGES once a key, STYLES, and FEATURES (blocks and links)."""
        found: Counter[tuple[int, int, int]] = Counter()
        for key in set(self.keys):
            found[key, PAGES, 0] = 1
        for key, style in zip(self.keys, self.styles, strict=True):
            found[key, STYLES, _hash("/".join(s for k, s in enumerate(style) if not k or s != style[k - 1]))] += 1
        for element, text in self.blocks:
            found[self.keys[element], FEATURES, _hash(text)] += 1
        for element, target in self.links:
            found[self.keys[element], FEATURES, _hash("to " + target)] += 1
        return found


PAGES, STYLES, FEATURES = range(3)


def branch_importance(keys: list[int], parents: list[int], facts: dict[int, tuple]) -> list[float]:
    """Of each element of a page. facts: key to (presentation, styles, content, null without features)."""
    n = len(keys)
    sums, counts, out = [0.0] * n, [0] * n, [1.0] * n
    for k in range(n - 1, -1, -1):  # children come after their parents
        presentation, styles, content = facts.get(keys[k], (1.0, 1, None))
        if content is not None and not counts[k]:
            out[k] = content
        elif content is not None or counts[k]:
            weight = DECAY**styles
            inner = (sums[k] + (content or 0.0)) / (counts[k] + (content is not None))
            out[k] = (1 - weight) * presentation + weight * inner
        if k:
            sums[parents[k]] += out[k]
            counts[parents[k]] += 1
    return out


def main_blocks(keys: list[int], parents: list[int], priors: list[int], at: list[int], facts: dict[int, tuple]) -> list[int]:
    """Numbers of the blocks (of elements `at`) that stay: those of articles, if there are any; else those of no branch of
    little importance; if these are none, all that are not noise by what HTML says."""
    n = len(keys)
    noise, inside, low = [False] * n, [False] * n, [False] * n
    importance = branch_importance(keys, parents, facts)
    for k in range(1, n):
        up = parents[k]
        noise[k] = noise[up] or priors[k] == NOISE
        inside[k] = inside[up] or priors[k] == MAIN
        low[k] = low[up] or (priors[k] != ROOT and importance[k] < LEAST_IMPORTANCE)
    quiet = [b for b, k in enumerate(at) if not noise[k]]
    return [b for b in quiet if inside[at[b]]] or [b for b in quiet if not low[at[b]]] or quiet


# -- Spark


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _parsed(pages: DataFrame) -> DataFrame:
    """pages with two hashes of the row, its host and its html, empty if null."""
    row = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("page_id", "url", "html")]
    return in_small_batches(pages).select(F.xxhash64(*row).alias("h1"), F.xxhash64(F.lit(1), *row[::-1]).alias("h2"), "page_id", "url", host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Page.values() of each page; the page's own hashes stand in one row for each of its nodes."""
    for batch in batches:
        rows = []
        for h1, h2, of, html in zip(*(batch.column(c).to_pylist() for c in ("h1", "h2", "host", "html")), strict=True):
            rows += [(*((h1, h2) if v[1] == PAGES else (None, None)), *v, n) for v, n in Page(html, of).values().items()]
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["h1", "h2", "key", "kind", "value", "n"])


def style_tree(values: DataFrame) -> DataFrame:
    """One row a node (key): pages, presentation, styles, content (null without features), of rows (key, kind, value, n)."""
    spread = values.groupBy("key", "kind", "value").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias("own"))
    pages = lambda k: F.col("kind") == k
    entropy = F.log(F.col("all").cast("double")) - F.col("own") / F.col("all")  # of a value over pages
    share = F.sum(F.when(pages(STYLES), F.col("all")))
    found = spread.groupBy("key").agg(
        F.max(F.when(pages(PAGES), F.col("all"))).alias("pages"),
        F.count_if(pages(STYLES)).alias("styles"),
        (F.log(share.cast("double")) - F.sum(F.when(pages(STYLES), F.col("all") * F.log(F.col("all").cast("double")))) / share).alias("variety"),  # entropy of styles
        F.avg(F.when(pages(FEATURES), entropy)).alias("sameness"),
    )
    unit, several = F.log(F.col("pages").cast("double")), F.col("pages") > 1
    within = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    return found.select("key", "pages", F.when(several, within(F.col("variety") / unit)).otherwise(1.0).alias("presentation"), "styles", F.when(F.col("sameness").isNotNull(), F.when(several, within(1 - F.col("sameness") / unit)).otherwise(1.0)).alias("content"))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's elements and, packed, its blocks of text: what is shuffled is smaller than the page."""
    for batch in batches:
        pages = [Page(html, of) for of, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)]
        lists = lambda f, kind: pa.array([f(p) for p in pages], pa.list_(kind))
        made = [lists(lambda p: p.keys, pa.int64()), lists(lambda p: p.parents, pa.int32()), lists(lambda p: p.priors, pa.int8()), lists(lambda p: [k for k, _ in p.blocks], pa.int32())]
        made.append(pa.array([zlib.compress("\n".join(t for _, t in p.blocks).encode("utf-8", "surrogatepass"), 1) for p in pages], pa.binary()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h1", "h2", "page_id", "url")), *made], ["h1", "h2", "page_id", "url", "keys", "parents", "priors", "at", "blocks"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for keys, parents, priors, at, blocks, facts in zip(*(batch.column(c).to_pylist() for c in ("keys", "parents", "priors", "at", "blocks", "facts")), strict=True):
            lines = zlib.decompress(blocks).decode("utf-8", "surrogatepass").split("\n")
            of = {f["key"]: (f["presentation"], f["styles"], f["content"]) for f in facts or ()}
            texts.append(" ".join(lines[b] for b in main_blocks(keys, parents, priors, at, of)))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html).

    A null or empty html, and a page without main text, give an empty text; a page of a host without other pages goes by
    what HTML says alone. Repeated rows count as pages and each give a row. Rows with a null url are of one host. Html
    of any length is read whole; white space is what Python's str.split takes for it. Other columns are not looked at.
    """
    rows = _parsed(pages)
    values = cut(rows.select("h1", "h2", "host", "html").mapInArrow(_values, "h1 long, h2 long, key long, kind long, value long, n long"))
    facts = _facts(values.where(F.col("kind") == PAGES).select("h1", "h2", "key"), cut(style_tree(values)))
    trees = rows.mapInArrow(_trees, f"h1 long, h2 long, page_id {pages.schema['page_id'].dataType.simpleString()}, url string, keys array<long>, parents array<int>, priors array<byte>, at array<int>, blocks binary")
    found = trees.join(facts, ["h1", "h2"], "left").select("page_id", "url", "keys", "parents", "priors", "at", "blocks", "facts")
    return found.mapInArrow(_texts, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string")


def _facts(of_pages: DataFrame, tree: DataFrame) -> DataFrame:
    """(h1, h2, facts) of each page: the tree's rows for its nodes. A node that more pages have than a task should get
    rows is one of at most as many as there are partitions, so these nodes go to all tasks; the others are shuffled."""
    crowd = max(1000, of_pages.count() // partitions(of_pages.sparkSession))
    hot = F.broadcast(tree.where(F.col("pages") > crowd))
    rest = of_pages.join(hot.select("key"), "key", "left_anti").join(tree.where(F.col("pages") <= crowd), "key")
    return of_pages.join(hot, "key").unionByName(rest).groupBy("h1", "h2").agg(F.collect_set(F.struct("key", "presentation", "styles", "content")).alias("facts"))


def op13_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
