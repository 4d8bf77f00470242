"""Main text of web pages by site style trees.

The pages of one host are merged into a tree of element paths (tag, class, id). For each node of the tree the pages' contents and
the styles of their children are counted: what stands on many pages alike has high entropy over pages, so little importance, and what
differs from page to page has much. Branches of little importance are removed from each page, and so are elements whose
tag, role, class or id says that they are no content. A node that a host shows on too few pages is judged by the tree of all hosts.
A declared article is the page's main text: its branch stays, only what nearly all pages show alike inside it goes.
"""

from __future__ import annotations

import html as entities
import re
import sys

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import column, cut_lineage, map_batches, text_of, utf8_parts

FEW_PAGES = 4  # a node on fewer pages of a host is judged by all hosts' tree
LEAST_IMPORTANCE = 0.5
LEAST_DECLARED = 0.1  # of nodes inside a declared article
STYLE_WEIGHT = 0.1  # of a page's child styles, in blocks of content

# Elements by what HTML says of them, and words in class, id and role that mark what is no content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NOT_CONTENT = frozenset("nav footer aside form button select option optgroup datalist input menu noscript template dialog svg canvas object audio video map".split())
CONTENT = frozenset(("article", "main"))
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "thead": ("thead", "tbody", "tfoot"), "tbody": ("thead", "tbody", "tfoot"), "tfoot": ("thead", "tbody", "tfoot"),
}
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
# Whole class names and ids, and roles, that mark what is no content; what is only doubtful (alert, search, share, related) is left to importance.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense ad-banner ad-slot ad-container sponsored breadcrumb breadcrumbs pagination pager nav navbar navigation"
    " sidebar side-bar footer site-footer page-footer masthead topbar toolbar comment comments comment-list comments-area disqus disqus-thread respond replies"
    " cookie cookies cookie-notice cookie-banner cookie-consent popup pop-up modal overlay newsletter skip-link".split()
)
ROLES = frozenset("navigation complementary contentinfo banner search menu menubar dialog alertdialog tooltip toolbar".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {name: re.compile(rf"</{name}[\s/>]", re.IGNORECASE) for name in RAW}


class Node:
    __slots__ = ("name", "path", "noise", "marked", "content", "styles")

    def __init__(self, name: str, path: str, noise: bool, marked: bool, content: int):
        self.name, self.path, self.noise, self.marked, self.content, self.styles = name, path, noise, marked, content, []


def _is_marked(given: dict[str, str]) -> bool:
    names = f"{given.get('class', '')} {given.get('id', '')}".lower().replace("_", "-").split()
    return not MARKS.isdisjoint(names)


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(text)}


def blocks(page: str) -> tuple[list[tuple[str, str, int, bool]], dict[str, str]]:
    """The page's blocks in order as (path, text, length of the path of the innermost declared article or 0, marked as no content), and the child styles by path."""
    root = Node("", "", False, False, 0)
    stack, found, words, styles = [root], [], [], {}
    at, size = 0, len(page)

    def flush():
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            words.clear()
            if text:
                top = stack[-1]
                found.append((top.path, text, top.content, top.noise or top.marked))

    def close(upto: int):
        while len(stack) > upto:
            node = stack.pop()
            styles.setdefault(node.path, " ".join(node.styles))

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            words.append(page[at:])
            break
        if m.start() > at:
            words.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if ends:
            if name in INLINE and stack[-1].name != name:
                continue
            upto = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), None)
            if name in INLINE and upto is None:
                continue
            flush()
            if upto is not None:
                close(upto)
            continue
        if name == "br":
            words.append(" ")
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/") or name != "iframe":
                end = _RAW_END[name].search(page, at)
                if end is None:
                    at = size
                else:
                    close_at = page.find(">", end.start())
                    at = size if close_at < 0 else close_at + 1
            continue
        given = _attributes(attributes)
        marked = _is_marked(given)
        noise = given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
        if name in VOID or name in INLINE and not noise and not marked:
            if name == "hr":
                flush()
            continue
        flush()
        if name in ("html", "body"):
            continue
        if name not in INLINE:  # a new block ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name not in INLINE:
                    break
        for other in CLOSES.get(name, ()):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in STOPS[name]:
                    break
                if stack[i].name == other:
                    close(i)
                    break
        if attributes.endswith("/") and name not in INLINE and name in ("svg", "path"):
            continue
        top = stack[-1]
        content = name in CONTENT or given.get("role") == "main" or given.get("itemprop") == "articleBody"
        label = name + re.sub(r"[\s\d]+", ".", f".{given.get('class', '')}#{given.get('id', '')}")
        top.styles.append(label if not top.styles or top.styles[-1] != label else "")
        noise = top.noise or noise and not content or name in NOT_CONTENT and name != "form" or name == "head"
        # Names, a form and a header around a declared article do not count in it; those of an article itself and inside it do.
        marked = marked and (not content or name == "article") or name in ("form", "header") and not (name == "header" and top.content) or top.marked and not (content and not top.content)
        path = f"{top.path}/{label}"
        stack.append(Node(name, path, noise, marked, len(path) if content else top.content))
    flush()
    close(0)
    return found, styles


def _key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def host_of(url_col: str):
    """The host in lower case; pages without one share the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(column(url_col).cast("string"), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(rows: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the nodes of each host's tree from rows (host, html); host null: the tree of all hosts.

    A feature of a node is the text of a block, or the styles of its children, on one page. A feature on n of the node's m pages has the
    entropy log n / log m; a node's own importance is one less the mean entropy of its features, styles weighing little, and its importance is
    the mean of its own and its children's, by the weight of their features. Pages of equal html are one page, of a host or of all hosts.
    """

    def features(batch):
        for part in utf8_parts(batch, "html"):
            hosts, paths, keys, kinds, pages = [], [], [], [], []
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                found, styles = blocks(page)
                seen = {(path, _key(text), 1.0) for path, text, _, _ in found} | {(path, _key("style " + s), STYLE_WEIGHT) for path, s in styles.items() if s}
                hosts += [host] * (len(seen) + len(styles))
                paths += [p for p, *_ in seen] + list(styles)
                keys += [k for _, k, _ in seen] + [None] * len(styles)  # no feature: the page has the node
                kinds += [w for *_, w in seen] + [0.0] * len(styles)
                pages += [xxhash.xxh3_128_digest(page)] * (len(seen) + len(styles))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(keys, pa.int64()), pa.array(kinds, pa.float64()), pa.array(pages, pa.binary())], names=["host", "path", "feature", "share", "page"])

    found = cut_lineage(map_batches(rows, features, "host string, path string, feature bigint, share double, page binary"))
    of_host = cut_lineage(found.groupBy("host", "path", "feature", "share").agg(F.count_distinct("page").alias("n")))
    of_all = found.groupBy("path", "feature", "share").agg(F.count_distinct("page").alias("n")).select(F.lit(None).cast("string").alias("host"), "path", "feature", "share", "n")

    def judged(counts: DataFrame) -> DataFrame:
        pages = F.coalesce(F.max(F.when(F.col("feature").isNull(), F.col("n"))), F.lit(0))
        real = F.when(F.col("feature").isNotNull(), F.col("n"))
        nodes = counts.groupBy("host", "path").agg(pages.alias("pages"), F.sum(real * F.col("share")).alias("weight"), F.sum(real * F.col("share") * F.log(real)).alias("log_sum"))
        entropy = F.when(F.col("pages") > 1, F.col("log_sum") / F.col("weight") / F.log("pages")).otherwise(0.0)
        own = nodes.select("host", "path", "pages", "weight", (1 - F.least(F.coalesce(entropy, F.lit(0.0)), F.lit(1.0))).alias("own"))
        # Each node counts for all nodes above it.
        above = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i + 1), "/"))
        spread = own.filter("path <> ''").select("host", F.explode(above).alias("node"), "path", "pages", F.coalesce("weight", F.lit(0)).alias("weight"), "own")
        return spread.groupBy("host", F.col("node").alias("path")).agg(F.max(F.when(F.col("path") == F.col("node"), F.col("pages"))).alias("pages"), (F.sum(F.col("own") * F.col("weight")) / F.greatest(F.sum("weight"), F.lit(1e-9))).alias("importance"))

    return cut_lineage(judged(of_host).unionByName(judged(of_all)))


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, few_pages: int = FEW_PAGES, least: float = LEAST_IMPORTANCE, declared: float = LEAST_DECLARED) -> DataFrame:
    """One row for each row of ``df``: page_id, url, text (blocks of the main text joined by a line feed, empty if none), n_chars.

    Null html counts as empty, a null url or one without a host as the empty host. White space inside a block is
    one space; character references are decoded. Ids may be null or repeated; other columns play no part; no rows give no rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(host_of(url_col).alias("host"), text_of(html_col).alias("html"))
    tree = style_tree(rows)
    everywhere = tree.filter(F.col("host").isNull()).select(F.col("path").alias("any_path"), F.col("importance").alias("any_importance"), F.col("pages").alias("any_pages"))
    judged = tree.filter(F.col("host").isNotNull()).join(everywhere, F.col("path") == F.col("any_path"))
    few = F.coalesce("pages", F.lit(0)) < few_pages
    low = judged.withColumn("importance", F.when(few, F.col("any_importance")).otherwise(F.col("importance"))).withColumn("seen_on", F.when(few, F.col("any_pages")).otherwise(F.col("pages"))).filter(F.col("importance") < least)
    # One list for each host: the branches of its own tree that matter little, and those that go in a declared article too.
    inside = F.when((F.col("importance") < declared) & (F.col("seen_on") >= few_pages), F.col("path"))
    lists = cut_lineage(low.groupBy("host").agg(F.collect_set("path").alias("low"), F.collect_set(inside).alias("inside")).withColumnRenamed("host", "low_host"))

    def extract(batch):
        for part in utf8_parts(batch, "html"):
            texts, last, cut, inner = [], None, frozenset(), frozenset()
            for page, low, inside in zip(part.column(2), part.column(3), part.column(4), strict=True):
                if (low, inside) != last:
                    last, cut, inner = (low, inside), frozenset(low.as_py() or ()), frozenset(inside.as_py() or ())
                texts.append("\n".join(_kept(blocks(page.as_py())[0], cut, inner)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    pages = df.select(column(id_col).alias("page_id"), column(url_col).cast("string").alias("url"), text_of(html_col).alias("html"), host_of(url_col).alias("host"))
    joined = pages.join(lists, F.col("host") == F.col("low_host"), "left").select("page_id", "url", "html", "low", "inside")
    return map_batches(joined, extract, f"page_id {kind}, url string, text string, n_chars bigint")


def _kept(found: list[tuple[str, str, int, bool]], low: frozenset[str], inside: frozenset[str] = frozenset()) -> list[str]:
    declared = any(content and not noise for _, _, content, noise in found)
    if declared:
        return [text for path, text, content, noise in found if content and not noise and not _cut(path, inside, content)]
    return [text for path, text, _, noise in found if not noise and not _cut(path, low)]


def _cut(path: str, low: frozenset[str], upto: int = 0) -> bool:
    if not low:
        return False
    at = len(path)
    while at > upto:
        if path[:at] in low:
            return True
        at = path.rfind("/", 0, at)
    return False


assert sys.version_info >= (3, 11)  # possessive quantifiers
