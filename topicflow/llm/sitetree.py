"""Main text of pages by a site style tree.

The DOMs of one host are merged: elements with the same chain of tags, classes and ids become one node.
Siblings can share it, so a page may have any number of elements of a node, and all of them count.
An element's importance comes from what its node's elements look like on the host's pages:

* content: the text below it, and presentation: the sequence of its children. Both are measured by
  entropy: a feature on ``n`` of the node's ``m`` pages weighs ``1 - log(n) / log(m)``, so what every
  page repeats weighs 0 and what is on one page only weighs 1. ``importance = 0.9 content + 0.1 presentation``,
  the content being the element's own, the presentation the mean over its node.
* Roles fix the importance where HTML states it: articles and main elements have 1, menus, page footers,
  asides and hidden elements 0.
* Words of classes and ids (adverts, sidebars, notices), page headers and forms are only a prior against an
  element. The tree judges it all the same, and what holds half of a page's text stays unless the tree
  drops it. Inside an article, and for reader comments and related pages, the prior decides.
* Nothing drops an article or main element around which it stands. Where a role or readers' words stand
  around one, it is kept only on pages without another one.

Branches under an element with importance below ``floor`` are taken out of every page. Nodes need ``least``
pages of different text before entropy decides, and paragraphs, headings and list items are never judged
by it: a passage that many articles share is content. If a page has an article or main element that
is not in such a branch, only that is kept.

Unimportant elements are joined with the pages' elements, hot ones salted, and then with the pages by id.
The html itself is shuffled only where more of them were found than Spark broadcasts by size.

Defined results: null html is empty and gives an empty text; pages with null or unreadable urls form one
host; rows with equal ids are each extracted; other columns are kept, one named ``main_text`` replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicflow.llm.common import salted_join, stored

TAG = re.compile(
    r"<!--.*?-->|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object select button head".split())
TEXTUAL = frozenset("script style textarea title noscript iframe".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
    "thead tr ul".split()
)
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead pre blockquote figcaption caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
MAIN = frozenset({"article", "main"})
NOISE_TAGS = RAW | frozenset("nav footer aside menu dialog search".split())
PRIOR_TAGS = frozenset({"form"})
PRIOR_ROLES = frozenset({"banner", "form"})
NOISE_ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar sidebars menu "
    "menus nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification "
    "popup modal overlay newsletter subscribe subscription social share sharing related recommended recommendations comment "
    "comments commentlist disqus reply replies respond discussion widget widgets toolbar pagination pager login signup search "
    "copyright skip hidden".split()
)
# noise words around articles that are not the page's own
READER_WORDS = frozenset(
    "related recommended recommendations comment comments commentlist disqus reply replies respond discussion".split()
)
# states of a page, such as no-sidebar and comments-open
STATES = re.compile(r"\b(?:no|without)[-_][a-z]+|\b[a-z]+[-_](?:open|closed)\b", re.IGNORECASE)
HEADER_WORDS = frozenset("header topbar".split())
# an open element of the first kind ends when one of the second begins
ENDS = {
    "p": BLOCKS,
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr"}),
    "th": frozenset({"td", "th", "tr"}),
    "tr": frozenset({"tr"}),
    "option": frozenset({"option"}),
}


def number(*parts: object) -> int:
    """A signed 64-bit hash."""
    value = xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts)))
    return value - (1 << 64) if value >> 63 else value


PRIOR = 0.5


@dataclass
class Element:
    tag: str
    key: str
    path: int
    fixed: float | None  # importance its role gives, if any; PRIOR if it has words against it
    readers: bool  # has words of reader comments or related pages
    article: bool
    judged: bool  # a node of the style tree
    at: int  # blocks before it
    children: list[str] = field(default_factory=list)
    mark: int = 0  # node and content, known when it ends


@dataclass
class Page:
    # text, open nodes, in a main element, that another one has to be preferred to, elements with a prior against it
    blocks: list[tuple[str, tuple[Element, ...], bool, bool, tuple[Element, ...]]] = field(default_factory=list)
    nodes: list[tuple[int, int, int]] = field(default_factory=list)  # path, presentation, path and content


def words_of(value: str) -> list[str]:
    return [w.lower() for w in re.split(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])", value) if w]


def role_of(tag: str, attrs: dict[str, str], in_main: bool, in_article: bool) -> tuple[float | None, bool]:
    """1 for main content, 0 for what never is, PRIOR for words against it, None if the tree has to decide; if it has readers' words."""
    if tag in ("html", "body"):
        return None, False
    names = set(words_of(STATES.sub(" ", f"{attrs.get('class', '')} {attrs.get('id', '')}")))
    role = attrs.get("role", "").lower()
    hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style", ""))
    if tag in NOISE_TAGS or role in NOISE_ROLES or hidden:
        return 0.0, False
    main = tag in MAIN or role in ("main", "article")
    if main and not in_article:
        return 1.0, bool(names & READER_WORDS)
    if names & NOISE_WORDS or tag in PRIOR_TAGS or role in PRIOR_ROLES:
        return PRIOR, bool(names & READER_WORDS)
    if not in_main and (tag == "header" or names & HEADER_WORDS):
        return PRIOR, False
    return 1.0 if main else None, False


def standing(stack: list[Element]) -> tuple[bool, bool, tuple[Element, ...]] | None:
    """If text is in a main element, if another one is preferred, and what stands against it; None for what never is content."""
    in_main = in_article = other = never = False
    against: list[Element] = []
    for e in stack:
        if e.fixed == 1.0:
            other |= never or any(x.readers for x in against)
            in_main, in_article, never = True, in_article or e.article, False
            against.clear()
        elif in_article and e.fixed is not None or e.tag in RAW:
            return None
        elif e.fixed == PRIOR:
            against.append(e)
        elif e.fixed == 0.0:
            never = True
    return None if never else (in_main, other, tuple(against))


def parse(host: str, text: str | None) -> Page:
    """Text blocks in page order with their open elements, and the page's nodes of the style tree."""
    page, text = Page(), text or ""
    stack: list[Element] = []
    words: list[str] = []
    root = number(host)

    def flush() -> None:
        if not words:
            return
        found = standing(stack)
        block = "" if found is None else " ".join("".join(words).split())
        words.clear()
        if block:
            page.blocks.append((block, tuple(e for e in stack if e.judged), *found))

    def close() -> None:
        gone = stack.pop()
        if gone.judged and not any(e.fixed == 0.0 for e in stack):
            below = [b[0] for b in page.blocks[gone.at :]]
            gone.mark = number(gone.path, *below)
            page.nodes.append((gone.path, number(*gone.children), gone.mark))

    at, skip = 0, ""
    for match in TAG.finditer(text):
        if skip:  # inside an element whose content is no markup
            if (match[1] or match[4]) != "/" or (match[2] or match[5]).lower() != skip:
                continue
            skip, at = "", match.start()
        if match.start() > at:
            words.append(entities.unescape(text[at : match.start()]))
        at = match.end()
        name = (match[2] or match[5] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            flush()
        elif name == "br":
            words.append(" ")
        if (match[1] or match[4]) == "/":
            if any(e.tag == name for e in stack):
                if name not in BLOCKS and any(e.tag in BLOCKS for e in stack[max(i for i, e in enumerate(stack) if e.tag == name) :]):
                    continue  # an inline end tag doesn't close blocks
                if name in RAW:
                    flush()
                while stack:
                    last = stack[-1].tag
                    close()
                    if last == name:
                        break
            continue
        if name in VOID:
            continue
        while stack and name in ENDS.get(stack[-1].tag, ()):
            close()
        if name == "body":
            while stack and stack[-1].tag == "head":
                close()
        attrs = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(match[3] or match[6] or "")}
        in_main = any(e.fixed == 1.0 for e in stack)
        fixed, readers = role_of(name, attrs, in_main, any(e.article for e in stack))
        marks = sorted(words_of(f"{attrs.get('class', '')} {attrs.get('id', '')}"))
        judged = fixed in (None, PRIOR) and (bool(marks) or (name in BLOCKS and name not in PLAIN))
        key = ".".join([name, *marks])
        path = number(stack[-1].path if stack else root, key, fixed)
        if name in RAW and not any(e.fixed == 0.0 for e in stack):
            flush()
        if stack:
            seen = stack[-1].children
            if not seen or seen[-1] != key:
                seen.append(key)
        if (match[3] or match[6] or "").endswith("/") and name not in BLOCKS:
            continue
        stack.append(Element(name, key, path, fixed, readers, fixed == 1.0 and "article" in (name, attrs.get("role", "").lower()), judged, len(page.blocks)))
        if name in TEXTUAL:
            skip = name
    if not skip and at < len(text):
        words.append(entities.unescape(text[at:]))
    flush()
    while stack:
        close()
    return page


def main_text(page: Page, low: frozenset[int] | set[int]) -> str:
    """The blocks outside low branches; only those of main elements, if it has any with text."""
    left = [x for x in page.blocks if not any(e.mark in low for e in x[1])]
    share: Counter[int] = Counter()
    for block, _, _, _, against in left:
        share.update({id(e): len(block) for e in against if not e.readers})
    half = sum(len(x[0]) for x in left) / 2
    kept = [x for x in left if all(share[id(e)] and share[id(e)] >= half for e in x[4])]
    sure = [x for x in kept if x[2] and not x[3]]
    return "\n\n".join(x[0] for x in sure or [x for x in kept if x[2]] or kept)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def page_nodes(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """``page, page_text, path, presentation, content, first`` of every page's elements without a role.

    ``content`` is of path and text; of a page's elements of a path, one is the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page_id, host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = parse(host, text)
                own = number(*([b[0] for b in page.blocks if not b[4]] or [b[0] for b in page.blocks]))
                paths: set[int] = set()
                for node in dict.fromkeys(page.nodes):
                    out.append((page_id, own, *node, int(node[0] not in paths)))
                    paths.add(node[0])
            cols = zip(*out, strict=True) if out else [[]] * 6
            names = ["page", "page_text", "path", "presentation", "content", "first"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    narrow = pages.select(F.col(id_col).cast("bigint"), host_of(F.col(url_col)).alias("host"), F.col(html_col))
    return narrow.mapInArrow(run, "page long, page_text long, path long, presentation long, content long, first long")


def style_tree(nodes: DataFrame, least: int = 5) -> DataFrame:
    """``content, importance`` of the elements that several pages repeat. Pages of equal text count once."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.col(c).alias("feature"), F.col("first").alias("first")) for k, c in enumerate(("content", "presentation"))]
    features = nodes.select("path", "page_text", F.explode(F.array(*kinds)).alias("f")).select("path", "page_text", "f.*")
    once = features.groupBy("path", "page_text", "kind", "feature").agg(F.max("first").alias("first"))
    seen = once.groupBy("path", "kind", "feature").agg(F.count("*").alias("n"), F.sum("first").alias("first"))
    seen = seen.withColumn("log", F.log(F.col("n").cast("double")))
    own, shape = F.col("kind") == 0, F.col("kind") == 1
    total = seen.groupBy("path").agg(
        F.sum(F.when(own, F.col("first"))).alias("m"),
        F.sum(F.when(shape, F.col("n"))).alias("k"),
        F.sum(F.when(shape, F.col("n") * F.col("log"))).alias("s"),
    )
    judged = total.where(F.col("m") >= max(2, least)).withColumn("whole", F.log(F.col("m").cast("double")))
    # what is on one page only weighs 1; of the rest, a path has few
    repeated = seen.where(own & (F.col("n") > 1)).select("path", F.col("feature").alias("content"), "log").join(judged, "path")
    weight = lambda log: F.greatest(F.lit(0.0), 1 - log / F.col("whole"))
    return repeated.select("content", (0.9 * weight(F.col("log")) + 0.1 * weight(F.col("s") / F.col("k"))).alias("importance"))


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", floor: float = 0.3, least: int = 5
) -> DataFrame:
    """``pages`` plus ``main_text``."""
    pages = pages.drop("main_text")
    nodes = stored(page_nodes(pages, id_col, url_col, html_col), "page-nodes")
    low = style_tree(nodes, least).where(F.col("importance") < floor).select("content")
    marked = salted_join(nodes.select("page", "content"), low, "content", ["page"], "inner")
    by_page = stored(marked.groupBy(F.col("page").alias("_page")).agg(F.collect_set("content").alias("_low")), "page-branches")
    keyed = pages.withColumn("_host", host_of(F.col(url_col)))
    joined = keyed.join(by_page, F.col(id_col).cast("bigint").eqNullSafe(F.col("_page")), "left").drop("_page")
    names = joined.columns
    host, text, branches = names.index("_host"), names.index(html_col), names.index("_low")
    schema = pages.withColumn("main_text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (host, text, branches)), strict=True)
            found = [main_text(parse(h, t), set(b or ())) for h, t, b in rows]
            keep = [i for i in range(len(names)) if i not in (host, branches)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(found, pa.string())], names=[*(names[i] for i in keep), "main_text"]
            )

    return joined.mapInArrow(run, schema)
