"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element, and every line gets a weight: its characters, or nothing where most
of them are links. Weights are summed over sliding windows of lines; a text starts where the sum surges and ends where
it dives to nothing, and what lies between is kept, single lines of links too. A block of links or a trailing one is
cut off, in an article too. Markup chooses the lines that take part: those of menus, footers, sidebars, forms, reader
comments and of parts named as adverts, notices and the like weigh nothing and never return; where a page has an
article or main element with text, lines outside it weigh nothing either, and each line inside that is no link is a
surge by itself, so that short paragraphs stay.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A comment, declaration or tag. Quoted attribute values may hold `>`.
#: A value of over 4,096 characters, or a quote without its end, ends with the next angle bracket: no search runs on.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?>(?:\"[^\"]{0,4096}\"|'[^']{0,4096}'|[^'\"<>])*)(?=>|\Z)|[^<>]*)(?:>|\Z|(?=<))",
    re.S,
)
ATTRIBUTE = re.compile(r"(?:\b(?:class|id|role)\s*=\s*)(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
#: Elements without text of their own, elements that start and end a line, elements that never hold the
#: article, words in class, id or role that name such a part, and elements that have no end tag.
HIDDEN = frozenset("script style noscript template textarea select option svg math iframe object head title canvas audio video".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend "
    "li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
ASIDE = frozenset("nav header footer aside form menu dialog button fieldset".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-?bar|header|masthead|footer|comments?|commentlist|disqus|respond|reply|"
    r"cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|related|recommended|share|sharing|social|widget|toolbar|pagination|pager|search|complementary|contentinfo|alert)(?:$|[\s_-])",
    re.I,
)
#: A wrapper's word on what it has or lacks, as in no-sidebar, names no part.
LAYOUT = re.compile(r"(?:(?<=[\s_-])|^)(?:no|has|with|without)[_-]\S*", re.I)
#: Names of parts that hold an article only as a comment or a link. One in another named part is the page's.
APART = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|footer|contentinfo|complementary|comments?|commentlist|disqus|respond|reply|related|recommended)(?:$|[\s_-])"
    r"|^\s*side-?bar\s*$",
    re.I,
)
#: Names of an article's head, which may hold its title.
HEAD = re.compile(r"(?:(?<=[\s_-])|^)(?:header|masthead)(?=$|[\s_-])", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe svg template".split())
#: An end is implied by these starts: an open paragraph ends where a block starts.
CLOSES_P = BLOCKS - {"br", "html", "body"}


#: Kinds of lines: of parts that are never the article, of an article or main element, of neither.
DROPPED, ARTICLE, PLAIN = range(3)


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, weight, kind) of each line: its weight is its characters, or 0 if most of them are links. Time is linear in the page."""
    out: list[tuple[str, int, int]] = []
    line: list[str] = []
    linked = 0
    open_: list[tuple[str, bool, bool, bool, bool, int]] = []  # name, drops its text, named apart, named, is an article, named parts that it resets
    depths: dict[str, list[int]] = {}  # places in open_ of the open elements of a name
    blocks: list[int] = []  # places of the open block elements
    endless: set[str] = set()  # names of raw elements that have no end tag in the rest of the page
    dropped = apart = named = articles = links = 0
    kind = PLAIN

    def end_line() -> None:
        nonlocal linked
        text = " ".join("".join(line).split())
        if text:
            out.append((text, 0 if linked * 2 > len(text) else len(text), kind))
        line.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked, kind
        if not text:
            return
        if not line:
            kind = DROPPED if dropped or apart or named else ARTICLE if articles else PLAIN
        text = html.unescape(text)
        line.append(text)
        if links:
            linked += len(" ".join(text.split()))

    def close(place: int) -> None:
        """Closes the element at this place and all within it."""
        nonlocal dropped, apart, named, articles, links
        while len(open_) > place:
            name, drops, is_apart, by_name, article, reset = open_.pop()
            depths[name].pop()
            if blocks and blocks[-1] == len(open_):
                blocks.pop()
            dropped -= drops
            apart -= is_apart
            named += reset - by_name
            articles -= article
            links -= name == "a"

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                add(page[m.start() + 9 : at].removesuffix("]]>"))
            continue
        if m[1]:
            if name in BLOCKS:
                end_line()
            places = depths.get(name)
            # An inline end tag does not reach out of its block.
            if places and (name in BLOCKS or not blocks or places[-1] > blocks[-1]):
                close(places[-1])
            continue
        if name in BLOCKS:
            end_line()
        if name in RAW:
            stop = None if name in endless else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            if stop is None:
                endless.add(name)
            at = stop.end() if stop else (end if name in ("script", "style", "textarea", "title") else at)
            continue
        if name in VOID:
            continue
        if name in CLOSES_P:
            if blocks and open_[blocks[-1]][0] == "p":
                close(blocks[-1])
        if m[3].rstrip().endswith("/") and name not in BLOCKS:
            continue
        names = [LAYOUT.sub("", v.strip("\"'")) for v in ATTRIBUTE.findall(m[3])] if name not in ("html", "body", "article", "main") else []
        if articles:
            names = [HEAD.sub("", v) for v in names]
        # A header inside the article may hold its title; only a page's own header is dropped.
        aside = name in ASIDE and not (name == "header" and articles)
        drops = name in HIDDEN or aside
        is_apart = any(APART.search(v) for v in names)
        by_name = not is_apart and any(NAMED.search(v) for v in names)
        article = name in ("article", "main") and not dropped and not apart
        # The page's article may lie in a named wrapper; one in a named part of an article is not the page's.
        resets = named if article and (name == "main" or not any(open_[d][4] for d in depths.get("article", []))) else 0
        article = article and named == resets
        depths.setdefault(name, []).append(len(open_))
        if name in BLOCKS:
            blocks.append(len(open_))
        open_.append((name, drops, is_apart, by_name, article, resets))
        dropped += drops
        apart += is_apart
        named += by_name - resets
        articles += article
        links += name == "a"
    end_line()
    return out


def sums_of(weights: list[float], window: int) -> list[float]:
    """The sum of each line's weight and those of the window - 1 lines after it."""
    return [sum(weights[i : i + window]) for i in range(len(weights))]


def stretches(weights: list[float], window: int, least: float) -> list[tuple[int, int]]:
    """Half-open stretches of lines between surge and dive points of the sliding sums.

    A stretch begins at a weighing line, ends after the last one before a whole window of lines without weight, and
    counts if some window in it reaches `least`.
    """
    sums, out, i = sums_of(weights, window), [], 0
    while i < len(weights):
        if not weights[i]:
            i += 1
            continue
        start, peak, last = i, 0, i
        while i < len(weights) and sums[i]:
            peak, last = max(peak, sums[i]), i if weights[i] else last
            i += 1
        if peak >= least:
            out.append((start, last + 1))
    return out


def chosen_lines(lines: list[tuple[str, int, int]], window: int, surge: int) -> list[int]:
    """Numbers of the lines between surge and dive points, from the weights and kinds of lines_of()."""
    own = ARTICLE if any(w for _, w, k in lines if k == ARTICLE) else PLAIN
    weights = [(max(w, surge) if own == ARTICLE and w else w) if k == own else 0 for _, w, k in lines]
    most = max(sums_of(weights, window), default=0)
    # A page without any surge is a short text.
    found = stretches(weights, window, surge if most >= surge else max(1, most // 5))
    return [i for start, stop in found for i in range(start, stop) if lines[i][2] == own]


def main_text(page: str | None, window: int = 3, surge: int = 60) -> str:
    """The chosen lines joined by newlines; empty for a null page or one without text of its own."""
    lines = lines_of(page or "")
    return "\n".join(lines[i][0] for i in chosen_lines(lines, window, surge))


def extract_pages(df: DataFrame, html_col: str = "html", window: int = 3, surge: int = 60) -> DataFrame:
    """All rows and columns of df with `text`, the page's main text, from the whole page.

    A null or empty page gives the empty text. A page of any length is read once from start to end. Repeated rows
    give equal rows. An input column named `text` is replaced. An empty table gives no rows.
    """
    kept = [c for c in df.columns if c.lower() != "text"]
    names = [f"c{i}" for i in range(len(kept))]
    body = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    source = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)], body.alias("page"))

    @F.arrow_udf("string")
    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p, window, surge) for p in pages.to_pylist()], pa.string())

    return source.withColumn("main", extracted("page")).select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], F.col("main").alias("text"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract_pages(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op2_html_extract": op2_html_extract}
ORACLE_SQL: dict[str, str] = {}
