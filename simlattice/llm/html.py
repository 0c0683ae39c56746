"""Operator 8: main text of web pages by consensus of the host.

The containers are named by their path of tags with generalised classes
(digits become ``#``). A page's own container is the innermost path that holds
all its article text: the first headline, other headings and blocks of 25
letters on count wherever they stand; shorter text counts below the outermost
container inside ``body``, so that stray words of the frame do not widen it.
Blocks that are mostly links do not count. In Spark every page of a host votes
for its own container and the path with most votes wins. Then every page is
extracted again from the winning path of its host, if all its article text
lies below; otherwise from its own container.

Within a container the elements that hold no article text are left out, by
their tag or by a word of their class, id or role (fixed lists below). A form
or an element with such a word stays if it holds the start of the article
(the first ``main`` or ``article``, else the first ``h1``) and half of the
page's own text: a wrapper may be called ``has-sidebar``. Headers go as the
contract says, that of an article with its headline too.

Pages are parsed by one pass of a pattern, row by row in Arrow batches. Votes
are summed before they are shuffled. Hosts with over a thousandth of all
pages, 1000 at most, are joined by broadcast, so their pages stay where they
are.

Defined cases: null html is empty and gives the empty text; a null url has the
empty host, whose pages vote together; unclosed elements end with the element
around them or the page; repeated rows give repeated results and votes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.llm.hosts import HOT_PART, located
from simlattice.runtime import cut, lookup

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|svg|iframe|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

# Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body div main section td blockquote center html".split())
FRAME = frozenset(("", "html", "body"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, and words of classes, ids and roles, that hold no article text.
LEFT_OUT = frozenset("nav header footer aside form button select dialog menu".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus dialog "
    "footer header masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promotion related "
    "respond share sharing sidebar social sponsor sponsored subscribe subscription widget complementary contentinfo alert".split()
)
IMPLIED = {"li": ("li", ("ul", "ol", "menu")), "td": ("td", ("tr", "table")), "th": ("th", ("tr", "table")), "tr": ("tr", ("table",)), "dd": ("dd", ("dl",)), "dt": ("dt", ("dl",))}


def blocks(page: str) -> tuple[list[tuple], frozenset | None]:
    """Text blocks in page order, and the doubtful elements around the start of the article.

    A block has its text, letters in links, path of its container, whether an
    element around it is left out by its tag, the tag of the block, and the
    numbers of the doubtful elements around it: those with a listed word, and
    forms. The article starts at the first ``main`` or ``article`` (None: at the
    first ``h1``, or nowhere).
    """
    stack = [("", "", False, frozenset())]  # tag, path of its container, left out, doubtful elements
    found: list[tuple] = []
    starts: dict[str, frozenset] = {}
    doubtful = 0
    text: list[str] = []
    linked, in_link = 0, 0

    def flush():
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            letters, linked = linked, 0
            if joined:
                found.append((joined, letters, stack[-1][1], stack[-1][2], stack[-1][0], stack[-1][3]))
        linked = 0

    for token in TOKEN.finditer(page):
        raw, (hidden, end, tag, attributes) = token.group(), token.groups()
        if hidden or raw.startswith(("<!--", "<!", "<?")):
            continue
        if tag is None:
            if raw[:1] == "<" and len(raw) > 1:
                continue
            piece = entities.unescape(raw) if "&" in raw else raw
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if end:
            if tag == "a":
                in_link = 0
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                del stack[depth:]
            continue
        if tag in VOID:
            continue
        if tag == "a":
            in_link = 1
        if tag in BLOCKS:
            close, borders = IMPLIED.get(tag, ("p", ("td", "th", "div", "article", "section", "main", "li", "body", "blockquote")))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == close:
                    del stack[i:]
                    break
                if stack[i][0] in borders:
                    break
            _, path, out, doubts = stack[-1]
            marks = {name.lower(): a or b or c for name, a, b, c in ATTRIBUTE.findall(attributes)} if attributes and "=" in attributes else {}
            if tag in CONTAINERS or tag in LEFT_OUT:
                classes = ".".join(sorted(re.sub(r"\d+", "#", c).replace(">", "") for c in marks.get("class", "").split()))
                path = f"{path}>{tag}.{classes}" if classes else f"{path}>{tag}"
            if not out:
                words = re.findall(r"[a-z]+", " ".join(marks.values()).lower()) if marks else ()
                out = tag in LEFT_OUT and tag != "form"
                if tag == "form" or tag not in ("html", "body", "article", "main") and not LEFT_OUT_WORDS.isdisjoint(words):
                    doubtful += 1
                    doubts = doubts | {doubtful}
                if not out and tag in ("main", "article", "h1"):
                    starts.setdefault("h1" if tag == "h1" else "article", doubts)
            stack.append((tag, path, out, doubts))
    flush()
    return found, starts.get("article", starts.get("h1"))


def kept_blocks(page: str) -> list[tuple]:
    """Blocks outside the elements that hold no article text: text, letters in links, path, tag.

    A doubtful element stays if it holds the start of the article and half of
    the page's own text: then it is a wrapper of the page, whatever its name.
    """
    found, start = blocks(page)
    own = [0 if out else max(0, len(text) - linked) for text, linked, _, out, _, _ in found]
    held: dict[int, int] = {}
    for letters, (*_, doubts) in zip(own, found):
        for d in doubts:
            held[d] = held.get(d, 0) + letters
    total = sum(own)
    wrappers = {d for d, letters in held.items() if 2 * letters >= total > 0 and (start is None or d in start)}
    return [(text, linked, path, tag) for text, linked, path, out, tag, doubts in found if not out and doubts <= wrappers]


def common(paths) -> str:
    """The innermost path around all of ``paths``."""
    parts = [p.split(">") for p in paths]
    low, high = min(parts), max(parts)
    same = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
    return ">".join(low[:same])


def below(path: str, where: str) -> bool:
    return path == where or path.startswith(where + ">")


def container(found: list[tuple]) -> str | None:
    """Innermost path that holds all article text of a page's blocks that are not left out; None if they hold none."""
    full, some = set(), set()
    for text, linked, path, tag in found:
        own = len(text) > 2 * linked
        if own or tag == "h1":
            some.add(path)
            if len(text) >= 25 or tag in HEADINGS:
                full.add(path)
    if not some:
        return None
    at = common(full or some)
    steps = at.split(">")
    inner = next((i for i, step in enumerate(steps) if step.partition(".")[0] not in FRAME), None)
    if inner is None:
        return at
    top = ">".join(steps[: inner + 1])
    return common({p for p in some if below(p, top)})


def extract(page: str, path: str | None) -> str:
    """Text below the container path if it holds all article text of the page, or else below the page's own container."""
    found = kept_blocks(page)
    own = container(found)
    if path and (own is None or below(own, path)):
        kept = [text for text, _, at, *_ in found if below(at, path)]
    else:
        kept = [text for text, _, at, *_ in found if below(at, own or "")]
    return "\n".join(kept or [text for text, *_ in found])


def votes(pages: DataFrame, html: str = "html") -> DataFrame:
    """``host, path, votes``: votes of all pages, one from each for its own container; a page without article text votes for the empty path with 0."""

    def run(batches):
        for batch in batches:
            total: dict[tuple[str, str], float] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = container(kept_blocks(page or ""))
                total[host, path or ""] = total.get((host, path or ""), 0.0) + (path is not None)
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in total], pa.string()), pa.array([p for _, p in total], pa.string()), pa.array(list(total.values()), pa.float64())], ["host", "path", "votes"])

    cast = pages.select("host", html).mapInArrow(run, "host string, path string, votes double")
    return cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page."""
    rows = located(pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))).drop("path")
    ballot = votes(rows)
    # The shorter path wins a tie.
    winner = cut(ballot.groupBy("host").agg(F.max(F.struct(F.col("votes").alias("v"), (-F.length("path")).alias("l"), "path")).alias("best")).select("host", F.col("best.path").alias("path")))
    sizes = cut(rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    total = sizes.agg(F.sum("pages")).first()[0] or 0
    hot = cut(sizes.filter(F.col("pages") * HOT_PART > total).select("host"))
    met = lookup(rows, winner, ["host"], hot).select("id", "url", "html", "path")

    def run(batches):
        for batch in batches:
            texts = [extract(page or "", path) for page, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    return met.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", key)


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
