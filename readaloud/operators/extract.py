"""Main-text extraction from fetched pages.

``structural_extract`` is the element-based pick (boilerplate removed, then
article / main / content-like id / whole document). ``extract_cascade`` runs
the ordered candidate list and keeps the first non-empty one, with the name
of the winning method; block candidates are computed relationally.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import EXTRACT_ERROR
from ..functions.html import (ATTRS, TAG, body_tokens, cleared, first_element, html_to_text, inner_tokens, main_tokens,
                              markup, parsed, text_of, title_of)
from ..functions.regex import let
from ..functions.text import clean_content, collapse_whitespace, strip_ws
from .readability import readable_part


def _main_text(page: Column) -> Column:
    return text_of(main_tokens(page["tokens"], page["nodes"]))


def structural_text(html_col: Column) -> Column:
    return let(parsed(html_col), lambda p: let(cleared(p), lambda c: _main_text(c)))


def body_text(html_col: Column) -> Column:
    """All text of <body> with scripts and styles left out, no cleaning."""
    return let(parsed(html_col), lambda p: text_of(body_tokens(p["tokens"], p["nodes"])))


def structural_extract(pages: DataFrame, key: str = "page_id", extra: list[str] | None = None) -> DataFrame:
    """(key, url, title, raw_text, original_text, error) per page, and the columns named in ``extra``.

    A NULL page (failed fetch) and a page whose cleaned text is empty both
    become error rows; nothing is dropped.
    """
    kept = [key, "url", *(extra or [])]
    # the parsed page is a column of its own: title and text share one evaluation
    out = pages.select(*kept, let(parsed(F.col("html")), lambda p: cleared(p)).alias("_page"))
    out = out.select(*kept, title_of(F.col("_page.tokens"), F.col("_page.nodes")).alias("title"), _main_text(F.col("_page")).alias("raw_text"))
    out = out.withColumn("original_text", clean_content(F.col("raw_text")))
    return out.withColumn(
        "error", F.when(F.coalesce(F.col("original_text"), F.lit("")) == "", F.lit(EXTRACT_ERROR)))


# --- extraction cascade -------------------------------------------------------

BLOCK_START = r"(?i)<(?:p|div|li|h[1-6]|td|br)(?![A-Za-z0-9])" + ATTRS + ">"
ANCHOR = r"(?is)<a(?![A-Za-z0-9])[^>]*>(.*?)</a\s*>"
MIN_BLOCK_CHARS = 25
MIN_RUN_BLOCK_CHARS = 10
MAX_LINK_DENSITY = 0.5
METHODS = ("dense_blocks", "largest_run", "readability", "structural", "body")


def _block_items(stripped: Column) -> Column:
    """Blocks of the page with their text and two keep flags.

    A block runs from one block-level start tag to the next. Its text is the
    whitespace-normalised text content. A dense block has at least
    MIN_BLOCK_CHARS characters, a block of a run MIN_RUN_BLOCK_CHARS, and either
    has less than half of them inside links.
    """
    def item(b):
        t = strip_ws(collapse_whitespace(html_to_text(b)))
        anchor = F.regexp_replace(F.array_join(F.regexp_extract_all(b, F.lit(ANCHOR), 1), ""), TAG, "")
        return let(F.struct(t.alias("t"), anchor.alias("a")), lambda x: let(
            F.length(x["a"]) < F.length(x["t"]) * MAX_LINK_DENSITY, lambda plain: F.struct(
                x["t"].alias("t"), (plain & (F.length(x["t"]) >= MIN_BLOCK_CHARS)).alias("dense"),
                (plain & (F.length(x["t"]) >= MIN_RUN_BLOCK_CHARS)).alias("keep"))))
    return F.transform(F.split(stripped, BLOCK_START, -1), item)


def _dense_text(items: Column) -> Column:
    return F.array_join(F.transform(F.filter(items, lambda x: x["dense"]), lambda x: x["t"]), "\n")


def _largest_run_text(items: Column) -> Column:
    """Text of the contiguous run of kept blocks with the most characters (first on ties)."""
    init = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).cast("bigint").alias("len"),
                    F.lit(0).alias("bstart"), F.lit(0).alias("bcount"), F.lit(0).cast("bigint").alias("blen"))

    def step(s, x):
        i = s["i"] + 1
        start = F.when(x["keep"], F.when(s["len"] == 0, i).otherwise(s["start"])).otherwise(F.lit(0))
        ln = F.when(x["keep"], s["len"] + F.length(x["t"])).otherwise(F.lit(0).cast("bigint"))
        better = ln > s["blen"]
        return F.struct(i.alias("i"), start.alias("start"), ln.alias("len"),
                        F.when(better, start).otherwise(s["bstart"]).alias("bstart"),
                        F.when(better, i - start + 1).otherwise(s["bcount"]).alias("bcount"),
                        F.when(better, ln).otherwise(s["blen"]).alias("blen"))

    st = F.aggregate(items, init, step)
    run = F.when(st["bcount"] > 0, F.slice(items, st["bstart"], st["bcount"]))
    return F.array_join(F.transform(run, lambda x: x["t"]), "\n")


def first_heading(page: Column) -> Column:
    """Text of the first <h1> of a parsed page; null without one or when it is empty."""
    found = first_element(page["nodes"], page["tokens"], "h1")
    text = let(found, lambda n: F.when(n.isNotNull(), text_of(inner_tokens(page["tokens"], n))))
    return let(strip_ws(collapse_whitespace(text)), lambda t: F.when(t != "", t))


def cascade_extract(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Ordered candidates, first non-empty wins; the winner's name is kept.

    Candidates: dense blocks in order, the largest contiguous run of kept
    blocks, the element that holds the paragraphs, the structural pick, and the body text. They stand in one
    ``coalesce``, so a page computes the next candidate only when the one before was empty. The
    title is the document's, except that the run, which often is a page without a
    usable layout, takes its first heading if there is one. A page where all are
    empty becomes an error row.
    """
    c = pages.select(key, "url", parsed(F.col("html")).alias("_raw"))
    c = c.select(key, "url", "_raw", cleared(F.col("_raw")).alias("_page"))
    c = c.select(key, "url", "_raw", "_page", _block_items(markup(F.col("_page.tokens"))).alias("_items"))
    texts = (_dense_text(F.col("_items")), _largest_run_text(F.col("_items")), F.coalesce(readable_part(F.col("_page.tokens"))["text"], F.lit("")), _main_text(F.col("_page")),
             text_of(body_tokens(F.col("_raw.tokens"), F.col("_raw.nodes"))))

    def candidate(text: Column, method: str) -> Column:
        return let(text, lambda x: F.when(x != "", F.struct(F.lit(method).alias("method"), x.alias("text"))))
    best = F.coalesce(*[candidate(t, m) for t, m in zip(texts, METHODS, strict=True)])
    out = c.select(key, "url", "_page", best.alias("_best"))
    own = title_of(F.col("_page.tokens"), F.col("_page.nodes"))
    title = F.when(F.col("_best.method") == METHODS[1], F.coalesce(first_heading(F.col("_page")), own)).otherwise(own)
    out = out.select(key, "url", title.alias("title"), F.col("_best.method").alias("method"), F.col("_best.text").alias("raw_text"))
    out = out.withColumn("original_text", clean_content(F.col("raw_text")))
    return out.withColumn(
        "error", F.when(F.coalesce(F.col("original_text"), F.lit("")) == "", F.lit(EXTRACT_ERROR)))
