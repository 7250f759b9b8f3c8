"""Page queries: extraction, title, boilerplate, body text, manifest."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.html import cleared, drop_elements, parsed, title_of
from ..functions.regex import let
from ..operators.chunks import synthesis_manifest
from ..operators.extract import body_text, cascade_extract, structural_extract, structural_text
from ..operators.language import detect
from ..operators.readability import readable_part
from ..operators.speech import prepare_speech, with_synthesis_error
from ..session import ensure_checkpoint_dir
from ..sources.fixtures import voice_by
from ..sources.sinks import write_observed_manifest
from ..sources.tables import read_table
from .language import trained_on_documents


def _pages(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", *cols)


def page_jobs(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame:
    """Pages (those with a ``page_id`` in ``ids``, if given) through extraction and speech preparation."""
    pages = _pages(spark, sf_dir, "page_id", "url", "html")
    if ids is not None:  # before the text work, which then runs on these pages only
        pages = pages.join(ids.select("page_id"), "page_id", "left_semi")
    ext = structural_extract(pages)
    jobs = ext.select(F.col("page_id").alias("content_id"), "url", "title", "original_text", "error",
                      voice_by(F.col("page_id")).alias("voice"))
    return with_synthesis_error(prepare_speech(jobs))


def page_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered synthesis manifest for every page that yields text."""
    jobs = page_jobs(spark, sf_dir)
    return synthesis_manifest(jobs, valid=F.col("error").isNull())


def page_manifest_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest with the language of each page's text, by the model trained on the labelled documents.

    The prepared text feeds both the manifest and the detection, so it is computed once and kept in the shared checkpoint folder.
    """
    ext = structural_extract(_pages(spark, sf_dir, "page_id", "url", "html"))
    jobs = ext.select(F.col("page_id").alias("content_id"), "url", "title", "original_text", "error", voice_by(F.col("page_id")).alias("voice"))
    ready = with_synthesis_error(prepare_speech(jobs, keep_clean=True)).checkpoint()
    spoken = detect(ready.select("content_id", "clean_text"), trained_on_documents(spark, sf_dir), key="content_id", text="clean_text")
    manifest = synthesis_manifest(ready, valid=F.col("error").isNull())
    return manifest.join(spoken.withColumnRenamed("detected", "lang"), "content_id").select("content_id", "chunk_index", "lang", "voice_effective", "n_chars", "est_seconds")


def page_manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What writing the manifest counted: jobs, rejects by reason, rows and characters. Every ninth page comes without markup."""
    pages = _pages(spark, sf_dir, "page_id", "url", "html").withColumn("html", F.when(F.col("page_id") % 9 != 0, F.col("html")).otherwise("<nav>n</nav>"))
    ext = structural_extract(pages).select(F.col("page_id").alias("content_id"), "url", "title", "original_text", "error", voice_by(F.col("page_id")).alias("voice"))
    folder = os.path.join(ensure_checkpoint_dir(spark), "readaloud-manifests", uuid.uuid4().hex)
    counted = write_observed_manifest(with_synthesis_error(prepare_speech(ext)), lambda j: synthesis_manifest(j, valid=F.col("error").isNull()), folder)
    return spark.range(1).select(*[F.lit(v).cast("bigint").alias(k) for k, v in sorted(counted.items())])


def page_title_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir, "page_id", "html")
    return p.select("page_id", let(parsed(F.col("html")), lambda x: let(cleared(x), lambda y: title_of(y["tokens"], y["nodes"]))).alias("title"))


def page_strip_boilerplate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir, "page_id", "html")
    s = drop_elements(F.col("html"))
    return p.select("page_id", F.length(s).cast("bigint").alias("n_chars"), F.md5(s).alias("md5"))


def page_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir, "page_id", "html")
    return p.select("page_id", structural_text(F.col("html")).alias("main_text"))


def page_body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pages(spark, sf_dir, "page_id", "html")
    return p.select("page_id", body_text(F.col("html")).alias("body_text"))


def page_extract_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cascade_extract(_pages(spark, sf_dir, "page_id", "url", "html"))


def page_readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The element that holds each page's paragraphs, its score and its text."""
    p = _pages(spark, sf_dir, "page_id", "html").select("page_id", let(parsed(F.col("html")), lambda x: cleared(x)["tokens"]).alias("tokens"))
    best = p.select("page_id", readable_part(F.col("tokens")).alias("best"))
    return best.select("page_id", F.col("best.name").alias("element"), F.round("best.score", 6).alias("score"), F.md5("best.text").alias("text_md5"))


#: Markup whose branches the stored pages don't reach, with {k} for the page number, and the main text it must give.
EDGE_PAGES = (
    ("<!-- <nav> --><p>keep {k}</p><nav>x</nav>", "keep {k}"),
    ("<!-- <article> --><main>M{k}</main><p>out</p>", "M{k}"),
    ("<nav>a<nav>b</nav>c</nav><p>t{k}</p>", "t{k}"),
    ("<div><nav>menu</div><p>t{k}</p>", "t{k}"),
    ('<body><div id="main-content"><div>in {k}</div>x</div><p>out</p></body>', "in {k}\nx"),
    ("<p>a{k}</p><header><div>h</div></header>b", "a{k}\nb"),
    ("<article><nav>n<ul><li>q</nav><p>A{k}</p><article>B</article>C</article>D", "A{k}\nB\nC"),
    ("<p>&#000000065;{k}&#x110000;&#x000000041;</p>", "A{k}\ufffdA"),
    ('<p title="a > b <nav>">t{k}</p><nav>q</nav>', "t{k}"),
    ("<p>a\x02b\x03c{k}</p>\x03", "a\x02b\x03c{k}\n\x03"),
    ('<article><a title="</article>">x{k}</a>y</article>z', "x{k}\ny"),
    ("<div id='content'><img alt='<div>'/>in {k}</div>out", "in {k}"),
    ("<div><article>A{k}<aside>s</div>B<article>C</article>", "A{k}"),
    ("a < b{k} <p>c</p>", "a < b{k} \nc"),
)


def page_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page's number set in edge-case markup, followed by the page's own main text."""
    p = _pages(spark, sf_dir, "page_id", "html")
    k = F.col("page_id")
    edge = F.lit(None).cast("string")
    for i, (markup, _) in enumerate(EDGE_PAGES):
        edge = F.when(k % len(EDGE_PAGES) == i, F.replace(F.lit(markup), F.lit("{k}"), k.cast("string"))).otherwise(edge)
    return p.select("page_id", structural_text(edge).alias("edge_text"), structural_text(F.col("html")).alias("main_text"))


#: One page per method of the cascade and one that all fail on: markup, winning method, title and text.
CASCADE_PAGES = (
    ("<title>T{k}</title><p>This paragraph is long enough to be dense: {k}", "dense_blocks", "T{k}", "This paragraph is long enough to be dense: {k}"),
    ("<title>T{k}</title><h1>Head {k}</h1><p>short para {k}</p><p>second one {k}</p>", "largest_run", "Head {k}", "short para {k}\nsecond one {k}"),
    # paragraphs in pieces too short for a block; the deeper element has more of them, links take the score of the third
    ("<title>T{k}</title><div><div id='teaser'><p>a b<br>of<br>{k} e<br>f gh i<br>no more</p></div><div id='story'>"
     "<p>It is<br>{k},<br>then,<br>later,<br>at last,<br>an end.</p><p>Or <br>not<br>{k},<br>who <br>is to<br> know,<br>now.</p></div>"
     "<table><tr><td><a href=x>one {k}<br>two two<br>three<br>four four</a></td></tr></table></div>",
     "readability", "T{k}", "It is\n{k},\nthen,\nlater,\nat last,\nan end.\nOr \nnot\n{k},\nwho \nis to\n know,\nnow."),
    ("<title>T{k}</title><article><p>tiny</p></article>", "structural", "T{k}", "tiny"),
    ("<body><nav>menu {k}</nav></body>", "body", None, "menu {k}"),
    ("<body><script>x{k}</script></body>", None, None, None),
)


def page_cascade_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cascade on pages that reach each of its methods, numbered and addressed as the stored pages."""
    p = _pages(spark, sf_dir, "page_id", "url")
    k = F.col("page_id")
    markup = F.lit(None).cast("string")
    for i, (page, *_) in enumerate(CASCADE_PAGES):
        markup = F.when(k % len(CASCADE_PAGES) == i, F.replace(F.lit(page), F.lit("{k}"), k.cast("string"))).otherwise(markup)
    return cascade_extract(p.withColumn("html", markup)).select("page_id", "url", "title", "method", "raw_text", "error")
