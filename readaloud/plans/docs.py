"""Document queries: cleaning, redaction, speech formatting, sentences, chunks.

``documents.text`` has no URLs, dates, times, abbreviations, blank lines or
markup, so the scalar queries append one fixed sentence carrying all of them
to every document (the same text on the oracle side); without it those
rules would be tested on nothing.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.sentences import sentence_model
from ..operators.sentences import split_sentences as split_learned
from ..operators.chunks import explode_chunks, reassemble, seconds, synthesis_manifest
from ..operators.speech import prepare_speech
from ..sources.fixtures import first_line, voice_by
from ..sources.tables import read_table

INJECT_HEAD = "\n \nDr. Li met Mrs. Roy at 12:30 on 01/02/2024, cats, dogs, etc. see https://h.example.com/"
INJECT_TAIL = " <b>e.g.</b> this vs. that. Pi is 3.14"


def injected(text: Column, doc_id: Column) -> Column:
    return F.concat(text, F.lit(INJECT_HEAD), doc_id.cast("string"), F.lit(INJECT_TAIL))


def doc_title(text: Column, doc_id: Column) -> Column:
    m = doc_id % 3
    return F.when(m == 0, F.lit(None).cast("string")).when(m == 1, F.lit("")).otherwise(first_line(text))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", injected(F.col("text"), F.col("doc_id")).alias("text"),
                    doc_title(F.col("text"), F.col("doc_id")).alias("title"))


def _scalar(fn):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        return docs(spark, sf_dir).select("doc_id", fn(F.col("text")).alias("text"))
    return build


doc_collapse_blank_lines = _scalar(T.collapse_blank_lines)
doc_strip_urls = _scalar(T.strip_urls)
doc_basic_clean = _scalar(T.basic_clean)
doc_expand_abbreviations = _scalar(T.expand_abbreviations)
doc_speak_dates_times = _scalar(lambda c: T.speak_times(T.speak_dates(c)))
doc_insert_pauses = _scalar(lambda c: T.insert_pauses(T.collapse_blank_lines(c)))
doc_clean_content = _scalar(T.clean_content)


def doc_redact_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", T.redact_emails(F.col("text")).alias("text"))


#: Addresses next to each other and near misses, with {k} for the document number, and what redaction must leave.
EDGE_ADDRESSES = (
    ("u{k}@a.com-bob@b.org", "[EMAIL REMOVED][EMAIL REMOVED]"),
    ("x{k}, u@a.co;v@b.co end", "x{k}, [EMAIL REMOVED];[EMAIL REMOVED] end"),
    ("{k}@nodot and @a.b", "{k}@nodot and @a.b"),
    ("a.b-c_{k}@d.e.f_g@h.i", "[EMAIL REMOVED]@h.i"),
)


def doc_redact_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redaction of every text with an edge-case address behind it."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    k = F.col("doc_id")
    edge = F.lit(None).cast("string")
    for i, (given, _) in enumerate(EDGE_ADDRESSES):
        edge = F.when(k % len(EDGE_ADDRESSES) == i, F.replace(F.lit(given), F.lit("{k}"), k.cast("string"))).otherwise(edge)
    return d.select("doc_id", T.redact_emails(F.concat("text", F.lit(" "), edge)).alias("text"))


def doc_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph rows after blank-line collapse, redaction and re-packing."""
    d = docs(spark, sf_dir)
    paras = T.resplit_long_paragraphs(T.paragraphs(T.redact_emails(T.collapse_blank_lines(F.col("text")))))
    out = d.select("doc_id", F.posexplode_outer(paras).alias("para_index", "paragraph"))
    return out.where(F.col("para_index").isNotNull()).select("doc_id", F.col("para_index").cast("bigint").alias("para_index"), "paragraph",
                      F.length("paragraph").cast("bigint").alias("n_chars"))


def processed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as extracted articles through the full speech preparation."""
    d = docs(spark, sf_dir).select("doc_id", "title", T.clean_content(F.col("text")).alias("original_text"),
                                   voice_by(F.col("doc_id")).alias("voice"))
    return prepare_speech(d)


def doc_format_for_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processed_docs(spark, sf_dir).select("doc_id", "processed_text")


def doc_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = processed_docs(spark, sf_dir)
    return p.select("doc_id", "word_count", seconds(F.col("word_count")).alias("est_seconds"))


def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = processed_docs(spark, sf_dir)
    out = p.select("doc_id", F.posexplode_outer(T.split_sentences(F.col("processed_text")))
                   .alias("sentence_index", "sentence"))
    return out.where(F.col("sentence_index").isNotNull()).select("doc_id", F.col("sentence_index").cast("bigint").alias("sentence_index"), "sentence")


def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = processed_docs(spark, sf_dir)
    out = p.select("doc_id", F.posexplode_outer("chunks").alias("chunk_index", "chunk"))
    return out.where(F.col("chunk_index").isNotNull()).select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk",
                      F.length("chunk").cast("bigint").alias("n_chars"))


def doc_chunk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = processed_docs(spark, sf_dir).select(F.size("chunks").cast("bigint").alias("n_chunks"))
    return (p.groupBy("n_chunks").agg(F.count(F.lit(1)).alias("n_docs"))
            .select("n_chunks", (F.col("n_chunks") > 1).alias("is_multipart"), "n_docs"))


def doc_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_chunks(spark, sf_dir)
    return reassemble(rows, "doc_id", text="chunk").select(
        "doc_id", "text", F.col("n_chunks").cast("bigint").alias("n_chunks"))


def chunk_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end second of every chunk on the joined timeline, and the total."""
    p = processed_docs(spark, sf_dir)
    rows = explode_chunks(p, "doc_id", keep=("word_count",))
    return rows.select("doc_id", "chunk_index", "start_offset",
                       (F.col("start_offset") + F.col("est_seconds")).alias("end_offset"),
                       seconds(F.col("word_count")).alias("total_seconds"))


def doc_synthesis_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = processed_docs(spark, sf_dir).withColumnRenamed("doc_id", "content_id")
    return synthesis_manifest(p, valid=F.col("processed_text") != "")


def content_hash_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of url + cleaned text; the URL is the document's feed link."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", F.md5("text").alias("url"),
                    T.content_hash(F.md5("text"), T.clean_content(F.col("text"))).alias("content_hash"))


def content_hash_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes held by more than one row (the unique constraint, as a report)."""
    h = content_hash_q(spark, sf_dir).where(F.col("content_hash").isNotNull())  # a unique column may hold many nulls
    return (h.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_doc_id"))
            .where(F.col("n_rows") > 1))


def _injected_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", injected(F.col("text"), F.col("doc_id")).alias("text"))


def sentence_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations, sentence starters and collocations learned from all documents."""
    d = _injected_docs(spark, sf_dir)
    return sentence_model(d).select("kind", "type", "follower", F.round("score", 4).alias("score"))


def doc_sentences_learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every document by the model learned from all of them."""
    d = _injected_docs(spark, sf_dir)
    out = split_learned(d, sentence_model(d), "doc_id")
    out = out.select("doc_id", F.posexplode_outer("sentences").alias("sentence_index", "s")).where(F.col("sentence_index").isNotNull())
    return out.select("doc_id", F.col("sentence_index").cast("bigint"), F.length("s").cast("bigint").alias("n_chars"), F.md5("s").alias("md5"))
