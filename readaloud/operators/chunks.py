"""Chunking, synthesis manifest, timeline and reassembly.

Chunks are produced per document as an array (a fold over its sentences), so
packing never shuffles; offsets are prefix sums over that array before it is
exploded, so the timeline needs no window and no sort either.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DEFAULT_VOICE, MAX_CHUNK_CHARS, SYNTHESIS_MODEL, VOICES, WORDS_PER_MINUTE
from ..functions.regex import let
from ..functions.text import pack_sentences, split_sentences, word_count


def chunk_text(c: Column, limit: int = MAX_CHUNK_CHARS) -> Column:
    """Short text is one chunk; longer text is packed from its sentences.

    A sentence that alone exceeds the limit stays whole as its own chunk.
    """
    return let(c, lambda x: F.when(F.length(x) <= limit, F.array(x))
               .otherwise(pack_sentences(split_sentences(x), limit, strict=False, skip_empty=True)))


def effective_voice(voice: Column) -> Column:
    """Requested voice if it is one of the six, else the default."""
    return F.when(voice.isin(*VOICES), voice).otherwise(F.lit(DEFAULT_VOICE))


def _prefix_sums(xs: Column) -> Column:
    """Exclusive prefix sums of a bigint array (element i = sum of 0..i-1)."""
    init = F.struct(F.array().cast("array<bigint>").alias("acc"), F.lit(0).cast("bigint").alias("s"))
    st = F.aggregate(xs, init, lambda s, x: F.struct(F.array_append(s["acc"], s["s"]).alias("acc"),
                                                     (s["s"] + x).alias("s")))
    return st["acc"]


def _chunk_words(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: word_count(c))


def seconds(words: Column) -> Column:
    return words.cast("double") / F.lit(float(WORDS_PER_MINUTE)) * F.lit(60.0)


def explode_chunks(df: DataFrame, key: str, chunks: str = "chunks",
                   text: str | None = "processed_text", keep: tuple[str, ...] = (),
                   valid: Column | None = None) -> DataFrame:
    """One row per chunk with position, size, words and start offset.

    The outer explode plus a filter keeps the optimizer from inferring a
    non-empty-array filter and pushing the whole text pipeline below the
    scan-side exchange, where it would run twice and on the coarse splits.
    For the same reason rows are excluded by ``valid`` (their chunk list is
    nulled before the explode) rather than by a filter on computed columns.

    When a document has exactly one chunk, the synthesis input is the whole
    processed text (the single-chunk path), otherwise the chunk itself.
    """
    arr_col = F.col(chunks) if valid is None else F.when(valid, F.col(chunks))
    words = df.select("*", arr_col.alias("_c")).drop(chunks).withColumnRenamed("_c", chunks)
    words = words.select("*", _chunk_words(F.col(chunks)).alias("_w"))
    arr = F.arrays_zip(F.col(chunks).alias("chunk"), F.col("_w").alias("w"), _prefix_sums(F.col("_w")).alias("w0"))
    single = F.size(F.col(chunks)) == 1
    out = words.select(F.col(key), *[F.col(k) for k in keep],
                       (single.alias("single")),
                       *([F.col(text).alias("_full")] if text else []),
                       F.posexplode_outer(arr).alias("chunk_index", "c"))
    out = out.where(F.col("chunk_index").isNotNull())
    inp = F.when(F.col("single"), F.col("_full")).otherwise(F.col("c.chunk")) if text else F.col("c.chunk")
    return out.select(
        F.col(key), *[F.col(k) for k in keep],
        F.col("chunk_index").cast("bigint").alias("chunk_index"),
        inp.alias("input"),
        F.length(inp).cast("bigint").alias("n_chars"),
        F.col("c.w").alias("n_words"),
        seconds(F.col("c.w")).alias("est_seconds"),
        seconds(F.col("c.w0")).alias("start_offset"),
    )


def synthesis_manifest(df: DataFrame, key: str = "content_id", voice: str = "voice",
                       valid: Column | None = None) -> DataFrame:
    """Ordered synthesis requests: model, requested and effective voice, input."""
    rows = explode_chunks(df, key, keep=(voice,), valid=valid)
    return rows.select(
        F.col(key), "chunk_index", F.lit(SYNTHESIS_MODEL).alias("model"),
        F.col(voice).alias("voice_requested"), effective_voice(F.col(voice)).alias("voice_effective"),
        "input", "n_chars", "n_words", "est_seconds", "start_offset")


def reassemble(chunk_rows: DataFrame, key: str, index: str = "chunk_index", text: str = "input") -> DataFrame:
    """Join chunk texts back in order, one row per key.

    The ordered concatenation is an aggregate over (index, text) pairs; it is
    the only form that gathers a document's chunks, and a document is bounded
    by its own text size.
    """
    return (chunk_rows.groupBy(key)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index), F.col(text)))),
                                          lambda s: s[text]), " ").alias("text"),
                 F.count(F.lit(1)).alias("n_chunks")))
