"""Sinks: the synthesis manifest and status documents as partitioned Parquet / JSON lines.

Writes never overwrite a path that the same plan reads; callers pass a fresh
output folder per run (a new version), as a table's history is kept by path.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..constants import EXTRACT_ERROR, NO_TEXT_ERROR


def write_manifest(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Manifest rows in folders by the voice actually used, sorted within files by job and position.

    Partitioning by voice lets a synthesis worker for one voice read only its
    folder. There is no shuffle by voice (six values would funnel the whole
    manifest through six tasks): every task writes its own file per voice,
    sorted so that each job's chunks are contiguous and in order.
    """
    (manifest.sortWithinPartitions("voice_effective", "content_id", "chunk_index")
     .write.mode(mode).partitionBy("voice_effective").parquet(path))


def write_observed_manifest(jobs: DataFrame, manifest_of: Callable[[DataFrame], DataFrame], path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Write the manifest of ``jobs`` (which have ``error``) and return what the write itself counted.

    Jobs, those rejected and why, manifest rows and their characters are observed as the rows pass, so
    nothing is read a second time: n_jobs, n_no_content, n_no_speech, n_rows, n_chars.
    """
    seen, written = Observation("jobs"), Observation("rows")
    failed = F.col("error")
    observed = jobs.observe(seen, F.count(F.lit(1)).alias("n_jobs"), F.count(F.when(failed == EXTRACT_ERROR, 1)).alias("n_no_content"),
                            F.count(F.when(failed == NO_TEXT_ERROR, 1)).alias("n_no_speech"))
    rows = manifest_of(observed).observe(written, F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("n_chars"), F.lit(0).cast("bigint")).alias("n_chars"))
    write_manifest(rows, path, mode)
    return seen.get | written.get


def write_status_documents(status: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON status document per line (the ``json`` column of ``status_json``)."""
    status.select("json").write.mode(mode).text(path)
