"""Registry of named queries: Spark builder and, where expressible, oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..streaming import jobs as streams
from . import (checks, checks_sql, docs, docs_sql, feeds, feeds_sql, jobs, jobs_sql, language, language_sql, pages,
               pages_sql, streaming_sql)

Builder = Callable[[SparkSession, str], DataFrame]

# name -> (spark builder, oracle SQL builder or None)
REGISTRY: dict[str, tuple[Builder, Callable[[], str] | None]] = {
    "page_manifest": (pages.page_manifest, pages_sql.page_manifest),
    "page_edge_cases": (pages.page_edge_cases, pages_sql.page_edge_cases),
    "page_cascade_edge": (pages.page_cascade_edge, pages_sql.page_cascade_edge),
    "page_readability": (pages.page_readability, pages_sql.page_readability),
    "page_manifest_lang": (pages.page_manifest_lang, pages_sql.page_manifest_lang),
    "page_manifest_counts": (pages.page_manifest_counts, pages_sql.page_manifest_counts),
    "page_title": (pages.page_title_q, pages_sql.page_title),
    "page_strip_boilerplate": (pages.page_strip_boilerplate, pages_sql.page_strip_boilerplate),
    "page_main_text": (pages.page_main_text, pages_sql.page_main_text),
    "page_body_text": (pages.page_body_text, pages_sql.page_body_text),
    "page_extract_cascade": (pages.page_extract_cascade, pages_sql.page_extract_cascade),
    "doc_collapse_blank_lines": (docs.doc_collapse_blank_lines, docs_sql.doc_collapse_blank_lines),
    "doc_redact_emails": (docs.doc_redact_emails, docs_sql.doc_redact_emails),
    "doc_redact_edge": (docs.doc_redact_edge, docs_sql.doc_redact_edge),
    "doc_paragraphs": (docs.doc_paragraphs, docs_sql.doc_paragraphs),
    "doc_clean_content": (docs.doc_clean_content, docs_sql.doc_clean_content),
    "content_hash": (docs.content_hash_q, docs_sql.content_hash),
    "content_hash_violations": (docs.content_hash_violations, docs_sql.content_hash_violations),
    "doc_strip_urls": (docs.doc_strip_urls, docs_sql.doc_strip_urls),
    "doc_basic_clean": (docs.doc_basic_clean, docs_sql.doc_basic_clean),
    "doc_expand_abbreviations": (docs.doc_expand_abbreviations, docs_sql.doc_expand_abbreviations),
    "doc_speak_dates_times": (docs.doc_speak_dates_times, docs_sql.doc_speak_dates_times),
    "doc_insert_pauses": (docs.doc_insert_pauses, docs_sql.doc_insert_pauses),
    "doc_format_for_speech": (docs.doc_format_for_speech, docs_sql.doc_format_for_speech),
    "doc_word_count": (docs.doc_word_count, docs_sql.doc_word_count),
    "doc_sentences": (docs.doc_sentences, docs_sql.doc_sentences),
    "sentence_types": (docs.sentence_types, docs_sql.sentence_types),
    "doc_sentences_learned": (docs.doc_sentences_learned, docs_sql.doc_sentences_learned),
    "doc_chunks": (docs.doc_chunks, docs_sql.doc_chunks),
    "doc_chunk_distribution": (docs.doc_chunk_distribution, docs_sql.doc_chunk_distribution),
    "doc_reassemble": (docs.doc_reassemble, docs_sql.doc_reassemble),
    "chunk_timeline": (docs.chunk_timeline, docs_sql.chunk_timeline),
    "synthesis_manifest": (docs.doc_synthesis_manifest, docs_sql.doc_synthesis_manifest),
    "content_status_counts": (jobs.content_status_counts, jobs_sql.content_status_counts),
    "content_next_view": (jobs.content_next_view, jobs_sql.content_next_view),
    "content_downloadable": (jobs.content_downloadable, jobs_sql.content_downloadable),
    "request_cache_web": (jobs.request_cache_web, jobs_sql.request_cache_web),
    "request_cache_api": (jobs.request_cache_api, jobs_sql.request_cache_api),
    "request_admission": (jobs.request_admission, jobs_sql.request_admission),
    "quota_window_counts": (jobs.quota_window_counts, jobs_sql.quota_window_counts),
    "quota_bursts": (jobs.quota_bursts, jobs_sql.quota_bursts),
    "guest_quota": (jobs.guest_quota, jobs_sql.guest_quota),
    "user_conversions": (jobs.user_conversions, jobs_sql.user_conversions),
    "voice_resolve": (jobs.voice_resolve, jobs_sql.voice_resolve),
    "share_links": (jobs.share_links, jobs_sql.share_links),
    "result_card": (jobs.result_card, jobs_sql.result_card),
    "status_json": (jobs.status_json_q, jobs_sql.status_json),
    "web_status": (jobs.web_status, jobs_sql.web_status),
    "output_paths": (jobs.output_paths, jobs_sql.output_paths),
    "job_outcomes": (jobs.job_outcomes, jobs_sql.job_outcomes),
    "content_marks": (jobs.content_marks, jobs_sql.content_marks),
    "content_current": (jobs.content_current, jobs_sql.content_current),
    "request_form": (jobs.request_form, jobs_sql.request_form),
    "request_parse": (jobs.request_parse, jobs_sql.request_parse),
    "url_domain_counts": (jobs.url_domain_counts, jobs_sql.url_domain_counts),
    "url_validate": (jobs.url_validate, jobs_sql.url_validate),
    "content_lookup": (jobs.content_lookup, jobs_sql.content_lookup),
    "user_overview": (jobs.user_overview, jobs_sql.user_overview),
    "feed_top_entries": (feeds.feed_top_entries, feeds_sql.feed_top_entries),
    "feed_due": (feeds.feed_due, feeds_sql.feed_due),
    "feed_new_entries": (feeds.feed_new_entries, feeds_sql.feed_new_entries),
    "feed_refresh_all": (feeds.feed_refresh_all, feeds_sql.feed_refresh_all),
    "feed_refresh_totals": (feeds.feed_refresh_totals, feeds_sql.feed_refresh_totals),
    "feed_refresh_one": (feeds.feed_refresh_one, feeds_sql.feed_refresh_one),
    "feed_add": (feeds.feed_add, feeds_sql.feed_add),
    "feed_metadata_upsert": (feeds.feed_metadata_upsert, feeds_sql.feed_metadata_upsert),
    "feed_error_streak": (feeds.feed_error_streak, feeds_sql.feed_error_streak),
    "feed_status_counts": (feeds.feed_status_counts, feeds_sql.feed_status_counts),
    "feed_toggle": (feeds.feed_toggle, feeds_sql.feed_toggle),
    "feed_delete": (feeds.feed_delete, feeds_sql.feed_delete),
    "feed_listing": (feeds.feed_listing, feeds_sql.feed_listing),
    "feed_content_listing": (feeds.feed_content_listing, feeds_sql.feed_content_listing),
    "feed_wild_entries": (feeds.feed_wild_entries, feeds_sql.feed_wild_entries),
    "feed_updated_at": (feeds.feed_updated_at, feeds_sql.feed_updated_at),
    "feed_xml_entries": (feeds.feed_xml_entries, feeds_sql.feed_xml_entries),
    "feed_rejects": (feeds.feed_rejects, feeds_sql.feed_rejects),
    "feed_subscribe": (feeds.feed_subscribe, feeds_sql.feed_subscribe),
    "fk_orphans": (checks.fk_orphans, checks_sql.fk_orphans),
    "length_violations": (checks.length_violations, checks_sql.length_violations),
    "unique_violations": (checks.unique_violations, checks_sql.unique_violations),
    "null_url": (checks.null_url, checks_sql.null_url),
    "schema_evolve": (checks.schema_evolve, checks_sql.schema_evolve),
    "language_detect": (language.language_detect, language_sql.language_detect),
    "language_accuracy": (language.language_accuracy, language_sql.language_accuracy),
    "stream_dedupe_submissions": (streams.stream_dedupe_submissions, streaming_sql.stream_dedupe_submissions),
    "stream_convert": (streams.stream_convert, pages_sql.page_manifest),
    "stream_fetch_join": (streams.stream_fetch_join, streaming_sql.stream_fetch_join),
    "stream_admission": (streams.stream_admission, streaming_sql.stream_admission),
    "stream_quota_windows": (streams.stream_quota_windows, streaming_sql.stream_quota_windows),
    "stream_attempts": (streams.stream_attempts, streaming_sql.stream_attempts),
    "stream_latest_status": (streams.stream_latest_status, streaming_sql.stream_latest_status),
    "stream_feed_poll": (streams.stream_feed_poll, streaming_sql.stream_feed_poll),
}


def queries() -> dict[str, Builder]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1]() for k, v in REGISTRY.items() if v[1] is not None}
