import collections

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import edge
from readaloud.llm import token_counts as C
from readaloud.llm.common import shared_path

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, rows):
    return collections.Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)


def test_counts_and_special_strings(spark, library, monkeypatch):
    monkeypatch.setattr(C, "BATCH_CHARS", 500)
    rows = [*edge.doc_rows(), (3000, "a<|endoftext|>b", "en", "s", 1), (3001, "a<|endoftext|>b", "en", "s", 1)]
    assert collections.Counter(map(tuple, C.count_tokens(edge.frame(spark, rows), PATH).collect())) == want(library, rows)


def test_only_distinct_misses_are_encoded_and_appended(spark, library):
    path = shared_path(spark, "test-cache")
    rows = edge.doc_rows()
    C.count_tokens(edge.frame(spark, rows), PATH, path).collect()
    held = spark.read.parquet(path)
    assert held.count() == len({r[1] or "" for r in rows})
    more = [*rows, (5000, "a new text", "en", "s", 1), (5001, "a new text", "en", "s", 1)]
    assert collections.Counter(map(tuple, C.count_tokens(edge.frame(spark, more), PATH, path).collect())) == want(library, more)
    assert spark.read.parquet(path).count() == len({r[1] or "" for r in rows}) + 1


def test_stored_counts_are_used_and_other_versions_are_not(spark, monkeypatch):
    path = shared_path(spark, "test-cache")
    rows = [(1, "some text", "en", "s", 1)]
    C.count_tokens(edge.frame(spark, rows), PATH, path).collect()
    monkeypatch.setattr(C, "version", lambda p: "another")
    C.count_tokens(edge.frame(spark, rows), PATH, path).collect()
    stored = [r.version for r in spark.read.parquet(path).collect()]
    assert len(stored) == 2 and "another" in stored


def test_a_count_appended_by_two_runs_counts_once(spark, library):
    path = shared_path(spark, "test-cache")
    rows = edge.doc_rows(n=8)
    C.count_tokens(edge.frame(spark, rows), PATH, path).collect()
    twice = spark.createDataFrame(spark.read.parquet(path).collect(), C.CACHE)
    twice.write.mode("append").parquet(path)
    assert collections.Counter(map(tuple, C.count_tokens(edge.frame(spark, rows), PATH, path).collect())) == want(library, rows)


def test_empty_table(spark):
    assert C.count_tokens(edge.frame(spark, []), PATH).collect() == []
