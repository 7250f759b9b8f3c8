import collections
import hashlib

import public_tokenizers as P

import __spark_entry__ as E
import corpus_pipeline as C
import edge
import test_bpe
import test_decontaminate
import test_line_dedup
import test_ngram_join
from conftest import SF_SMALL
from readaloud.llm import queries
from readaloud.llm.common import stored


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_do_what_their_operators_decide(spark, tmp_path):
    rows = [r for r in edge.doc_rows(n=80) if r[0] is not None]
    bench = [r for r in test_decontaminate.bench_rows(rows) if r[0] is not None and len(edge.words(r[1])) >= 13]
    spark.createDataFrame(bench, test_decontaminate.BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, before = edge.frame(spark, rows, clash=False), rows
    for name, stage in C.STAGES[:4]:
        out = stored(stage(spark, docs, str(tmp_path)), "test-stage")
        assert out.columns == list(C.COLUMNS)
        after = as_rows(out)
        if name == "quality rules":
            verdict = collections.Counter((r.doc_id, r.kept) for r in queries.quality_rules(docs).collect())
            want = [r for r in before if verdict[r[0], True]]
        elif name == "line dedup":
            texts = test_line_dedup.brute([r[:2] for r in before], 20)
            left = sorted((d, t) for (d, t, _, _), n in texts.items() for _ in range(n) if t.strip(" \t\n\x0b\x0c\r"))
            assert sorted((r[0], r[1]) for r in after) == left
            assert all(r[4] == len(r[1]) for r in after)
            want = after
        elif name == "n-gram Jaccard join":
            groups = test_ngram_join.brute([r[:2] for r in before])
            firsts = {d for d, _, c, _ in groups if d == c}
            want = list({r for r in before if r[0] in firsts})
        else:
            dirty = {d for (d, _, _, _, bad), _ in test_decontaminate.brute(before, bench).items() if bad}
            want = [r for r in before if r[0] not in dirty]
            assert dirty
        assert after == sorted(want, key=repr) and len(after) < len(before), name
        docs, before = out, after
    last = C.STAGES[4][1](spark, docs, str(tmp_path))
    c = test_bpe.bpe.codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert as_rows(last) == sorted(((r[0], len(c.encode(r[1])) // 4, hashlib.sha256(c.encode(r[1])).hexdigest(),
                                     hashlib.sha256(r[1].encode()).hexdigest()) for r in before), key=repr)


def test_run_over_the_smallest_tables(spark):
    out = C.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 50 < out.count() < 200


def test_every_operator_is_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in E.queries()
