import collections

import pytest

import edge
from readaloud.llm import decontaminate as D

BENCH = "item_id bigint, text string"


def brute(docs, bench, window=13):
    index, sizes = collections.defaultdict(set), set()
    for item, text in bench:
        w = edge.words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            index[tuple(w[k:k + window])].add(item)
            sizes.add(len(w[k:k + window]))
    out = collections.Counter()
    for r in docs:
        w, hit, items = edge.words(r[1]), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = index.get(tuple(w[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    items |= found
        out[(r[0], len(w), len(hit), tuple(sorted(map(str, items))), bool(hit) and 20 * len(hit) >= len(w))] += 1
    return out


def bench_rows(docs):
    long = edge.words(docs[60][1])
    return [(1, " ".join(edge.words(docs[0][1])[:20]).upper()), (2, " -- ".join(long[100:140])), (3, " ".join(long[100:140])),
            (4, None), (5, ""), (6, "..."), (7, "one"), (8, " ".join(long[500:505])), (10, " ".join(long[5000:5013])), (None, "alpha beta")]


@pytest.mark.parametrize("block", [20_000, 7])
def test_hits_against_plain_python(spark, block):
    rows = edge.doc_rows()
    bench = [r for r in bench_rows(rows) if r[0] is not None]
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in D.contamination(
        edge.frame(spark, rows), spark.createDataFrame(bench, BENCH), block=block).collect())
    assert got == brute(rows, bench)
    assert sum(n for k, n in got.items() if k[4]) > 3


def test_blocks_agree_when_scans_are_split_anew(spark, monkeypatch, tmp_path):
    """Every block scans with another number of partitions, as when executors come and go; no document takes another's hits."""
    rows = edge.doc_rows()
    bench = [r for r in bench_rows(rows) if r[0] is not None]
    edge.frame(spark, rows, clash=False).repartition(12).write.parquet(str(tmp_path / "docs"))
    index, counts = D.positional_index, iter([16, 2, 9, 1, 5, 3] * 20)

    def split_anew(*args):
        n = next(counts)
        spark.conf.set("spark.sql.files.minPartitionNum", str(n))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(4096 * n))
        return index(*args)
    monkeypatch.setattr(D, "positional_index", split_anew)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in D.contamination(
            spark.read.parquet(str(tmp_path / "docs")), spark.createDataFrame(bench, BENCH), block=20).collect())
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == brute(rows, bench)


def test_rows_of_one_long_window_class(spark):
    rows = edge.doc_rows()
    bench = [r for r in bench_rows(rows) if r[1] and len(edge.words(r[1])) >= 13]
    got = collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in D.contamination(
        edge.frame(spark, rows), spark.createDataFrame(bench, BENCH).withColumnRenamed("text", "text")).collect())
    assert got == brute(rows, bench)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zero alpha x beta gamma end"), (2, "alpha beta gamma"), (3, "gamma alpha beta"), (4, "alpha beta"),
                                  (5, "alpha x y z beta gamma")], "doc_id bigint, text string")
    index = D.positional_index(D.numbered_words(docs), _hashes(spark, ["alpha", "beta", "gamma"]), 1)
    windows = spark.createDataFrame([(0, ["alpha", "beta", "gamma"])], "window bigint, words array<string>")
    ids = {r.row: r.doc_id for r in index.collect()}
    near = {s: {ids[r.row] for r in D.proximity_matches(index, windows, s).collect()} for s in (0, 1, 2, 3)}
    assert {ids[r.row] for r in D.phrase_matches(index, windows).collect()} == {2} == near[0]
    # places are counted from the rarest term, gamma
    assert near[1] == near[2] == {1, 2} and near[3] == {1, 2, 3, 5}


def near_brute(docs, bench, slop, window=13):
    """(doc_id, items): every start of every window in every text tried."""
    wins = collections.defaultdict(set)
    for item, text in bench:
        w = edge.words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[k:k + window])].add(str(item))
    out = collections.Counter()
    for r in docs:
        at = collections.defaultdict(list)
        for p, x in enumerate(edge.words(r[1])):
            at[x].append(p)
        items = set()
        for win, named in wins.items():
            fits = [{p - i + d for p in at[x] for d in range(-slop, slop + 1)} for i, x in enumerate(win)]
            if set.intersection(*fits):
                items |= named
        out[(r[0], tuple(sorted(items)))] += 1
    return out


@pytest.mark.parametrize("block", [20_000, 9])
def test_proximity_against_plain_python(spark, block):
    rows = edge.doc_rows()
    bench = [r for r in bench_rows(rows) if r[0] is not None]
    some = edge.words(rows[60][1])
    moved = some[:200] + ["inserted", "inserted"] + some[200:]
    rows += [(2000, " ".join(moved[196:212]), "en", "s", 1), (2001, " ".join(some[190:197] + some[198:206]), "en", "s", 1), (2002, "x " * 40, "en", "s", 1)]
    bench += [(20, " ".join(some[194:207])), (21, " ".join(some[196:209])), (22, "x x x x"), (23, "the of x1 never-seen-word")]
    got = collections.Counter((r.doc_id, tuple(r["near_items"])) for r in D.contamination(
        edge.frame(spark, rows), spark.createDataFrame(bench, BENCH), block=block, slop=2).collect())
    assert got == near_brute(rows, bench, 2)
    by_id = dict(got)
    assert (2000, ("21",)) in by_id and any(k[0] == 2002 and "22" in k[1] for k in by_id)


def _hashes(spark, words):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(w,) for w in words], "w string")
    return [r[0] for r in df.select(F.xxhash64("w")).collect()]


def test_empty_tables(spark):
    none = spark.createDataFrame([], BENCH)
    some = spark.createDataFrame([(1, "a b c")], BENCH)
    assert D.contamination(edge.frame(spark, []), some).collect() == []
    rows = edge.doc_rows(n=5)
    assert all(not r.contaminated and r.n_hit == 0 for r in D.contamination(edge.frame(spark, rows), none).collect())
