import base64
import collections
import glob
import gzip
import hashlib

from pyspark.sql import functions as F

import edge
from readaloud.llm import warc as W
from readaloud.llm.common import shared_path

PAGES = "page_id bigint, url string, html string"


def page_rows(n=200):
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>{i % 60}</p>" * (1 + i % 7)) for i in range(n)]
    rows += [(1000, "http://x/\r\nY: z", "é" * 5000), (1001, None, None), (1002, "http://x/b", ""), (1003, "u", "<p>only</p>"),
             (None, "http://n/", "<p>only</p>"), (None, "http://n/2", "lonely null"), (None, "http://n/3", "lonely null"),
             (2000, "http://d/", "same row"), (2000, "http://d/", "same row"), (2 ** 62, "http://far/", "far away"),
             (-2 ** 62, "http://far/-", "far away")]
    return rows


def want(rows, least=0):
    keeper = {}
    order = lambda p: -2 ** 63 if p is None else p
    for p, _, h in rows:
        b = (h or "").encode()
        keeper[b] = max(keeper.get(b, -2 ** 63), order(p))
    done, out = set(), collections.Counter()
    for p, _, h in rows:
        b = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = order(p) == keeper[b] and b not in done
        if len(b) < least or first:
            done.add(b)
            out[(p, len(b), digest, "response", None)] += 1
        else:
            out[(p, len(b), digest, "revisit", None if keeper[b] == -2 ** 63 else keeper[b])] += 1
    return out


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, PAGES).repartition(parts)
    for c in edge.CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def read(df):
    return collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def test_round_trip(spark):
    rows = page_rows()
    for least in (0, 20):
        folder = shared_path(spark, "test-warc")
        W.write_archive(frame(spark, rows), folder, shard_bytes=20_000, roll_bytes=600, least_revisit=least)
        assert read(W.read_archive(spark, folder)) == want(rows, least)


def test_payloads_and_addresses_come_back(spark):
    rows = [(1, "http://x/\r\nY: z", "é\r\n\r\nWARC/1.1\r\n"), (2, "http://y/", "b")]
    folder = shared_path(spark, "test-warc")
    W.write_archive(frame(spark, rows), folder)
    got = {r.page_id: r for r in W.read_archive(spark, folder).collect()}
    assert bytes(got[1].payload).decode() == rows[0][2] and got[1].url == "http://x/%0D%0AY:%20z"


def test_files_depend_on_rows_only(spark):
    rows, seen = page_rows(), []
    for parts in (1, 5):
        folder = shared_path(spark, "test-warc")
        m = W.write_archive(frame(spark, rows[::-1] if parts == 1 else rows, parts), folder, shard_bytes=20_000, roll_bytes=600)
        seen.append(sorted((r.name, r.records, r.bytes, r.sha256) for r in m.collect()))
    assert seen[0] == seen[1] and len(seen[0]) > 5
    ids = []
    for name, *_ in seen[0]:
        with gzip.open(folder.removeprefix("file:") + "/" + name) as f:
            ids.append([h["x-page-id"] for h, _ in W._records(gzip.compress(f.read())) if "x-page-id" in h])
    flat = [int(x) for part in ids for x in part]
    assert flat == sorted(flat)
    assert all(b <= 600 or n == 1 for _, n, b, _ in seen[0])


def test_nothing_stays_under_a_temporary_name_and_strays_are_ignored(spark):
    folder = shared_path(spark, "test-warc")
    W.write_archive(frame(spark, page_rows(20)), folder)
    local = folder.removeprefix("file:")
    assert not glob.glob(f"{local}/_temporary/*")
    with open(f"{local}/shard-000000-0099.warc.gz", "wb") as f:
        f.write(b"left over")
    assert read(W.read_archive(spark, folder)) == want(page_rows(20))


def test_empty_table(spark):
    assert read(W.write_and_read(frame(spark, []))) == {}
