import collections
import difflib
import math
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

import edge
from readaloud.llm import line_dedup as L


def brute(rows, least):
    docs = sorted({(math.inf if d is None else d, t) for d, t in rows}, key=lambda x: (x[0], x[1] or ""))
    first, seen, out = {}, {}, collections.Counter()
    for n, (d, t) in enumerate(docs):
        lines = [(s.strip(" \t\n\x0b\x0c\r"), i) for i, s in enumerate((t or "").split("\n"))]
        lines = [x for x in lines if x[0]]
        seq = seen[n] = [s for s, _ in lines]
        partners = {first.setdefault(m, n) for m in [*seq, *zip(seq, seq[1:])]} - {n}
        counts = [len(re.findall(r"[^\x20\x09-\x0D]+", s)) for s in seq]
        gone = {lines[i][1] for p in partners for i in L.common_blocks(seen[p], seq, counts, least)}
        left = None if t is None else "\n".join(s for i, s in enumerate(t.split("\n")) if i not in gone)
        out[(None if d == math.inf else d, t)] = (left, len(seq), len(gone))
    return collections.Counter((d, *out[d, t]) for d, t in rows)


def test_against_all_earlier_holders(spark):
    # texts under a null doc_id are ordered by a digest, so only one of them is used here
    rows = [r for r in edge.doc_rows() if r[0] is not None] + [(None, "a line of its own", "en", "s", 1)]
    got = collections.Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(edge.frame(spark, rows), 20).collect())
    assert got == brute([r[:2] for r in rows], 20)
    assert sum(n for (_, _, _, gone), n in got.items() if gone) > 10


def test_other_columns_come_through(spark):
    df = edge.frame(spark, edge.doc_rows(n=12))
    out = L.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert {r.gone for r in out.collect()} == {"clash"}
    again = L.dedup_lines(out)
    assert again.columns == out.columns


def test_short_shared_lines_and_first_holders_stay(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"All rights reserved.\n{long}\nend", "en", "s", 1), (2, f"All rights reserved.\nother\n{long}", "en", "s", 1), (3, long, "en", "s", 1)]
    got = {r.doc_id: r.text for r in L.dedup_lines(edge.frame(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "All rights reserved.\nother", 3: ""}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = L.patience(a, b)
    assert all(a[p] == b[q] for p, q in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    ends = 0
    while ends < min(len(a), len(b)) and a[ends] == b[ends]:
        ends += 1
    assert len(pairs) >= ends


def test_alignment_of_unique_lines_is_the_longest():
    a, b = list("abcdefgh"), list("axcdbefzh")
    best = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
    assert len(L.patience(a, b)) == best == 6


def every_earlier(rows, least):
    """Line numbers that each text loses when every run of lines is looked up in every earlier text."""
    texts = [t.split("\n") for _, t in rows]
    for n, later in enumerate(texts):
        gone = set()
        for s in range(len(later)):
            for e in range(s + 1, len(later) + 1):
                if sum(len(x.split()) for x in later[s:e]) >= least and any(
                        later[s:e] == a[i:i + e - s] for a in texts[:n] for i in range(len(a) - (e - s) + 1)):
                    gone.update(range(s, e))
        yield rows[n][0], "\n".join(x for i, x in enumerate(later) if i not in gone), len(gone)


def test_repeated_moved_and_piecewise_passages_go(spark):
    p, q = ["p one a b c d e f", "p two a b c d e f", "p three a b c d e"], ["q one a b c d e f", "q two a b c d e f", "q three a b c d e"]
    texts = [["x", *p, "y", *p, "z"], ["u", *p, "v"], ["w", *p, "m", *p],  # held twice by the first, by the later one
             ["k", *q, "l", "middle"], ["middle", "j", *q, "k"],  # q crosses the unique lines
             ["r a b c d e f g", "s a b c d e f g"], ["s a b c d e f g", "t a b c d e f g"],
             ["r a b c d e f g", "s a b c d e f g", "t a b c d e f g"], ["0", "r a b c d e f g", "s a b c d e f g", "t a b c d e f g"]]
    rng = random.Random(3)
    for _ in range(60):  # few different lines, so that nearly all repeat and cross
        texts.append([f"{c} " * rng.choice([3, 5, 9]) + "." for c in rng.choices("abcd", k=rng.randint(1, 12))])
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    got = {(r.doc_id, r.text, r.n_removed) for r in L.dedup_lines(edge.frame(spark, [(i, t, "en", "s", 1) for i, t in rows]), 20).collect()}
    assert got == set(every_earlier(rows, 20))
    assert {(1, "u\nv", 3), (2, "w\nm", 6), (4, "middle\nj\nk", 3), (8, "0", 3)} <= got


def test_empty_table(spark):
    assert L.dedup_lines(edge.frame(spark, [])).collect() == []
