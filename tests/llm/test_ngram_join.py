import collections
import math

import numpy as np
import pytest

import edge
from readaloud.llm import ngram_join as N
from readaloud.llm.components import connected_components


def shingles(t):
    w = edge.WORD.findall((t or "").lower())
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    docs = sorted({(math.inf if d is None else d, t or "") for d, t in rows}, key=lambda x: (x[0], x[1]))
    sets = [shingles(t) for _, t in docs]
    links = collections.defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                links[i].add(j)
                links[j].add(i)
    group = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i, near in links.items():
            low = min([group[i], *(group[j] for j in near)])
            changed |= low != group[i]
            group[i] = low
    out = collections.Counter()
    for i, (d, _) in enumerate(docs):
        copy = min([i, *(j for j in range(i) if sets[j] == sets[i] and sets[i])])
        name = lambda k: None if docs[k][0] == math.inf else docs[k][0]
        out[(name(i), name(copy), name(group[i]), len(links[i]))] += 1
    return out


def test_links_classes_and_copies_against_all_pairs(spark):
    rows = edge.doc_rows(n=90)
    got = collections.Counter((r.doc_id, r.copy_id, r.class_id, r.n_links) for r in N.near_duplicates(edge.frame(spark, rows)).collect())
    assert got == brute([r[:2] for r in rows])


def test_blocks_of_a_large_group_count_every_link(spark, monkeypatch):
    import random
    rng = random.Random(3)
    first = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(70):  # one group of near copies, many of whose members are no links of each other
        words = list(first)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words), "en", "s", 1))
    monkeypatch.setattr(N, "BLOCK_SETS", 16)
    got = collections.Counter((r.doc_id, r.copy_id, r.class_id, r.n_links) for r in N.near_duplicates(edge.frame(spark, rows)).collect())
    assert got == brute([r[:2] for r in rows])


def test_one_leader_a_class(spark):
    rows = N.near_duplicates(edge.frame(spark, edge.doc_rows(n=90))).collect()
    assert sum(r.leads for r in rows) == len({(r.class_id if r.class_id is not None else ("null", r.key) if r.leads else None)
                                              for r in rows} - {None})


def test_band_and_row_counts_reach_the_recall():
    for threshold, recall in ((0.8, 0.9999), (0.7, 0.99), (0.9, 0.999)):
        bands, rows = N.choose_bands(threshold, recall, 128)
        assert 1 - (1 - threshold ** rows) ** bands >= recall and bands * rows <= 128
    with pytest.raises(ValueError):
        N.choose_bands(0.1, 0.9999, 16)


def test_band_hashes_estimate_similarity():
    a, b = N._coefficients(2000)
    rng = np.random.RandomState(1)
    x = rng.randint(0, 2 ** 62, 1000).astype(np.uint64)
    y = np.concatenate([x[:800], rng.randint(0, 2 ** 62, 200).astype(np.uint64)])
    same = (N.band_hashes(x, 2000, 1, a, b) == N.band_hashes(y, 2000, 1, a, b)).mean()
    assert abs(same - 800 / 1200) < 0.05


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{k: 100 for k in range(100, 160)}, 200: 200, 201: 200}


def test_empty_table(spark):
    assert N.near_duplicates(edge.frame(spark, [])).collect() == []
