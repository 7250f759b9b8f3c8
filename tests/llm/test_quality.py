import collections
import math
import random
import re

import edge
from readaloud.llm import quality as Q


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
    lines = [s for s in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_base_measures_against_plain_python(spark):
    rows = edge.doc_rows()
    rows += [(2000, "a b c d e " * 9, "en", "s", 1), (2001, "l one\nl one\nl one\n\n\n", "en", "s", 1), (2002, "#*$ %&| <>" * 5, "en", "s", 1)]
    got = sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[2:8]) for r in Q.quality_rules(edge.frame(spark, rows)).collect())
    assert got == sorted((r[0] is None, r[0] or 0, *base(r[1])) for r in rows)


def test_divergent_text_is_rejected_and_short_or_clean_text_is_not(spark):
    rows = [r for r in edge.doc_rows(n=80) if r[1]]
    odd = " ".join(f"{i}###$$$%%%" for i in range(300))
    got = {r.doc_id: r for r in Q.quality_rules(edge.frame(spark, [*rows, (3000, odd, "en", "s", 1), (3001, "### " * 9, "en", "s", 1)])).collect()}
    assert not got[3000].kept and got[3000].class_distance > 0.5 and not got[3000].base_failed
    assert got[3001].class_distance is None
    assert all(got[r[0]].kept for r in rows if r[0] is not None and r[0] < 80 and not got[r[0]].base_failed)


def test_a_small_language_is_judged_by_its_own_reference(spark):
    rng = random.Random(5)
    text = lambda letters, n: " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))
    latin = [(i, text("abcdefghijklmnop", 3000), "en", "s", 1) for i in range(700)]
    greek = [(1000 + i, text("αβγδεζηθικλμνξοπ", 150), "el", "s", 1) for i in range(10)]
    odd = [(2000, " ".join(f"{i}###$$$%%%" for i in range(150)), "el", "s", 1)]
    alone = [(3000, text("абвгдежзиклмно", 150), "bg", "s", 1)]  # too few words for a reference
    assert sum(len(r[1].split()) for r in [*greek, *odd]) * 1000 < sum(len(r[1].split()) for r in latin)
    got = {r.doc_id: r for r in Q.quality_rules(edge.frame(spark, [*latin, *greek, *odd, *alone])).where("doc_id >= 1000").collect()}
    assert all(got[r[0]].kept and got[r[0]].class_distance < 0.3 for r in greek)
    assert not got[2000].kept and got[2000].class_distance > 0.5
    assert got[3000].kept and got[3000].class_distance is None and got[3000].word_distance is None


def test_common_words_are_each_language_s_own_and_of_any_length(spark):
    rng = random.Random(6)
    words = {f"l{n}": [f"{'abcdefghij'[i % 10] * (4 + i // 10)}{n:02}" for i in range(80)] for n in range(25)}  # 6 letters and more
    rows = [(n * 100 + d, " ".join(rng.choices(words[f"l{n}"], weights=range(80, 0, -1), k=200)), f"l{n}", "s", 1) for n in range(25) for d in range(12)]
    lists = {r.lang: r.common_words for r in Q.common_words(edge.frame(spark, [*rows, (-1, None, None, "s", 1), (-2, "x y y z z z", None, "s", 1)])).collect()}
    hashed = {r.h: r.w for r in spark.createDataFrame([(w,) for ws in [*words.values(), ["x", "y", "z"]] for w in ws], "w string").selectExpr("w", "xxhash64(w) h").collect()}
    assert {hashed[h] for h in lists[""]} == {"x", "y", "z"}
    for lang, own in words.items():
        held = collections.Counter(w for r in rows if r[2] == lang for w in set(r[1].split()))
        assert [held[hashed[h]] for h in lists[lang]] == sorted((held[w] for w in own), reverse=True)[:64]
    odd = [(5000 + n, " ".join(words[f"l{n}"][-1] + f"{i:05}" for i in range(200)), f"l{n}", "s", 1) for n in range(3)]
    got = {r.doc_id: r for r in Q.quality_rules(edge.frame(spark, rows + odd)).collect()}
    assert all(got[r[0]].kept for r in rows)
    assert not any(got[r[0]].kept for r in odd) and all(got[r[0]].word_distance > 0.5 for r in odd)


def test_distance_against_the_formula(spark):
    from pyspark.sql import functions as F
    pairs = [([1, 2, 3], [3, 2, 1]), ([5, 0, 0], [0, 5, 0]), ([2, 2], [4, 4]), ([0, 0], [1, 1])]
    df = spark.createDataFrame([(i, p, q) for i, (p, q) in enumerate(pairs)], "i int, p array<bigint>, q array<bigint>")
    got = [r.d for r in df.select("i", Q.js_distance(F.col("p"), F.col("q")).alias("d")).orderBy("i").collect()]

    def js(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        side = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x)
        return math.sqrt((side(p, q) + side(q, p)) / 2)
    assert got[3] is None
    assert all(abs(g - js(p, q)) < 1e-9 for g, (p, q) in zip(got[:3], pairs))


def test_empty_table(spark):
    assert Q.quality_rules(edge.frame(spark, [])).collect() == []
