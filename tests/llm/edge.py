"""Shared fixtures: rows with nulls, empties, repeats and columns whose names clash with the operators' own."""
import random
import re

from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASH = ("key", "row", "words", "lines", "digest", "n", "count", "shard", "base", "component", "gone", "kept", "start")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def doc_rows(seed=7, n=60):
    """Random prose of a small vocabulary with copies, near copies, shared passages, nulls and a long text."""
    rng = random.Random(seed)
    vocab = ["the", "and", "of", "café", "Über", "token", "alpha", "beta", "gamma", "delta", "x1", "42", "re-do", "中文"] + [
        "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(200)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage = [prose(30), prose(25), prose(4)]
    texts = []
    for i in range(n):
        lines = [prose(rng.randint(3, 40)) for _ in range(rng.randint(1, 6))]
        if i % 5 == 0:
            lines[1:1] = passage
        if i % 7 == 0 and texts:
            lines = rng.choice(texts).split("\n")
            if i % 2:
                words = lines[0].split(" ")
                words[len(words) // 2] = "changed"
                lines[0] = " ".join(words)
        if i % 9 == 0:
            lines.append("")
        texts.append("\n".join(lines))
    texts.append(prose(6000))
    rows = [(i, t, "en" if i % 3 else "fr", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(1000, None, "en", None, None), (1001, "", None, "s", 0), (1002, " \t\n ", "en", "s", 4), (1003, "one", "zz", "s", 3),
             (None, prose(50), "en", "s", 1), (None, texts[3 % n], "en", "s", 1), (1004, texts[5 % n], "en", "s", 1),
             (1005, texts[5 % n], "en", "s", 1), (1005, texts[5 % n], "en", "s", 1), (1006, "A\x00b \u0085 c\x1cd " + texts[5 % n], "en", "s", 1)]
    return rows


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    if clash:
        for c in CLASH:
            df = df.withColumn(c, F.lit("clash"))
    return df


def words(text):
    return WORD.findall((text or "").translate(FOLD))
