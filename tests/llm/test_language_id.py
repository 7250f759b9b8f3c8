import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import readaloud.llm.language_id as L
from conftest import SF_MID
from edge import DOCS, frame
from readaloud.llm.language_id import Model, Universe, fit, held_out, identify, language_id, scores
from readaloud.llm.queries import QUERIES


def spoken(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    kinds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "er"], "cc": ["ñ", "é", "ça"], "dd": ["ко", "ми", "ло"]}
    return [(i, spoken(rng, kinds[lang], rng.randint(8, 60)), lang, "s", 1) for i, lang in ((i, list(kinds)[i % 4]) for i in range(n))]


def grams(text):
    """The n-grams as strings: ASCII that is no letter is one space per run."""
    kept = "".join(c if c.isascii() and c.isalpha() or not c.isascii() else " " for c in f" {text.lower()} ")
    while "  " in kept:
        kept = kept.replace("  ", " ")
    return {kept[i:i + n] for n in range(1, 5) for i in range(len(kept) - n + 1)}


def test_scores_equal_the_kernel_written_out():
    """Presence kernels on sets of strings, every sample row a landmark, ridge regression in its dual form of the same features."""
    rows = [(r[2], r[1]) for r in corpus(40)]
    model = fit(rows)
    rows = sorted(rows)
    universe = Universe.of(model.hashes)
    known = {g for _, t in rows for g in grams(t)}
    assert len(model.hashes) <= len(known) <= len(model.hashes) + 5
    sets = [grams(t) for _, t in rows]
    cos = lambda a, b: len(a & b & known) / np.sqrt(max(len(a & known), 1) * max(len(b & known), 1))
    kernel = np.array([[cos(a, b) for b in sets] for a in sets])
    targets = np.array([[1.0 if lang == x else -1.0 for x in model.labels] for lang, _ in rows])
    dual = np.linalg.solve(kernel + L.RIDGE * len(rows) * np.eye(len(rows)), targets)
    asked = ["kalomi loka", "schung erung!", "çañé", "коми", "12 zz", "КОМИ Ка"]
    want = np.array([[cos(grams(t), s) for s in sets] for t in asked]) @ dual
    assert np.abs(scores(model, universe, asked) - want).max() < 0.01
    one = np.vstack([scores(model, universe, [t]) for t in asked])
    assert (one == scores(model, universe, asked)).all()


@pytest.fixture(scope="module")
def predicted(spark):
    rows = corpus() + [(900, None, "aa", "s", 1), (901, "", None, "s", 1), (902, "12 -- 34 ²", "bb", "s", 1), (903, "ко ко", None, None, None),
                       (None, "ung er sch ung", "bb", "s", 1), (904, "\U0001F600", "aa", "s", 1), (1, corpus()[1][1], "bb", "s", 1)]
    df = language_id(frame(spark, rows))
    assert df.columns == ["doc_id", "held_out", "lang_pred", "score"]
    return rows, df.collect()


def test_rows_held_out_rule_and_unknown(predicted):
    rows, got = predicted
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in rows)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (900, 901, 902, 904)} == dict.fromkeys((900, 901, 902, 904), ("und", 0.0))
    assert {r.lang_pred for r in got} == {"aa", "bb", "cc", "dd", "und"} and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (903, None)} == {"dd", "bb"}


def test_held_out_accuracy(predicted):
    rows, got = predicted
    truth = {r[0]: r[2] for r in rows[:120]}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 15 and all(r.lang_pred == truth[r.doc_id] for r in held)


def test_labels_of_held_out_rows_are_not_learned(spark):
    """Wrong labels on the held-out rows change nothing; nor do languages only they have."""
    df = spark.createDataFrame(corpus(), DOCS)
    wrong = df.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    assert sorted(language_id(df).collect()) == sorted(language_id(wrong).collect())


@pytest.mark.parametrize("rows", [[], [(1, "some words", None, "s", 1)], [(1, None, "en", "s", 1)]])
def test_nothing_to_learn(spark, rows):
    assert [(r.lang_pred, r.score) for r in language_id(spark.createDataFrame(rows, DOCS)).collect()] == [("und", 0.0)] * len(rows)


def test_long_texts_are_read_whole(spark):
    model = fit([(r[2], r[1]) for r in corpus(40)])
    text = "kalo " * 400_000 + "schungerung"
    assert set(Universe.of(model.hashes).present(text)) == set(Universe.of(model.hashes).present("kalo kalo schungerung"))
    df = spark.createDataFrame([(1, text, None, None, 1)], DOCS)
    # the last word tips the scales
    assert identify(df, model).first()["lang_pred"] == "bb"
    assert identify(df.withColumn("text", F.lit("kalo " * 10)), model).first()["lang_pred"] == "aa"
    assert identify(df, Model([], np.zeros(0, np.uint64), np.zeros((0, 0)))).first()["lang_pred"] == "und"


def test_query_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang", "text")
    got = QUERIES["op12_language_id"](spark, SF_MID).join(docs, "doc_id").where("held_out and lang_pred <> 'und'")
    right = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
