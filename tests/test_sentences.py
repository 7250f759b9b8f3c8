"""The learned splitter: what it learns, what it takes back, and both ways of applying a model."""
import random
import time

import pytest
from pyspark.sql import functions as F

from readaloud.operators import sentences
from readaloud.operators.sentences import sentence_model, split_sentences


def prose(seed=2, n=400):
    """Sentences in which titles carry a period always, other words at a sentence's end only."""
    rng = random.Random(seed)
    people = ["Smith", "Jones", "Brown", "Adams", "Clark"]
    words = "walked stayed town river early morning garden house again slowly letter street".split()
    out = []
    for _ in range(n):
        who = f"{rng.choice(['Dr.', 'Mrs.', 'Prof.'])} {rng.choice(people)}"
        body = " ".join(rng.choice(words) for _ in range(rng.randint(3, 9)))
        out.append(rng.choice([f"{who} {body}.", f"The {body} near {who}.", f"They {body}!", f"On 3. March the {body}.", f"The {body} {rng.choice(people)}."]))
    return [" ".join(out[i:i + 20]) for i in range(0, n, 20)]


@pytest.fixture(scope="module")
def model(spark):
    return sentence_model(spark.createDataFrame([(t,) for t in prose()] + [(None,), ("",)], "text string")).checkpoint()


TEXTS = [(1, "Dr. Smith arrived. The town slept."), (2, "It rained near Dr. The river rose."), (3, "On 3. March they left. They walked."),
         (4, "No marks at all"), (5, ""), (6, None), (None, "He saw Mrs.  Jones! Really?\nThe end."), (6, "(Prof. Brown) stayed.  They left."), (7, " . ! ? ")]
SPLIT = [["Dr. Smith arrived.", "The town slept."], ["It rained near Dr.", "The river rose."], ["On 3. March they left.", "They walked."],
         ["No marks at all"], [""], None, ["He saw Mrs.  Jones!", "Really?", "The end."], ["(Prof. Brown) stayed.", "They left."], [" .", "!", "?", ""]]


def test_what_is_learned(model):
    found = {}
    for r in model.collect():
        found.setdefault(r.kind, set()).add((r.type, r.follower))
    assert found["abbreviation"] == {("dr", None), ("mrs", None), ("prof", None)}
    assert {("the", None), ("they", None)} <= found["starter"] and ("smith", None) not in found["starter"]
    assert found["collocation"] == {("3", "march")}


@pytest.mark.parametrize("literals", [1000, 0])
def test_breaks_taken_back(spark, model, literals):
    """The same with the model in the plan and with a model that is joined."""
    rows = spark.createDataFrame(TEXTS, "id int, text string")
    got = split_sentences(rows, model, "id", max_literals=literals)
    assert got.columns == ["id", "text", "sentences"]
    want = {(i, t): s for (i, t), s in zip(TEXTS, SPLIT)}
    assert {(r.id, r.text): r.sentences for r in got.collect()} == want


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "text string")
    assert sentence_model(empty).count() == 0
    rows = spark.createDataFrame([(1, "Dr. Smith. A b.")], "id int, text string")
    assert split_sentences(rows, sentence_model(empty), "id").first().sentences == ["Dr.", "Smith.", "A b."]


def test_sentences_keep_every_character(spark, model):
    """Joined with the white space between them, the sentences are the text."""
    rows = spark.createDataFrame(list(enumerate(prose(9, 60))), "id int, text string")
    for r in split_sentences(rows, model, "id").where(F.size("sentences") > 0).collect():
        assert " ".join(r.sentences) == r.text


def test_pairs_are_kept_only_after_a_possible_end(spark, monkeypatch):
    """What is counted grows with the words and the sentence ends, not with every two words that stand together."""
    counted, reused = [], sentences._reused
    monkeypatch.setattr(sentences, "_reused", lambda df: counted.append(reused(df)) or counted[-1])
    sentence_model(spark.createDataFrame([(" ".join(f"w{i} w{j}" for i in range(40) for j in range(40)) + ". Then w1! w2? ...",)], "text string")).collect()
    assert {(r.type, r.dot, r.ends, r.next, r.n) for r in counted[0].where("ends").collect()} == {
        ("w39", True, True, "then", 1), ("w1", False, True, "w2", 1), ("w2", False, True, "..", 1), ("..", True, True, None, 1)}
    assert counted[0].count() == 40 + 1 + 4


def test_a_long_text_is_joined_in_linear_time(spark, model):
    """The joined form compares no word of a text with all others."""
    text = " ".join(f"Word{i} and other{i} came to Dr. Who{i}. They left{i}." for i in range(6000))
    rows = spark.createDataFrame([(1, text)], "id int, text string")
    started = time.monotonic()
    got = split_sentences(rows, model, "id", max_literals=0).first().sentences
    assert time.monotonic() - started < 60
    assert got == [s for i in range(6000) for s in (f"Word{i} and other{i} came to Dr. Who{i}.", f"They left{i}.")]
