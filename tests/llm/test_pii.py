import collections
import random
import time

from pyspark.sql import functions as F

import edge
import spans
from readaloud.llm import common as C
from readaloud.llm import pii as P


def scan(spark, texts):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in P.personal_data_digest(P.find_personal_data(edge.frame(spark, rows))).collect()}


def test_base_spans_against_plain_python(spark):
    rng = random.Random(12)
    bits = ["a.b", "@", "ex.org", "-bob", "alice@example.com", " ", ".", "1", "10", "255", "256", "1.2.3.4", ".5", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "378282246310005", "+1 (555) 010-9999", "+", "(", ")", "-", "+44 20 7946 0958.", "\n", "é", "%", "_", "0001.002.3.4", "--", "  "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["a" * 60_000, "a" * 30_000 + "@", "1 " * 30_000, "a." * 20_000 + "@b" + ".c" * 20_000, "1." * 20_000, "+" * 20_000 + "1", "+1" + " " * 20_000]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        want = spans.digest(t, spans.personal, P.BASE)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want[:5], t[:200]


def context_texts():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda: " ".join(word() for _ in range(20)) + " the of and "
    seeds = [prose() + f"phone: +1 555 010 {1000 + i} " + prose() for i in range(12)]
    seeds += [prose() + f"the +1 555 011 {1000 + i} of " + prose() for i in range(12)]
    hidden = [prose() + f"phone: 555 012 {1000 + i} " + prose() for i in range(3)]
    clean = [prose() + f"the 990 012 {1000 + i} of " + prose() for i in range(3)]
    return seeds, hidden, clean


def test_contexts_of_seeds_discover_unseen_identifiers(spark):
    seeds, hidden, clean = context_texts()
    texts = seeds + hidden + clean
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        ctx = [s for s in got[i].spans.split(",") if s.startswith("ctx")]
        if t in hidden:
            at = t.index("555 012")
            assert ctx == [f"ctx:{at}:{at + 12}"], t
        else:
            assert ctx == []
    assert all(got[i].n_phone == 1 for i in range(len(seeds)))


def test_trust_follows_from_discovered_identifiers(spark):
    seeds, hidden, _ = context_texts()
    # the discovered numbers, in a new context, carry that context to a number seen nowhere else
    more = [t.replace("phone:", "fax-no").replace("555 012 1000", f"555 012 {1000 + i % 3}") for i, t in enumerate(hidden * 3)]
    last = "zz fax-no 700 800 9000 yy"
    got = scan(spark, seeds + hidden + more + [last])
    assert "ctx:10:22" in got[len(seeds) + len(hidden) + len(more)].spans


def test_glued_labels_are_patterns_and_marks_are_not(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda: " ".join(word() for _ in range(9)) + f" ({word()}) {word()}, "
    seeds = [prose() + f"tel:+1555010{1000 + i} id=4111{'0' * 11}{i} " + prose() for i in range(10)]
    marks = [prose() + f"(a{i}@b.com) c{i}@d.org, " + prose() for i in range(10)] + ["( ,"] * 4
    hidden = [prose() + "tel:5550121000 " + prose(), prose() + "x, tel: 5550121001 " + prose()]
    clean = [prose() + "(7007001234) " + prose(), prose() + "7007005678, " + prose()]
    texts = seeds + marks + hidden + clean
    got = scan(spark, texts)
    ctx = [[s for s in got[i].spans.split(",") if s.startswith("ctx")] for i in range(len(texts))]
    at = [t.index("5550121") for t in hidden]
    assert ctx[-4:] == [[f"ctx:{at[0]}:{at[0] + 10}"], [f"ctx:{at[1]}:{at[1] + 10}"], [], []]
    assert not any(s for t, s in zip(texts, ctx) if t in marks)


def test_no_token_is_beside_more_instances_than_it_is_counted(spark, monkeypatch):
    seen, contexts = [], P.contexts
    monkeypatch.setattr(P, "contexts", lambda rows: seen.append(contexts(rows)) or seen[-1])
    texts = ["tel:5550121000", "id=1234567;id=2345678", "(a@b.com) a@b.com, (", "+4111 1111 1111 1111 +4111 1111 1111 1111", "1.2.3.4.1.2.3.4@x.com 1.2.3.4", ""] + [
        "".join(random.Random(i).choices(["tel:", "a@b.com", "1.2.3.4", " ", "4111 1111 1111 1111", "+1555010999", "9", "(", ",", "x", "1234567"], k=30)) for i in range(200)]
    scan(spark, texts)
    parts, words = seen[0]
    counted = {(r.side, r.word): r.n for r in words.collect()}
    beside = collections.Counter(x for r in parts.collect() for x in (("l", r.left), ("r", r.right)) if x[1])
    assert len(beside) > 20 and {("l", "tel:"), ("l", "id="), ("r", ","), ("l", "(")} <= set(beside)
    assert all(n <= counted[x] for x, n in beside.items())


def test_a_megabyte_of_numbers(spark):
    """Spans that overlap and gaps are found without comparing spans pairwise."""
    rng = random.Random(15)
    kinds = [lambda: f"{rng.randint(0, 10 ** 7)}", lambda: "4111 1111 1111 1111", lambda: f"+1 555 {rng.randint(1000000, 9999999)}", lambda: "10.0.0.7",
             lambda: f"ref {rng.randint(10 ** 6, 10 ** 8)}", lambda: "(a@b.com)"]
    text = ", ".join(rng.choice(kinds)() for _ in range(90_000))
    assert len(text) > 10 ** 6
    begin = time.monotonic()
    got = scan(spark, [text, "é" + text])
    assert time.monotonic() - begin < 120
    for i, t in enumerate([text, "é" + text]):
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone, got[i].base_sha256) == spans.digest(t, spans.personal, P.BASE)[:5]


def test_candidates_clear_of_base_spans_and_gaps_between(spark):
    rng = random.Random(16)
    rows, want = [], []
    for i in range(60):
        n = rng.choice([0, 1, 5, 300, 900])
        text = "".join(rng.choice("ab é中😀1\n") for _ in range(rng.choice([0, 7, 4096, 4097, 20_000])))
        some = lambda k: sorted({(s, s + rng.randint(1, 9)) for s in (rng.randint(0, max(0, len(text) - 9)) for _ in range(k))}) if len(text) > 9 else []  # noqa: E731, B023
        base, other = some(n), some(rng.choice([0, 3, 400]))
        rows.append((i, text, base, other))
        merged = sorted(base + other)
        begins = [max((e for _, e in merged[:k]), default=0) for k in range(len(merged) + 1)]
        gaps = [text[b:max(b, s)] for b, (s, _) in zip(begins, merged)] + [text[begins[-1]:]]
        clear = sorted((s, e) for s, e in other if not any(bs < e and s < be for bs, be in base))
        want.append((clear, gaps))
    kind = "array<struct<start:int,end:int>>"
    df = spark.createDataFrame(rows, f"i int, text string, base {kind}, other {kind}")
    got = df.select("i", F.sort_array(C.clear_of(F.col("other"), F.col("base"), "start", "end")).alias("clear"),
                    P._gaps(F.col("text"), F.sort_array(F.concat("base", "other"))).alias("gaps")).orderBy("i").collect()
    assert [([tuple(x) for x in r.clear], r.gaps) for r in got] == want


def test_planted_identifiers_are_found_and_plain_numbers_left(spark):
    """Recall over ``spans`` of numbers behind labels that seeds have, and precision over numbers in prose."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    prose = lambda: " ".join(word() for _ in range(12))
    labels = ["phone:", "tel", "mobile=", "call me at", "Fax", "<tel>"]
    seeds = [f"{prose()} {labels[i % 6]} +1 555 01{i % 10} {1000 + i} {prose()}" for i in range(120)]
    hidden = [f"{prose()} {labels[i % 6]} 555-02{i % 10}-{2000 + i} {prose()}" for i in range(60)]
    plain = [f"{prose()} {word()} {7_000_000 + i} {prose()}" for i in range(60)]
    got = scan(spark, seeds + hidden + plain)
    ctx = [[s for s in got[i].spans.split(",") if s.startswith("ctx")] for i in range(240)]
    caught = sum(f"ctx:{t.index('555-02')}:{t.index('555-02') + 12}" in c for t, c in zip(hidden, ctx[120:180]))
    assert caught >= 54 and not any(ctx[180:])


def test_rounds_go_on_until_nothing_rises(spark):
    """Each group of numbers gives the next label away: a chain longer than any fixed number of rounds."""
    labels = [f"lab-{c}" for c in "abcdefgh"]
    texts = [f"aa {labels[0]} +1555010{1000 + i} zz{i}" for i in range(30)]
    for k in range(7):
        texts += [f"aa {labels[k]} 7{k}0010{i} zz" for i in range(3)] + [f"bb {labels[k + 1]} 7{k}0010{i} yy{n}" for i in range(3) for n in range(10)]
    got = scan(spark, texts + [f"cc {labels[7]} 99887766 xx"])
    assert got[len(texts)].spans == "ctx:9:17"


def test_edge_rows(spark):
    rows = [*edge.doc_rows(), (None, "x@y.zz", "en", "s", 1), (7, "x@y.zz", "en", "s", 1), (7, "x@y.zz", "en", "s", 1)]
    got = P.personal_data_digest(P.find_personal_data(edge.frame(spark, rows))).collect()
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == collections.Counter(
        (r[0], spans.digest(r[1], spans.personal, P.BASE)[4]) for r in rows)
    assert P.find_personal_data(edge.frame(spark, [])).collect() == []
