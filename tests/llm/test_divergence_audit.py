from collections import Counter, defaultdict

import numpy as np
import pytest

from edge import DOCS, doc_rows, frame
from readaloud.llm.common import shipped
from readaloud.llm.divergence_audit import Sizes, divergence_audit, kept_terms, vocabulary, words_of
from readaloud.llm.transducer import Transducer


def brute(rows, least=3, top=200):
    """Every group's p of every kept term with Python integers."""
    docs = [((r[2] or ""), (r[3] or ""), [w.decode() for w in words_of(r[1] or "")]) for r in rows]
    holders, groups, counts = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for lang, source, words in docs:
        holders[lang].update(set(words))
        groups[lang].add(source)
        counts[lang, source].update(words)
        counts[lang, None].update(words)
    out = []
    for lang, sources in groups.items():
        kept = sorted((t for t, n in holders[lang].items() if n >= least), key=str.encode)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in [*sources, None]}
        p = {s: {t: 1 + 10 ** 9 * (counts[lang, s][t] + 1) // (total[s] + len(kept)) for t in kept} for s in total}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s)
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], p[None][t]), t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[:top])]
    return sorted(out)


def audited(df, sizes=Sizes()):
    return sorted(tuple(r) for r in divergence_audit(df, sizes).select("lang", "source", "part", "item", "value", "rank").collect())


def sourced(rows):
    """Null and empty sources among others; one source holds over a third of the rows."""
    return [(r[0], r[1], r[2], ("hot", "hot", "a", None, "", "zeta", "ärt", "hot")[i % 8], r[4]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("sizes", [Sizes(), Sizes(7, 3, 5, 4, 2)])
def test_equals_brute_force(spark, sizes):
    """Also with blocks, rows, salts and cells so small that every table is cut many times."""
    rows = sourced(doc_rows())
    rows += [(2000 + i, "\U0001F600z Zeta Ａb" if i % 2 else "ab ＡB zeta", "xx", f"s{i % 3}", 1) for i in range(8)]
    rows += [(3000, "once", "lone", "a", 1), (3001, None, "lone", "b", 1), (3002, "x1y x1y", None, None, 1)]
    assert audited(frame(spark, rows), sizes) == brute(rows)


def test_empty_table_and_texts_without_terms(spark):
    assert audited(frame(spark, doc_rows(n=3)).limit(0)) == []
    assert audited(spark.createDataFrame([(1, "12 34", "en", "a", 1), (2, None, "en", "b", 1)], DOCS)) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_very_long_text(spark):
    rows = [(i, "tok " * 300_000 + "x" * 500_000, "en", f"s{i % 2}", 1) for i in range(4)]
    assert audited(spark.createDataFrame(rows, DOCS)) == brute(rows)


def test_one_run_of_blocks_per_language(spark):
    """Bases are the number of terms before a block, and the blocks' ranges don't overlap."""
    docs = shipped(frame(spark, doc_rows())).select("lang", "text").fillna("")
    rows = vocabulary(kept_terms(docs), Sizes(block_terms=10)).orderBy("lang", "block").collect()
    for lang in {r.lang for r in rows}:
        own = [r for r in rows if r.lang == lang]
        assert [r.block for r in own] == list(range(len(own))) and len(own) > 1
        assert [r.base for r in own] == [sum(x.n_terms for x in own[:i]) for i in range(len(own))]
        assert all(a.last.encode() < b.first.encode() for a, b in zip(own, own[1:]))


def test_transducer():
    terms = sorted({w.encode() for w in "a an and ande bande band über übers 中文 中".split()} | {b"x" * 3000})
    machine = Transducer.build(terms)
    asked = [*terms, b"", b"x", b"zz", b"bandes"]
    offsets = np.cumsum([0] + [len(t) for t in asked])
    found = machine.ordinals(np.frombuffer(b"".join(asked), np.uint8), offsets)
    assert list(found) == [*range(len(terms)), -1, -1, -1, -1]
    assert [machine.term(i) for i in range(len(terms))] == terms
    # minimal: equal endings are one node
    assert len(Transducer.build([b"ab", b"cb", b"db"]).finals) == 3
    with pytest.raises(ValueError):
        Transducer.build([b"b", b"a"])
    with pytest.raises(KeyError):
        machine.term(len(terms))
