import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import edge
from readaloud.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_every_token_encodes_to_itself():
    c = bpe.codec(RANKS, P.PATTERN)
    assert all(c.merge(t) == [i] for t, i in c.ranks.items())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(library, text):
    c = bpe.codec(RANKS, P.PATTERN)
    data = c.encode(text)
    assert ids(data) == library.encode_ordinary(text) and c.decode(data) == text.encode()


def test_long_matches_through_the_tree(library):
    c, rng = bpe.codec(RANKS, P.PATTERN), random.Random(5)
    texts = ["a" * 5000, "=" * 3001, " " * 4097, "ab" * 2500, "\n" * 999, "é" * 700, "<|endoftext|>" * 3]
    for alphabet in ("ab", "abc", "etaoinshr", "=-", "-=_#", "éü中a"):
        texts += ["".join(rng.choice(alphabet) for _ in range(n)) for n in (65, 129, 1000, 4000)]
    for t in texts:
        assert ids(c.encode(t)) == library.encode_ordinary(t)
        assert c.decode(c.encode(t)).decode() == t


def test_joining_is_associative_with_an_identity():
    c, rng = bpe.codec(RANKS, P.PATTERN), random.Random(6)
    for _ in range(300):
        parts = ["".join(rng.choice("aabeinst") for _ in range(rng.randint(0, 40))).encode() for _ in range(3)]
        x, y, z = (c.merge(p) if p else [] for p in parts)
        assert c.join(c.join(x, y), z) == c.join(x, c.join(y, z)) == (c.merge(b"".join(parts)) if any(parts) else [])
        assert c.join(x, []) == c.join([], x) == x


def test_documents(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "BATCH_BYTES", 1000)
    rows = edge.doc_rows()
    got = bpe.round_trip(edge.frame(spark, rows), RANKS, P.PATTERN).collect()

    def want(r):
        i, t = r[0], r[1] or ""
        e = library.encode_ordinary(t)
        return (i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert sorted(map(tuple, got), key=repr) == sorted(map(want, rows), key=repr)


def test_empty_table(spark):
    assert bpe.round_trip(edge.frame(spark, []), RANKS, P.PATTERN).collect() == []
