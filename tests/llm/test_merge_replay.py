"""Merge replay against the tiktoken library."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from wordfold.llm import merge_replay as m
from wordfold.llm.catalog import QUERIES

COLUMNS = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=m.read_ranks(m.default_ranks()), special_tokens={})


@pytest.fixture(scope="module")
def replayer():
    return m.Replayer(m.default_ranks(), m.default_pattern())


def expected(library, rows):
    out = Counter()
    for d, text in rows:
        ids = library.encode_ordinary(text or "")
        digests = [hashlib.sha256(x).hexdigest() for x in (",".join(map(str, ids)).encode(), (text or "").encode())]
        out[d, len(ids), *digests] += 1
    return out


def test_the_table(spark, sf, documents, library):
    found = Counter(tuple(r) for r in QUERIES["op12_merge_replay"](spark, sf).select(*COLUMNS).collect())
    assert found == expected(library, documents.items())


def test_odd_rows(spark, odd, odd_rows, nothing, library):
    decoded = m.decode_documents(m.encode_documents(odd))
    found = Counter((r.doc_id, tuple(r.ids), bytes(r.bytes)) for r in decoded.collect())
    assert found == Counter((d, tuple(library.encode_ordinary(t or "")), (t or "").encode()) for d, t in odd_rows)
    assert m.decode_documents(m.encode_documents(nothing)).count() == 0


def test_ids_without_a_token_are_refused(spark):
    rows = spark.createDataFrame([(1, [72, 50256])], m.ENCODED)
    with pytest.raises(Exception, match="no token has the id 50256"):
        m.decode_documents(rows).collect()
    assert m.decode_documents(spark.createDataFrame([(1, None)], m.ENCODED)).first().bytes == b""


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aab bté日 \n\t\r'.,1\x00\x01\x1c\x85 ᠎", max_size=60), max_size=5))
def test_texts(library, replayer, texts):
    assert [np.frombuffer(i, "<i4").tolist() for i in replayer.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_a_worker_that_forgets(library):
    small = m.Replayer(m.default_ranks(), m.default_pattern(), remember=3)
    for text in ("one two three four five", "six seven one two", "one", "two  three"):
        assert np.frombuffer(small.encode([text])[0], "<i4").tolist() == library.encode_ordinary(text)


def test_words_replayed_together_are_words_merged_alone():
    """Small vocabularies of any merges, with overlaps, repeats and new pairs of
    a lower rank than the merge that made them."""
    rng = random.Random(3)
    for _ in range(60):
        tokens = [bytes([b]) for b in range(256)]
        while len(tokens) < 290:
            joined = b"".join(rng.choice([*b"abc".decode(), *[t.decode() for t in tokens[256:]]]).encode() for _ in range(2))
            if joined not in tokens:
                tokens.append(joined)
        tail = tokens[256:]
        rng.shuffle(tail)
        ranks = {t: i for i, t in enumerate(tokens[:256] + tail)}
        words = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 25))) for _ in range(40)]
        words = [w for w in words if w not in ranks] + [b"a" * 31]
        assert m.Merges(ranks).replay(words) == [m.encode_word(w, ranks) for w in words]
