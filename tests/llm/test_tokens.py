"""Token ids against a public encoder, and in odd cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topospark.llm import tokens
from topospark.llm.vocabulary import DEFAULT_VOCABULARY, PerfectHash, Vocabulary

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.read(DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def reference(vocabulary):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def encode(vocabulary, texts):
    spans = tokens.Encoder(vocabulary).spans(texts)
    sizes = np.bincount(spans.text, weights=spans.sizes(), minlength=len(texts)).astype(int) if len(texts) else []
    return [x.tolist() for x in np.split(spans.ids(), np.cumsum(sizes)[:-1])]


ODD = [
    "", " ", "\n", "  a", "a  ", "it's 'sx ''s x!'ve I'll  'll\n's  \n\n a", "don'tre're", "x²½ Ⅷ٣ 日本語 ß", "a b c\x1cd \x85e",
    "<|endoftext|>", "\U0010ffff\n x", "a" * 3000, "é" * 501, "\r\n\r\n\tx", "'", "'s", "a's", " 's", "\n's", "🙂🙃 ok", "1,234.5 – 10%",
]


def test_odd_texts(vocabulary, reference):
    assert encode(vocabulary, ODD) == [reference.encode_ordinary(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 'stlmrevd\n\t.,1é日 😀_-"), max_size=40), min_size=1, max_size=4))
def test_random_texts(vocabulary, reference, texts):
    assert encode(vocabulary, texts) == [reference.encode_ordinary(t) for t in texts]


def test_ids_decode_to_the_text(vocabulary):
    back = {i: b for b, i in vocabulary.ranks.items()}
    for text, ids in zip(ODD, encode(vocabulary, ODD), strict=True):
        assert b"".join(back[i] for i in ids).decode() == text


def test_perfect_hash_is_minimal_and_rejects_strangers():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    table = PerfectHash.build(keys, np.arange(5000))
    assert len(table.keys) == 5000 and (table.find(keys) == np.arange(5000)).all()
    assert (table.find(keys ^ np.uint64(1 << 63)) == -1).all()
    assert PerfectHash.build(keys[:0], np.arange(0)).find(keys[:2]).tolist() == [-1, -1]


def test_long_merge_is_not_quadratic(vocabulary):
    assert len(tokens.merge_bytes(b"ab" * 100_000, vocabulary.ranks)) > 1000


def test_encode_rows(spark, reference):
    rows = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello world", "x"), (3, "Hello world", "y"), (None, "a", "z")], "doc_id bigint, text string, ids string")
    got = tokens.encode(rows).collect()
    assert sorted((r.doc_id or 0, r.ids) for r in got) == sorted([(1, []), (2, []), (3, reference.encode_ordinary("Hello world")), (3, reference.encode_ordinary("Hello world")), (0, reference.encode_ordinary("a"))])
    assert tokens.encode(rows.limit(0)).count() == 0
    counts = tokens.count_tokens(rows, ["doc_id"]).collect()
    assert sorted(r.n_tokens for r in counts) == [0, 0, 1, 2, 2]
