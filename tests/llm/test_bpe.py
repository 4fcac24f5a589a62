import base64
from hashlib import sha256

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from panelspark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
OURS = bpe.PrefixBPE(bpe.read_ranks(PATH), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_encodes_as_the_library_and_back(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "<|endoftext|>", "don't  stop\n\n", "Straße ñandú 12345 ----  x", "\r\n\t é" * 50])
def test_encodes_odd_texts(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=30), st.binary(max_size=10), st.integers(0, 30), st.integers(0, 5))
def test_appends_and_edits_are_exact(data, more, begin, length):
    last = OURS.prefixes(data)
    joined, longer = OURS.append(data, last, more)
    assert longer == OURS.prefixes(joined)
    begin = min(begin, len(data))
    changed, redone = OURS.edit(data, last, begin, min(len(data), begin + length), more)
    assert redone == OURS.prefixes(changed)


def test_query_on_nulls_clashes_and_empty(spark, tmp_path):
    rows = [(1, "hello world", "x"), (2, None, None), (3, "", "y"), (1, "hello world", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op9_byte_bpe(spark, str(tmp_path)).collect()}
    want = set()
    for i, t, _ in rows:
        ids = THEIRS.encode_ordinary(t or "")
        want.add((i, len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256((t or "").encode()).hexdigest()))
    assert got == want
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    both = bpe.decode(bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert [bytes(r.bytes).decode() for r in both.orderBy("doc_id").collect()] == ["hello world", "hello world", "", ""]
    assert bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_against_the_library(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op9_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = THEIRS.encode_ordinary(d.text)
        assert got[d.doc_id].ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == sha256(d.text.encode()).hexdigest()
