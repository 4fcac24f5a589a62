"""Packing against the tokenizers library and a brute best fit."""

import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelspark.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def ids(raw):
    return list(struct.unpack(f"<{len(raw) // 4}I", raw))


ODD = ["", " ", "it's we'll I'D 're", "a b\u0085c\x1cd\x1fe\x0bf", "²³¼ ªº 12.5€", "ΟΔΟΣ ΣΑΣ Σ", "İİ Ⱥ ǅ", "é ́x a ̈", "中文 ok\U0001f600ok",
       "<|endoftext|> <|startoftext|>x", "café's don’t", "ẞ ß ﬁx", "x　y z​w", "_a_b-c", "\x00\x01", "a" * 3000 + "中"]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(library, text):
    assert ids(packing.Words(PATH).encode(text)) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x2FF)) | st.text(st.characters(codec="utf-8")) | st.text(st.sampled_from("aAé ß'sStTrReE.!\t\n²1İΣ́ ")))
def test_any_text(library, text):
    assert ids(packing.Words(PATH).encode(text)) == library(text)


def test_forgetful_words(library):
    words = packing.Words(PATH, most=3)
    for text in ("one two three four five", "two six", "one two three"):
        assert ids(words.encode(text)) == library(text)


def brute(lengths, window):
    """Fill of the windows by a plain search of the tightest."""
    room, full = [], 0
    for n in sorted((n % window for n in lengths if n % window), reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(window - n)
    full = sum(n // window for n in lengths)
    return sorted(window - r for r in room) + [window] * full


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.sampled_from([16, 17, 31, 64]))
def test_best_fit_decreasing(lengths, window):
    windows = packing.best_fit_decreasing(lengths, window)
    assert sorted(sum(p[2] for p in w) for w in windows) == sorted(brute(lengths, window))
    for made in (windows, packing.filled_up([list(w) for w in windows], window, 2)):
        parts = defaultdict(list)
        for w in made:
            assert 0 < sum(p[2] for p in w) <= window and all(p[2] > 0 for p in w)
            for doc, start, n in w:
                parts[doc].append((start, n))
        for doc, n in enumerate(lengths):
            at = 0
            for start, size in sorted(parts[doc]):
                assert start == at
                at += size
            assert at == n
    # What is not at a power of two wants no more than the gap.
    for size in (sum(p[2] for p in w) for w in made):
        assert size & (size - 1) == 0 or size >= window - 2


def test_rows_as_they_come(spark):
    docs = spark.createDataFrame([(1, "one two", "x", 5), (1, "one two", "x", 5), (None, None, "y", 1), (2, "", "y", 2)], "doc_id long, text string, ids string, sequence_id int")
    rows = packing.pack(docs, PATH, window=8).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, 1), (1, 3), (1, 3), (2, 1)]
    assert packing.pack(docs.limit(0), PATH).count() == 0
    long = spark.createDataFrame([(3, "word " * 50)], "doc_id long, text string")
    pieces = sorted(packing.pack(long, PATH, window=16, block=40).collect(), key=lambda r: r.start)
    assert [r.start for r in pieces][:4] == [0, 16, 32, 48] and sum(r.length for r in pieces) == 51
    assert ids(b"".join(bytes(r.ids) for r in pieces)) == ids(packing.Words(PATH).encode("word " * 50)) + [2]


def test_query(spark, library):
    rows = queries.QUERIES["op11_packing"](spark, SF).collect()
    docs = {r.doc_id: library(r.text or "") + [2] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = docs[r.doc_id]
        assert r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *own[r.start : r.start + r.length]))
        parts[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.padded_to))
    assert parts.keys() == docs.keys()
    for pieces, want in [*((p, len(docs[k])) for k, p in parts.items()), *(([x[:2] for x in s], None) for s in sequences.values())]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
        assert at == want if want else at <= 4096
    kept, padded = sum(len(d) for d in docs.values()), sum(s[0][2] for s in sequences.values())
    assert padded < 1.01 * kept
