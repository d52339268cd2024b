"""Operators 3, 5 and 8 against the tokenizers and tiktoken libraries."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
import tiktoken
from conftest import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
import public_tokenizers

from vellum.llm import bpe_codec, queries
from vellum.llm.packing import CAPACITY, MERGED, SLACK, pack
from vellum.llm.pretokens import JsonVocabulary, rank_file, vocabulary
from vellum.llm.token_counts import RankMerger, TokenCounter, token_counts

from .conftest import documents

HF = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
RANKS = rank_file(vocabulary("byte_bpe_50k.tiktoken"))
TIK = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
COUNTER = TokenCounter(vocabulary("byte_bpe_50k.json"))
CODEC = bpe_codec.Codec(RANKS)


def hf(text):
    return HF.encode(text or "", add_special_tokens=False).ids


@given(st.text(st.sampled_from("ab '\nsteéh漢😀-=1<|endoftext|>  "), max_size=80))
@settings(max_examples=300, deadline=None)
def test_counts_equal_library(text):
    assert COUNTER([text]) == [len(hf(text))]


@given(st.binary(min_size=1, max_size=60))
@settings(max_examples=300, deadline=None)
def test_tree_encoding_equals_direct_merges(data):
    ids = CODEC.encode(data)
    assert ids == CODEC.merge(data) and CODEC.decode(ids) == data


@given(st.text(st.sampled_from("ab '\nsteéh漢😀-=1  "), max_size=200))
@settings(max_examples=200, deadline=None)
def test_encoding_equals_library(text):
    assert [i for p in COUNTER.split(text) for i in CODEC.encode(p.encode())] == TIK.encode_ordinary(text)


def test_overlapping_pairs_merge_from_the_left():
    vocab = JsonVocabulary(vocabulary("byte_bpe_50k.json"))
    pieces = [b"a" * n for n in range(1, 200)] + [b"aab" * 30, b"=" * 999]
    assert RankMerger(vocab).counts(pieces).tolist() == [len(CODEC.merge(p)) for p in pieces]


def test_token_counts(spark, odd_rows):
    got = token_counts(documents(spark, odd_rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(
        repr((i, len((t or "").encode()), len(hf(t)), len(hf(t)) > 1024)) for i, t in odd_rows)
    assert token_counts(documents(spark, [])).count() == 0


def test_token_counts_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op3_token_counts(spark, SF_SMALL).collect()}
    assert got == {i: len(hf(t)) for i, t in docs.items()}


def expected_round_trip(i, t):
    ids = TIK.encode_ordinary(t or "")
    return (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            hashlib.sha256((t or "").encode()).hexdigest())


def test_round_trip(spark, odd_rows):
    got = bpe_codec.round_trip(documents(spark, odd_rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected_round_trip(i, t)) for i, t in odd_rows)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {tuple(r) for r in queries.op5_bpe_codec(spark, SF_SMALL).collect()}
    assert got == {expected_round_trip(r.doc_id, r.text) for r in docs}
    assert bpe_codec.round_trip(documents(spark, [])).count() == 0


def test_encode_and_decode_frames(spark, odd_rows):
    rows = [(i, t) for i, t in odd_rows if i is not None]
    enc = bpe_codec.encode(documents(spark, rows))
    back = {r.doc_id: bytes(r.data) for r in bpe_codec.decode(enc).collect()}
    assert back == {i: (t or "").encode() for i, t in rows}


def check_packing(pieces, docs, partitions):
    """Every id in one piece, sequences gapless and hardly padded."""
    texts = {}
    for i, t in docs:
        texts.setdefault(i, []).append(np.array(hf(t) + [0], "<u4"))
    seen, seqs = {}, {}
    for p in pieces:
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
        ids = [x for x in texts[p.doc_id] if len(x) == p.doc_tokens][0]
        assert zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
        seen.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, p.length))
    for i, copies in texts.items():
        for n in {len(x) for x in copies}:
            times = sum(len(x) == n for x in copies)
            at = [0] * times
            for start, length in sorted(seen[i, n]):
                at[at.index(start)] += length
            assert at == [n] * times
    short = 0
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= CAPACITY
        short += at < CAPACITY - SLACK
    assert short <= partitions // MERGED + 1


def test_packing(spark, odd_rows):
    check_packing(pack(documents(spark, odd_rows, 5)).collect(), odd_rows, 5)
    assert pack(documents(spark, [])).count() == 0
    r = random.Random(3)
    rows = [(i, "word " * r.randrange(0, 700)) for i in range(900)]
    check_packing(pack(documents(spark, rows, 2)).collect(), rows, 2)


def test_packing_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    check_packing(queries.op8_packing(spark, SF_SMALL).collect(), docs, 1)


def test_ranks_of_both_files_agree():
    assert JsonVocabulary(vocabulary("byte_bpe_50k.json")).ranks() == RANKS


def test_vocabulary_out_of_order_is_refused(tmp_path):
    import json
    spec = json.load(open(vocabulary("byte_bpe_50k.json")))
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        JsonVocabulary(str(tmp_path / "v.json")).ranks()


def test_long_runs_of_one_character_are_quick():
    """Growing windows double and merge with a heap: a run of n bytes takes about n log n steps."""
    ranks = rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("library", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    for run in (b"a" * 50_000, b"=" * 50_000, b"-+" * 20_000, b"ab" * 9 + b"=" * 20_000 + b"the" * 99):
        codec, began = bpe_codec.Codec(ranks), time.process_time()
        assert list(codec.encode(run)) == library.encode_single_piece(run)
        assert time.process_time() - began < 20
        assert codec.decode(codec.encode(run)) == run


def test_merging_with_a_heap_equals_listing_pairs():
    codec, r = bpe_codec.Codec(rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))), random.Random(8)
    for _ in range(1500):
        data = bytes(r.choice(b"abct =\xc3\xa9"[:r.choice([2, 4, 8])]) for _ in range(r.randrange(1, 24)))
        assert codec.merge_long(data) == codec.merge(data)
