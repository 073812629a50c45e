"""Token counts, token files and packing against the libraries."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from plumeworks.llm import packing, token_files
from plumeworks.llm.common import scratch_path
from plumeworks.llm.pretokens import encode_texts
from plumeworks.llm.token_counts import count_texts, token_counts

PIECE, BYTE, WORD = (public_tokenizers.path(f) for f in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
SP, BYTES, WORDS = SentencePieceProcessor(model_file=PIECE), Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
TEXT = st.text(st.sampled_from(list(" \n\t▁aeinorstABC.,!?-<>|019ñé中　\x85\x1c 'ﬁ́ΣİK")) | st.characters(codec="utf-8"), max_size=80) | st.sampled_from(["a" * 300, "ab" * 200, "it's <|endoftext|> we'll", "x  y   z", "...!!! ...", "don't stop", " lead", "trail  "])


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_counts_equal_sentencepiece(values):
    assert count_texts(values, PIECE).tolist() == [len(x) for x in SP.encode(values)]


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_ids_equal_tokenizers(values):
    for path, library in ((BYTE, BYTES), (WORD, WORDS)):
        flat, lens = encode_texts(values, path)
        want = [x.ids for x in library.encode_batch(values, add_special_tokens=False)]
        assert lens.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]


def test_memory_limit_does_not_change_results():
    from plumeworks.llm.pretokens import Encoder, IdMemory

    small, units = IdMemory(Encoder(BYTE), limit=5), [f" word{i % 12}" for i in range(40)]
    for at in range(0, 40, 4):
        flat, _ = small.ids(units[at : at + 4])
        assert flat.tolist() == BYTES.encode("".join(units[at : at + 4]), add_special_tokens=False).ids


def test_counts_of_odd_rows(odd, none):
    got = token_counts(odd, PIECE).collect()
    assert len(got) == odd.count() and token_counts(none, PIECE).count() == 0
    want = Counter((r.doc_id, len((r.text or "").encode()), len(SP.encode(r.text or ""))) for r in odd.collect())
    assert Counter(map(tuple, got)) == want


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=400))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.int64)
    index = token_files.PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_foreign_keys_are_refused():
    keys = np.arange(0, 4000, 2)
    shard = token_files.Shard(token_files.shard_bytes(keys, np.ones(2000, np.int64), np.arange(2000, dtype="<u2")))
    assert (shard.find(keys) == np.arange(2000)).all()
    assert (shard.find(keys + 1) == -1).all()
    assert shard.span(7) == (7, 8)


def test_token_files_round_trip(spark, odd, none):
    got = token_files.round_trip(spark, odd, WORD, 1).collect()
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    ids = {(r.doc_id, r.text): [*WORDS.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
    want = Counter((r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for r in rows for x in [ids[r.doc_id, r.text]])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert token_files.round_trip(spark, none, WORD, 1).count() == 0
    at = 0  # starts follow each other in key order
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id or 0 for r in sorted(got, key=lambda r: r.start)] == [r.doc_id or 0 for r in rows]


def test_least_key_is_a_key(spark):
    least = -(2**63)
    rows = [(None, "a"), (least, "b c"), (least, "b c"), (None, "a"), (5, "d")]
    got = token_files.round_trip(spark, spark.createDataFrame(rows, "doc_id long, text string"), WORD, 1).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, least, least, 5]
    keys = np.array([0, 0, least, least, 5])
    shard = token_files.Shard(token_files.shard_bytes(keys, np.ones(5, np.int64), np.arange(5, dtype="<u2"), 2))
    assert shard.bare == 2 and shard.find(np.array([least, 5, 0])).tolist() == [2, 4, -1]


def test_shards_roll_and_keep_order(spark, corpus):
    folder = scratch_path(spark, "roll")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")  # a shard takes whole batches
    try:
        shards = token_files.write_token_files(corpus, folder, WORD, 1, most=100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shards.count() > 5
    got = {r.doc_id: r for r in token_files.read_token_files(shards, folder).collect()}
    at = 0
    for r in corpus.orderBy("doc_id").collect():
        n = len(WORDS.encode(r.text, add_special_tokens=False).ids) + 1
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (at, n)
        at += n


def test_lookup_by_keys_alone(spark, corpus, tmp_path):
    folder = scratch_path(spark, "lookup")
    rows = corpus.unionByName(spark.createDataFrame([(None, "no key"), (7, "again"), (7, "and again"), (7, "again")], "doc_id long, text string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # a shard takes whole batches
    try:
        shards = token_files.write_token_files(rows, folder, WORD, 1, most=60)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert shards.count() > 8
    asked = spark.createDataFrame([(k,) for k in (0, 7, 7, 13, 59, -1, 10**9, None)], "doc_id long")
    got = sorted((r.key, tuple(r.ids)) for r in token_files.lookup(asked, folder).collect())
    ids = lambda text: (*WORDS.encode(text, add_special_tokens=False).ids, 1)
    want = sorted((r.doc_id, ids(r.text)) for r in rows.where("doc_id in (0, 7, 13, 59)").collect())
    assert got == want and len([k for k, _ in got if k == 7]) == 4
    assert token_files.lookup(asked.where("false"), folder).count() == 0
    assert token_files.lookup(rows, folder).count() == rows.where("doc_id is not null").count()
    for bad in (lambda d: token_files.lookup(d, folder), lambda d: token_files.write_token_files(d, folder, WORD)):
        with pytest.raises(TypeError):
            bad(rows.selectExpr("cast(doc_id as string) as doc_id", "text"))


def test_lookup_reads_spans_only(spark):
    keys, lens = np.arange(0, 4000, 2), np.full(2000, 500)
    raw = token_files.shard_bytes(keys, lens, np.arange(1_000_000, dtype="<u4"))

    class File:
        def __init__(self):
            self.at = self.read_ = 0

        def seek(self, at):
            self.at = at

        def read(self, size):
            self.read_ += size
            return raw[self.at : self.at + size]

    file = File()
    shard = token_files.ShardFile(file)
    assert shard.find(np.array([0, 1, 3998, 4000])).tolist() == [0, -1, 1999, -1]
    assert [x[0] for x in shard.found(3998, 1999)] == [999_500] and [x[0] for x in shard.found(0, 0)] == [0]
    assert file.read_ < len(raw) / 100


def test_rows_of_one_key_are_dealt_apart(spark):
    rows = spark.createDataFrame([(None, f"text {i}") for i in range(200)] + [(5, "the same")] * 200, "doc_id long, text string").repartition(4)
    folder = scratch_path(spark, "apart")
    shards = token_files.write_token_files(rows, folder, WORD).collect()
    assert len(shards) == 4 and max(r.n_rows for r in shards) < 200
    got = token_files.read_token_files(spark.read.parquet(f"{folder}/{token_files.TABLE}"), folder)
    assert got.where("doc_id = 5").count() == 200 and got.select("start").distinct().count() == 400
    assert token_files.lookup(rows.limit(0).union(spark.createDataFrame([(5, "")], rows.schema)), folder).count() == 200


def check_packing(rows, docs, size):
    bins = defaultdict(list)
    by_row = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        by_row[r.doc_id].append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    want = Counter()
    for d in docs:
        ids = np.array([*BYTES.encode(d.text or "", add_special_tokens=False).ids, 0], "<u4")
        n = len(ids)
        cuts = [0, *range(n % size or size, n + 1, size)]
        want.update((d.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(bins)


def test_packing_of_odd_rows(odd, none):
    rows = packing.pack_documents(odd, BYTE).collect()
    used = check_packing(rows, odd.collect(), 2048)
    assert used == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack_documents(none, BYTE).count() == 0


def test_packing_in_groups(corpus):
    rows = packing.pack_documents(corpus, BYTE, size=256, group=20).collect()
    used = check_packing(rows, corpus.collect(), 256)
    assert used <= 1.1 * -(-sum(r.length for r in rows) // 256)


def test_repeated_rows_are_dealt_apart(spark):
    rows = spark.createDataFrame([(None, "the same text")] * 90, "doc_id long, text string").coalesce(2)
    got = packing.pack_documents(rows, BYTE, size=64, group=10)
    assert got.count() == 90 and len({r.g for r in got.selectExpr("sequence_id div 4294967296L as g").collect()}) > 3


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
def test_local_search_never_needs_more(lens):
    lens = np.array(lens)
    place, fills = packing.best_fit(lens, 64)
    before, squares = len(fills), (fills**2).sum()
    packing.improve(lens, place, fills, 64)
    assert (np.bincount(place, lens, len(fills)) == fills).all() and fills.max() <= 64
    assert (fills > 0).sum() <= before and (fills**2).sum() >= squares


def test_swaps_empty_a_sequence():
    # best fit leaves 3 bins where two for one and moves need but 2
    lens = np.array([5, 4, 4, 3, 2, 2])
    place, fills = np.array([0, 1, 1, 0, 2, 2]), np.array([8, 8, 4])
    packing.improve(lens, place, fills, 10)
    assert (fills > 0).sum() == 2
