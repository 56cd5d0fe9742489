import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelgrid.llm import packing, tokenfiles
from labelgrid.llm.encode import Encoder, encoder, vocabulary
from labelgrid.llm.shared import saved, shared_folder

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PARTS = ["a", "Word", " ", "  ", "\n", "\t", "é", "́", " ", " ", "　", "<|endoftext|>", "'s", "12", "!?", "Σ", "ß", "\x85", "\x1c", "漢", "İ", ".,", " don't", "_-"]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join) | st.text(max_size=30), max_size=8))
def test_pieces_give_the_ids_of_whole_texts(name, texts):
    e = encoder(vocabulary(name), 2)
    ids, offsets = e(pa.array(texts, pa.string()))
    want = [x.ids + [2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want


def test_forgetting_changes_nothing():
    texts = pa.array([f"some words number {i} and more" for i in range(300)])
    small, large = (Encoder(vocabulary(FILES[0]), 2, keep) for keep in (10, 10_000))
    assert all((a == b).all() for _ in range(2) for a, b in zip(small(texts), large(texts)))


def test_pieces_that_came_again_stay():
    common = [f"word{x} and{x}, so" for x in "abcdefgh"]
    e = Encoder(vocabulary(FILES[1]), 2, 100)
    for k in range(40):
        texts = common + [f" only{chr(97 + k % 26)}{chr(97 + i)}{chr(97 + k // 26)}." for i in range(26)]
        ids, offsets = e(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids_of(x, FILES[1]) for x in texts]
        assert len(e.hashes) <= 100 and (np.diff(e.hashes.astype(object)) > 0).all()
    assert e.again.sum() >= 16


@pytest.mark.parametrize("name", FILES)
def test_plain_words_skip_the_full_encoding(name, monkeypatch):
    e = Encoder(vocabulary(name), 2)
    texts = ["Zwölf Boxkämpfer\njagen, quer", "über ÀÖØÞ ßÿ été's a×b ÷ 12", "end!!"]
    seen = []
    for step in ("full", "jointly", "chained", "singly"):
        own = getattr(e, step)
        monkeypatch.setattr(e, step, lambda x, own=own: (seen.append(x), own(x))[1])
    ids, offsets = e(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [ids_of(x, name) for x in texts]
    told = str(seen)
    assert not any(x in told for x in ("Zw", "jagen", "quer", "ber", "end"))


def test_a_task_leaves_no_encoder_behind(spark, awkward):
    """Code travels with its task, so an encoder that a worker kept would serve nobody."""

    def held(batches):
        import gc

        list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Encoder" for x in gc.get_objects())])], names=["n"])

    for run in (lambda: packing.digest(packing.pack(awkward, packing.word_vocabulary())).count(), lambda: tokenfiles.write_token_files(awkward, shared_folder(spark, "left"), tokenfiles.byte_vocabulary())):
        run()
        assert {r.n for r in spark.range(0, 32, 1, 8).mapInArrow(held, "n long").collect()} == {0}


def ids_of(text, name):
    return encoder(vocabulary(name), 2).tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 10_000])
def test_binary_pieces(n):
    parts = packing.binary_pieces(n)
    assert sum(parts) == n and parts == sorted(parts, reverse=True) and all(p & (p - 1) == 0 and p <= 4096 for p in parts)


def test_packing(awkward, nothing):
    packed = packing.pack(awkward, packing.word_vocabulary())
    got = packing.digest(packed).toPandas()
    want = {}
    for r in awkward.collect():
        ids = np.array(ids_of(r.text, FILES[0]), "<u4")
        at = 0
        for n in packing.binary_pieces(len(ids)):
            key = (r.doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
            at += n
    have = {}
    for r in got.itertuples():
        key = (None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
        have[key] = have.get(key, 0) + 1
    assert have == want
    assert got["sequence_id"].is_unique and (got["offset"] == 0).all()
    assert packing.pack(nothing, packing.word_vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(awkward, packing.word_vocabulary(), max_length=3000)


def test_buckets_hold_one_length(spark, awkward):
    path = shared_folder(spark, "buckets")
    packing.write_buckets(packing.pack(awkward, packing.word_vocabulary(), max_length=64), path)
    back = spark.read.parquet(path)
    assert back.where("octet_length(ids) <> 4 * length").count() == 0 and back.agg({"length": "max"}).first()[0] == 64


def test_token_files(spark, awkward, nothing):
    got = tokenfiles.token_digest(awkward, tokenfiles.byte_vocabulary()).collect()
    want, start = [], 0
    for r in sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = np.array(ids_of(r.text, FILES[1]), "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert tokenfiles.token_digest(nothing, tokenfiles.byte_vocabulary()).count() == 0


def test_shards_are_split_and_read_back(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    path = shared_folder(spark, "small-shards")
    tokenfiles.write_token_files(docs, path, tokenfiles.byte_vocabulary(), shard_ids=2000, id_bytes=4)
    heads = tokenfiles.read_token_files(spark, path)
    places = tokenfiles.with_starts(heads, tokenfiles.shard_starts(heads))
    rows = places.orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows) and len(rows) == docs.count()
    assert len({(r.part, r.number) for r in rows}) > 20
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    # A few keys, through the index: exactly their ids, whatever else the shards hold.
    index = saved(tokenfiles.build_index(heads, len(rows)), "index")
    asked = docs.where("doc_id % 17 = 3").select("doc_id").unionByName(spark.createDataFrame([(-5,)], "doc_id long"))
    found = tokenfiles.with_starts(tokenfiles.look_up(index, asked).where("found"), tokenfiles.shard_starts(heads))
    got = {r.doc_id: (r.start, bytes(r.ids)) for r in tokenfiles.fetch(spark, path, found).collect()}
    starts = {r.doc_id: r.start for r in rows}
    want = {r.doc_id: (starts[r.doc_id], np.array(ids_of(r.text, FILES[1]), "<u4").tobytes()) for r in docs.where("doc_id % 17 = 3").collect()}
    assert got == want


def test_digest_needs_the_index(spark, awkward, monkeypatch):
    """With an index that holds nothing, only rows without a key are read back."""
    monkeypatch.setattr(tokenfiles, "build_index", lambda rows, keys: spark.createDataFrame([], "bucket int, buckets int, blob binary"))
    assert {r.doc_id for r in tokenfiles.token_digest(awkward, tokenfiles.byte_vocabulary()).collect()} == {None}


def test_perfect_hash():
    keys = np.random.default_rng(1).choice(1 << 40, 5000, replace=False)
    levels, place = tokenfiles.build_hash(keys)
    assert sorted(place) == list(range(len(keys)))
    assert (tokenfiles.slots(levels, keys) == place).all()
    bits = sum(map(len, levels))
    assert bits < 6 * len(keys)


@pytest.mark.parametrize("expected", [100, 3000, 40 * tokenfiles.BUCKET_KEYS])
def test_look_up_finds_keys_and_only_keys(spark, expected):
    """Whatever number of keys the index was built for: one, two and 40 buckets."""
    rows = spark.range(3000).selectExpr("0L AS part", "id % 7 AS number", "id AS place", "id * 3 AS doc_id", "5L AS n_tokens", "1L AS ids_crc32")
    index = saved(tokenfiles.build_index(rows, expected), "index")
    asked = spark.range(9000).select("id").withColumnRenamed("id", "doc_id")
    found = tokenfiles.look_up(index, asked).toPandas()
    assert len(found) == 9000
    assert set(found[found["found"]]["doc_id"]) == {3 * i for i in range(3000)}
    hit = found[found["found"]]
    assert (hit["place"] * 3 == hit["doc_id"]).all() and (hit["copies"] == 1).all()


def test_rows_of_several_indexes_are_refused(spark):
    rows = spark.range(10).selectExpr("0L AS part", "0L AS number", "id AS place", "id AS doc_id", "5L AS n_tokens")
    one, two = (tokenfiles.build_index(rows, keys) for keys in (10, 10 * tokenfiles.BUCKET_KEYS))
    asked = rows.select("doc_id")
    with pytest.raises(ValueError):
        tokenfiles.look_up(one.unionByName(two), asked)
    empty = tokenfiles.look_up(one.limit(0), asked).toPandas()
    assert len(empty) == 10 and not empty["found"].any()
