"""Token output and packing: exact round trips."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestone.llm import bitpack
from lodestone.llm.packing import best_fit, best_fit_packing
from lodestone.llm.shared import fresh_path
from lodestone.llm.tokens import WordEncoder, tokenizer_path

DOCS = "doc_id long, text string"
TOKENIZER = Tokenizer.from_file(tokenizer_path())
ENCODER = WordEncoder(limit=50)
ODD = ["", "İstanbul ΣΑΣ it's a\x1ct 12½ don't", "<|endoftext|> x", "Ⅷ ªº Å ﬁ é ́x \xa0a\xa0b", "…a,b;c!! 中文 テスト　x", "a.b.,; ...", "ſtraße K"]


def plain(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_words_encode_as_the_whole_text(text):
    assert ENCODER.encode([text]) == [raw(plain(text))]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    assert ENCODER.encode([text, None]) == [raw(plain(text)), b""]


def test_long_words_are_not_kept():
    word = "Longword" * 40
    assert ENCODER.encode([f"a {word}, b"]) == [raw(plain(f"a {word}, b"))]
    assert max(map(len, [*ENCODER.words, *ENCODER.stems])) <= 80


@pytest.mark.parametrize("width", [1, 7, 15, 16, 20, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype("<u4")
    packed = bitpack.pack(ids, width)
    assert len(packed) == (1001 * width + 7) // 8
    assert (bitpack.unpack(packed, 1001, width) == ids).all()


def test_width():
    assert [bitpack.width_of(n) for n in (1, 2, 3, 256, 257, 49_408)] == [1, 1, 2, 8, 9, 16]


def test_file_random_access(tmp_path):
    rng = random.Random(3)
    docs = [(i if i else None, raw([rng.randrange(1000) for _ in range(rng.choice([0, 1, 7, 200]))])) for i in range(50)]
    out = bitpack.PackedWriter(f"file://{tmp_path}/a.pack", 10, block=64)
    for d in docs:
        out.add(*d)
    out.close()
    back = bitpack.PackedReader(f"file://{tmp_path}/a.pack")
    for k in rng.sample(range(50), 50):
        assert back.document(k).tobytes() == docs[k][1]
    assert (bool(back.nulls[0]), int(back.doc_ids[7])) == (True, 7)
    (tmp_path / "b.pack").write_bytes(b"\0" * 100)
    with pytest.raises(ValueError, match="no packed id file"):
        bitpack.PackedReader(f"file://{tmp_path}/b.pack")


def test_token_id_output(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choices(["The", "ering,", "été!", "x"], k=rng.randint(0, 30)))) for i in range(300)] + [(900 + i, t) for i, t in enumerate(ODD)] + [(950, None), (960, "word " * 50_000)]
    rng.shuffle(docs)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitpack.token_id_output(spark.createDataFrame(docs, DOCS).repartition(5)).collect()}
    start = 0
    for doc_id, text in sorted(docs):
        ids = plain(text or "") + [1]
        assert got[doc_id] == (start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)
    assert bitpack.token_id_output(spark.createDataFrame([], DOCS)).count() == 0


def test_token_id_output_edges(spark):
    rows = bitpack.token_id_output(spark.createDataFrame([(None, "a", 1), (1, "b", 2), (1, "b", 3)], f"{DOCS}, start int")).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens) for r in rows), key=lambda r: r[1]) == [(None, 0, 2), (1, 2, 2), (1, 4, 2)]


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    uri = fresh_path(spark, "packed-test")
    manifest = bitpack.write_packed(spark.createDataFrame([(1, "a b")], DOCS), uri)
    from lodestone.llm import files

    with files.create(f"{uri}/left-over.pack") as f:
        f.write(b"half")
    assert bitpack.read_packed(manifest).count() == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_is_best_fit(lengths):
    bins = best_fit(lengths, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 50 for b in bins)
    rooms = []  # the plain way
    for n in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((50 if fit is None else fit) - n)
    assert len(rooms) == len(bins)


def check_packing(rows, docs, capacity):
    want = {}
    for doc_id, text in docs:
        ids = plain(text or "") + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            piece = ids[at : at + capacity]
            want[doc_id, k] = (at, len(piece), zlib.crc32(raw(piece)))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    bins = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= capacity
    return bins


def test_packing(spark):
    rng = random.Random(5)
    docs = [(i, "a " * int(rng.expovariate(1 / 30))) for i in range(1500)] + [(5000, "b " * 700), (5001, None), (5002, "")]
    frame = spark.createDataFrame(docs, DOCS)
    rows = best_fit_packing(frame, capacity=128).collect()
    bins = check_packing(rows, docs, 128)
    assert len(bins) <= -(-sum(bins.values()) // 128) * 1.01 + 1
    many = best_fit_packing(frame, capacity=128, limit=200, fan_in=2).collect()
    assert len(check_packing(many, docs, 128)) <= len(bins) * 1.03 + 2


def test_packing_edges(spark):
    assert best_fit_packing(spark.createDataFrame([], DOCS)).count() == 0
    rows = best_fit_packing(spark.createDataFrame([(None, "a", 1), (1, "b", 2), (1, "b", 3)], f"{DOCS}, piece int")).collect()
    assert len({r.sequence_id for r in rows}) == 1
    assert sorted(r.offset for r in rows) == [0, 2, 4]
    # Items of which no two fit one bin end the rounds with more than one task's items left.
    big = spark.createDataFrame([(i, "a " * 70) for i in range(300)], DOCS)
    assert best_fit_packing(big, capacity=128, limit=50, fan_in=2).select("sequence_id").distinct().count() == 300


def test_workers_keep_no_words_after_packing(spark):
    path = tokenizer_path()  # an encoder that no other test's tasks use
    docs = spark.createDataFrame([(i, f"word{i} letters {'x' * (i % 20)}y") for i in range(400)], DOCS).repartition(8)
    assert best_fit_packing(docs, tokenizer=path).count() == 400

    def held(batches):
        import time

        import pyarrow as pa

        from lodestone.llm.tokens import _ENCODERS

        for _ in batches:
            time.sleep(0.2)  # so that each worker gets some
            used = [e for key, e in _ENCODERS.items() if path in str(key)]
            yield pa.RecordBatch.from_arrays([pa.array([len(used)]), pa.array([sum(len(e.words) + len(e.stems) for e in used)])], ["encoders", "words"])

    seen = spark.range(16, numPartitions=16).mapInArrow(held, "encoders long, words long").collect()
    assert any(r.encoders for r in seen)
    assert all(r.words == 0 for r in seen)


def test_packing_that_keeps_few_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 97}" for j in range(50 + i))) for i in range(40)], "doc_id long, text string")
    pieces = lambda **kw: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in best_fit_packing(docs, **kw).collect())
    assert pieces(words=10) == pieces()
