"""Operators 1, 2, 5 and 10: exact round trips, and the tokenizers library as the reference."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presswork.llm import jpeg
from presswork.llm.bpe import Encoder, merge_long
from presswork.llm.common import tokenizer_path
from presswork.llm.op1_media import decode_media, encode_media
from presswork.llm.op2_training_order import feistel, read_training_order, write_training_order
from presswork.llm.op5_packing import first_fit_decreasing, pack_documents
from presswork.llm.op10_bpe import encode

ODD = ["", " ", "  a  b", "\n\n x\n\ny  ", "don't 'sound we'll I'D", "Œuvre ÀÉ × ÷ x", "<|endoftext|>hi<|startoftext|>", "İ ΣΑΣ ² ½ 123 ñ", "a" * 200 + " " * 70 + "b" * 65, "日本語 nb sp", "tab\t\tx \r\nz ", "é", "\x1c\x0bz", "it's<|x", "x" * 3000]


def table(spark, texts):
    """Texts with a null among them, repeated rows, and columns whose names clash."""
    rows = [(i, t, "id", 1) for i, t in enumerate([*texts, None, *texts[:2]])]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, length int")


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def pair(request):
    from tokenizers import Tokenizer

    path = tokenizer_path(request.param)
    return Tokenizer.from_file(path), Encoder(path)


def ids_of(coder, texts):
    import pyarrow as pa

    out = []
    for _, offsets, ids in coder.encode(pa.array(texts, pa.string())):
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def test_encoder_is_the_library(pair):
    library, own = pair
    assert ids_of(own, ODD) == [x.ids for x in library.encode_batch(ODD, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x17F), st.sampled_from(" \n'’é漢✓")), max_size=40), min_size=1, max_size=4))
def test_encoder_is_the_library_on_any_text(pair, texts):
    library, own = pair
    assert ids_of(own, texts) == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_long_words_merge_alike(pair):
    library, own = pair
    word = "".join(random.Random(1).choice("abcde") for _ in range(500))
    raw = word.encode()
    assert merge_long([*(int(own.inner[b]) for b in raw[:-1]), int(own.final[raw[-1]])], own.merges) == library.encode(word, add_special_tokens=False).ids


def test_op10(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs = table(spark, ODD)
    got = {r.doc_id: r for r in encode(docs, tokenizer_path("byte_bpe_50k.json")).collect()}
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[r.doc_id].ids, "<u4").tolist() == ids
        assert bytes(got[r.doc_id].decoded).decode() == library.decode(ids, skip_special_tokens=False) == (r.text or "")


def test_op5(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    docs = table(spark, [*ODD, "word " * 9000])
    rows = pack_documents(docs, tokenizer_path("word_bpe_49k.json")).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        at = 0
        for p in sorted(by_doc[r.doc_id], key=lambda x: x.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda x: x.offset):
            assert p.offset == at
            at += p.length
        assert at <= 4096
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 4096) + 1


@given(st.lists(st.integers(1, 100), max_size=60))
def test_first_fit_is_first_fit(sizes):
    sizes = sorted(sizes, reverse=True)
    bins, offsets = first_fit_decreasing(np.array(sizes, dtype=np.int64), 100)
    free = []
    for size, b, o in zip(sizes, bins, offsets, strict=True):
        want = next((i for i, f in enumerate(free) if f >= size), len(free))
        if want == len(free):
            free.append(100)
        assert (b, o) == (want, 100 - free[want])
        free[want] -= size


@given(st.integers(1, 3000), st.integers(0, 1 << 60))
def test_feistel_is_a_permutation(n, key):
    slots = feistel(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n))
    assert feistel(slots, n, key, inverse=True).tolist() == list(range(n))


def test_op2(spark, tmp_path):
    docs = table(spark, [*ODD, "word " * 3000])
    n = write_training_order(docs, tokenizer_path("word_bpe_49k.json"), str(tmp_path / "a"), key=5, length=64, per_shard=16)
    rows = read_training_order(spark, str(tmp_path / "a"), 64, 16).collect()
    assert sorted(r.slot for r in rows) == list(range(n))
    assert all(r.byte_offset == r.slot % 16 * (24 + 128) and r.shard == r.slot // 16 for r in rows)
    later = read_training_order(spark, str(tmp_path / "a"), 64, 16, first_slot=37).collect()
    assert sorted(r.slot for r in later) == list(range(37, n))
    want = {}
    for r in pack_documents(docs, tokenizer_path("word_bpe_49k.json"), 64).collect():
        want[r.doc_id, r.start] = r.ids_crc32
    assert {(r.doc_id, r.start): zlib.crc32(bytes(r.ids)) for r in rows} == want
    write_training_order(docs, tokenizer_path("word_bpe_49k.json"), str(tmp_path / "b"), key=6, length=64, per_shard=16)
    other = {r.slot: (r.doc_id, r.start) for r in read_training_order(spark, str(tmp_path / "b"), 64, 16).collect()}
    assert other != {r.slot: (r.doc_id, r.start) for r in rows}


def test_op2_of_wide_ids(spark, tmp_path):
    docs = table(spark, [*ODD, "word " * 300])
    name = tokenizer_path("word_bpe_49k.json")
    write_training_order(docs, name, str(tmp_path / "a"), key=5, length=64, per_shard=16, end_id=70_000)
    rows = read_training_order(spark, str(tmp_path / "a"), 64, 16).collect()
    assert all(r.byte_offset == r.slot % 16 * (24 + 256) for r in rows)
    ends = [np.frombuffer(r.ids, "<u4")[-1] for r in rows]
    assert sum(e == 70_000 for e in ends) == docs.count()
    with pytest.raises(Exception, match="doesn't fit into 2 bytes"):
        write_training_order(docs, name, str(tmp_path / "b"), key=5, length=64, end_id=70_000, id_bytes=2)


def test_op1(spark):
    docs = table(spark, [*ODD, "é" * 50_000])
    rows = {r.doc_id: r for r in decode_media(encode_media(docs)).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        got = rows[r.doc_id]
        assert got.n_bytes == len(raw) and bytes(got.payload) == raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert len(got.rgb) == got.width * got.height * 3 and bytes(got.media[:2]) == b"\xff\xd8"
    assert rows[len(ODD) + 1].media is not None
    assert hashlib.sha256(rows[0].media).digest() == hashlib.sha256(rows[len(ODD) + 2].media).digest()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=4))
def test_jpeg_round_trip(payloads):
    lengths = np.array([len(p) for p in payloads])
    padded = np.maximum(64, -(-lengths // 64) * 64)
    at = np.concatenate([[0], np.cumsum(padded)])
    raw = b"".join(p.ljust(int(n), b"\0") for p, n in zip(payloads, padded, strict=True))
    images, coefficients = jpeg.read_coefficients(jpeg.write_payloads(np.frombuffer(raw, dtype=np.uint8), at, lengths))
    for i, (image, p) in enumerate(zip(images, payloads, strict=True)):
        size, payload = jpeg.payload_of(image, coefficients)
        assert size == len(p) and payload.tobytes() == raw[at[i] : at[i + 1]]


def test_jpeg_without_restarts_and_with_long_runs():
    """A grey file written here by hand: a run of ended blocks, no restart markers, a size that isn't whole blocks."""
    bits = []

    def put(value, n):
        bits.extend((value >> i) & 1 for i in reversed(range(n)))

    def data():
        while len(bits) % 8:
            bits.append(1)
        raw = bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, len(bits), 8))
        bits.clear()
        return raw.replace(b"\xff", b"\xff\x00")

    ac = [[] for _ in range(16)]
    ac[1] = [0x01, 0x20, 0xF0]  # a coefficient of one bit, a run of 4 to 7 ended blocks, sixteen zeros
    codes, sizes = jpeg._codes(ac)
    dc_code, dc_size = jpeg._codes(jpeg.DC_TABLE)
    frame = jpeg._segment(0xC2, bytes([8, 0, 9, 0, 41, 1, 7, 0x11, 0]))
    out = b"\xff\xd8" + jpeg._QUANT + frame + jpeg._dht(0x00, jpeg.DC_TABLE) + jpeg._dht(0x10, ac)
    values = [5, -3, 100, 0, 7, 7, 8, 9, 10, 11, 12, 13]  # 6 x 2 blocks
    last = 0
    for v in values:
        d = v - last
        last = v
        n = abs(d).bit_length()
        put(int(dc_code[n]), int(dc_size[n]))
        if n:
            put(d if d > 0 else d + (1 << n) - 1, n)
    out += jpeg._segment(0xDA, bytes([1, 7, 0, 0, 0, 0])) + data()
    put(int(codes[0xF0]), int(sizes[0xF0]))
    put(int(codes[0x01]), int(sizes[0x01]))
    put(1, 1)  # block 0: coefficient 17 is 1, the rest of it and six more blocks end
    put(int(codes[0x20]), int(sizes[0x20]))
    put(7 - 4, 2)
    put(int(codes[0x01]), int(sizes[0x01]))
    put(0, 1)  # block 7: coefficient 1 is -1, the rest of it and four more blocks end
    put(int(codes[0x20]), int(sizes[0x20]))
    put(5 - 4, 2)
    out += jpeg._segment(0xDA, bytes([1, 7, 0, 1, 63, 0])) + data() + b"\xff\xd9"
    images, c = jpeg.read_coefficients([out])
    assert c[:, 0].tolist() == values
    want = np.zeros((12, 63), dtype=int)
    want[0, 16] = 1
    want[7, 0] = -1
    assert np.argwhere(c[:, 1:] != 0).tolist() == [[0, 16], [7, 0]] and (c[:, 1:] == want).all()
    assert jpeg.to_rgb(images, c)[0].shape == (9, 41, 3)


def test_transform_is_the_cosine_transform():
    c = np.random.default_rng(3).integers(-50, 50, (5, 64))
    natural = np.zeros((5, 64))
    natural[:, jpeg.ZIGZAG] = c
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    m = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(0.125), 0.5)
    want = np.einsum("xu,buv,yv->bxy", m, natural.reshape(5, 8, 8), m)
    assert np.abs((c @ jpeg.BASIS / (1 << 22)).reshape(5, 8, 8) - want).max() < 0.3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert encode(none, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert pack_documents(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert decode_media(encode_media(none)).count() == 0
