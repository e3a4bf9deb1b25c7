"""Every opN query over odd tables: all columns that it promises, against plain versions of the same."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import SPACE, WORD, brute_components, within_one

from presswork.llm import op1_media as op1
from presswork.llm import op2_training_order as op2
from presswork.llm.common import tokenizer_path
from presswork.llm.op5_packing import pack_documents
from presswork.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, h string, s long, n string, at string, key string"


def documents():
    rng = random.Random(8)
    words = [f"w{i}é" for i in range(400)]
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "hello"), (5, "hello\nhello\n"), (6, "Hello World\n" * 3), (7, "日本語 text 😀\n日本語 texts 😀"), (7, "another of id 7"), (8, "x" * 64), (9, "y" * 65)]
    rows += [(10, "same row"), (10, "same row"), (None, "no id"), (None, "no id"), (None, passage)]
    rows += [(20 + i, "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))) + (f"\n{passage}" if i % 3 == 0 else "")) for i in range(20)]
    rows += [(50, rows[-1][1]), (51, rows[-1][1] + " more"), (60, "word " * 9000), (61, "long" * 20_000)]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    rows = documents()
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", 1, "c", "d", "e") for i, t in rows], DOCS).repartition(3).write.parquet(str(root / "documents.parquet"))
    labels = [(i, int(i > 20), 0) for i, _ in rows if i] + [(4, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    vectors = [(i, [float(np.sin(i * j)) for j in range(8)]) for i in range(45)] + [(45, None), (46, [1.0, None] * 4), (47, [float("nan")] * 8), (None, [1.0] * 8)]
    spark.createDataFrame([(i, v, 3) for i, v in vectors], "vec_id long, embedding array<double>, score int").write.parquet(str(root / "embeddings.parquet"))
    return rows, str(root)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("none")
    spark.createDataFrame([], DOCS).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<double>").write.parquet(str(root / "embeddings.parquet"))
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(root / "conversations.parquet"))
    return str(root)


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def rows_of(name, spark, path):
    df = QUERIES[name](spark, path)
    return df.columns, [tuple(r) for r in df.collect()]


def check(name, spark, tables, columns, want):
    rows, path = tables
    have, got = rows_of(name, spark, path)
    assert have[: len(columns)] == columns
    assert collections.Counter(r[: len(columns)] for r in got) == collections.Counter(want)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert rows_of(name, spark, nothing)[1] == []


def test_op1(spark, tables):
    rows, path = tables
    columns, got = rows_of("op1_media", spark, path)
    assert columns == ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    want = collections.Counter()
    for i, t in rows:
        raw = (t or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want[i, len(raw), len(padded), sha(padded), zlib.crc32(padded[-64:])] += 1
    assert collections.Counter(r[:5] for r in got) == want
    # Equal texts have equal values, and different texts different media.
    assert len({r[3] for r in got}) == len({r[6] for r in got}) == len({r[3:] for r in got})


def test_op1_of_bad_files(spark, tmp_path):
    good = {r.doc_id: bytes(r.media) for r in op1.encode_media(spark.createDataFrame([(1, "text of a file"), (2, "x" * 5000)], "doc_id long, text string")).collect()}
    rng, files = random.Random(2), [(0, None), (1, good[1]), (2, b""), (3, b"junk"), (4, b"\xff\xd8"), (5, b"\xff\xd8\xff\xd9"), (6, good[2])]
    for i in range(60):
        x = bytearray(good[2])
        for _ in range(rng.choice([1, 5])):
            x[rng.randrange(len(x))] = rng.randrange(256)
        files.append((100 + i, bytes(x[: rng.randrange(len(x))] if i % 2 else x)))
    # A comment of any length on a file from elsewhere is no stored payload.
    note = bytearray(good[1]).replace(b"presswork payload\0", b"somebody elses\0xyz")
    files.append((300, bytes(note)))
    rows = {r.doc_id: r for r in op1.decode_media(spark.createDataFrame(files, "doc_id long, media binary").coalesce(1)).collect()}
    assert len(rows) == len(files)
    assert bytes(rows[1].payload).rstrip(b"\0") == b"text of a file" and rows[6].n_bytes == 5000 and rows[1].error is rows[6].error is None
    assert all(rows[i].error and rows[i].rgb is None for i in (2, 3, 4, 5)) and rows[0].error is rows[0].rgb is None
    assert rows[300].payload is None and rows[300].error is None and len(rows[300].rgb) == rows[300].width * rows[300].height * 3
    small = op1.decode_media(spark.createDataFrame([(1, good[2])], "doc_id long, media binary"), most_pixels=100).first()
    assert small.error == "ValueError: too many pixels"


def test_op1_media_table(spark, tmp_path):
    out = op1.write_media(spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string"), str(tmp_path / "media"))
    assert sorted((r.doc_id, r.n_bytes, len(r.rgb) == r.width * r.height * 3) for r in out.collect()) == [(1, 3, True), (2, 0, True)]


def token_ids(rows, name, end=()):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path(name))
    library.no_padding(), library.no_truncation()
    return library, [[*library.encode(t or "", add_special_tokens=False).ids, *end] for _, t in rows]


def test_op2(spark, tables):
    rows, path = tables
    columns, got = rows_of("op2_training_order", spark, path)
    at = {c: i for i, c in enumerate(columns)}
    _, ids = token_ids(rows, "word_bpe_49k.json", [2])
    want = collections.Counter((i, s, len(x[s : s + 512]), zlib.crc32(np.array(x[s : s + 512], "<u4").tobytes())) for (i, _), x in zip(rows, ids, strict=True) for s in range(0, len(x), 512))
    assert collections.Counter(tuple(r[at[c]] for c in ("doc_id", "start", "length", "ids_crc32")) for r in got) == want
    assert sorted(r[at["slot"]] for r in got) == list(range(len(got)))
    n = sum(want.values())
    assert sorted(op2.feistel(np.arange(n), n, 0x5EED).tolist()) == list(range(n))


def place(i, number):
    return (1 << 62 if i is None else i, number)


def test_op3(spark, tables):
    rows, _ = tables
    # Rows that repeat id and text count once.
    lines = {(place(i, n), i, t): x.strip(SPACE) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))}
    want = []
    for i, t in rows:
        split = [] if t is None else t.split("\n")
        gone = []
        for n, x in enumerate(split):
            own = x.strip(SPACE)
            gone.append(bool(own) and any((p < place(i, n) or p == place(i, n) and (j, u) != (i, t) and order(u) < order(t)) and y and within_one(y, own) for (p, j, u), y in lines.items()))
        want.append((i, len(split), sum(gone), sha("\n".join(x for x, g in zip(split, gone, strict=True) if not g).encode())))
    order_of.clear()
    check("op3_lines", spark, tables, ["doc_id", "n_lines", "n_removed", "kept_sha256"], want)


order_of = {}


def order(text):
    """Rows of one doc_id that differ come by a hash of the text, as Spark has it."""
    if text not in order_of:
        from pyspark.sql import SparkSession

        order_of[text] = SparkSession.active().createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0]
    return order_of[text]


def test_op4(spark, tables):
    _, path = tables
    columns, got = rows_of("op4_topk", spark, path)
    assert columns[:4] == ["query_id", "rank", "vec_id", "score"]
    ints = {i: np.array([int(np.floor(64 * float(np.sin(i * j)))) for j in range(8)]) for i in range(45)}
    want = set()
    for q in (0, 20, 40):
        best = sorted((-int(ints[q] @ ints[c]), c) for c in ints if c != q)[:20]
        want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(best)}
    assert set(got) == want and len(got) == 60


def test_op5(spark, tables):
    rows, path = tables
    columns, got = rows_of("op5_packing", spark, path)
    assert columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    _, ids = token_ids(rows, "word_bpe_49k.json", [2])
    want = collections.Counter((i, s, len(x[s : s + 4096]), zlib.crc32(np.array(x[s : s + 4096], "<u4").tobytes()), len(x)) for (i, _), x in zip(rows, ids, strict=True) for s in range(0, len(x), 4096))
    assert collections.Counter(r[:5] for r in got) == want
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r[5]].append((r[6], r[2]))
    for pieces in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(pieces))])
        assert [o for o, _ in sorted(pieces)] == ends[:-1].tolist() and ends[-1] <= 4096
    assert len(sequences) <= -(-sum(map(len, ids)) // 4096) + 1


def test_op5_of_rows_without_id(spark):
    """Groups stay small, whatever ids are null or repeated."""
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two").alias("text"))
    out = pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
    groups = out.groupBy(F.shiftright("sequence_id", 32).alias("g")).count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
    assert groups[0] == 49 and groups[1] < 2500 and groups[2] == 100_000


def test_op6(spark, tables):
    rows, path = tables
    columns, got = rows_of("op6_quality", spark, path)
    assert columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert collections.Counter((r[0], r[1]) for r in got) == collections.Counter((i, i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i, _ in rows)
    assert all(0 <= s <= 1 and p == (s >= 0.5) for _, _, s, p in (r[:4] for r in got))


def test_op7(spark, tables):
    rows, path = tables
    _, got = rows_of("op7_jaccard", spark, path)
    numbered = [(n, t) for n, (_, t) in enumerate(rows)]
    sets = brute_components(numbered)
    ids = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        ids[sets[n][1]].append(i)
    least = {c: min((i for i in own if i is not None), default=None) for c, own in ids.items()}
    # A component's id is its least doc_id; documents without words stand alone.
    want = [(i, sets[n][0], least[sets[n][1]] if sets[n][0] else i) for n, (i, _) in enumerate(rows)]
    assert collections.Counter(got) == collections.Counter(want)


def test_op8(spark, tables):
    rows, _ = tables
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    count = collections.Counter(tuple(w[i : i + 35]) for _, w in split for i in range(len(w) - 34))
    want = []
    for i, w in split:
        gone = np.zeros(len(w), dtype=bool)
        for a in range(len(w) - 34):
            if count[tuple(w[a : a + 35])] > 1:
                gone[a : a + 35] = True
        want.append((i, len(w), int(gone.sum()), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    check("op8_substring", spark, tables, ["doc_id", "n_words", "n_removed", "kept_sha256"], want)


def test_op10(spark, tables):
    rows, _ = tables
    library, ids = token_ids(rows, "byte_bpe_50k.json")
    want = [(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x, skip_special_tokens=False).encode())) for (i, _), x in zip(rows, ids, strict=True)]
    check("op10_bpe", spark, tables, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)


def test_op9(spark, tables):
    from presswork.llm import op9_pii as op9

    rows, path = tables
    _, got = rows_of("op9_pii", spark, path)
    assert collections.Counter(got) == collections.Counter((i, *op9.pseudonymise_text(t, op9.DEFAULT_KEY)) for i, t in rows)
    assert not any(re.search(r"\d{13}", t or "") for _, t, n in got if n)
