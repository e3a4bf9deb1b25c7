"""Operator 12 against a plain tree in Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from presswork.llm import op12_merkle as op12
from presswork.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g long, place long, node string"


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(nodes):
    """(root, for each node its levels of (place, run))."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            path.append((i % 3, nodes[i - i % 3 : i - i % 3 + 3]))
        nodes = [h(nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def plain(rows):
    sources = {}
    for doc_id, text, lang, source, n_chars in rows:
        sources.setdefault(source, []).append((doc_id is not None, doc_id or 0, plain_leaf(doc_id, source, lang, n_chars, text), (doc_id, text, lang, source, n_chars)))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([r[2] for r in sorted(sources[s], key=lambda r: r[:3])]) for s in order]
    root, upper = plain_tree([t[0] for t in trees])
    out = []
    for s, (subroot, paths), up in zip(order, trees, upper, strict=True):
        for (*_, leaf, (doc_id, text, lang, source, n_chars)), path in zip(sorted(sources[s], key=lambda r: r[:3]), paths, strict=True):
            siblings = [x for place, run in path + up for i, x in enumerate(run) if i != place]
            changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
            node = plain_leaf(doc_id, source, lang, n_chars, text.replace("\n", "") if changed else text)
            for place, run in path + up:
                node = h(node if i == place else x for i, x in enumerate(run))
            out.append((doc_id, leaf, subroot, root, h(siblings), node, node == root))
    return out


def odd_rows():
    rows = [(i, f"text {i}\nof {i % 7}" if i % 3 else "one line", "en", "hot" if i % 3 else f"s{i % 11}", i) for i in range(400)]
    rows += [(None, None, None, None, None), (None, "x\ny", None, None, 3), (7, "again\n7", "de", "hot", 1), (7, "again\n7", "de", "hot", 1), (7, "other", "de", "hot", 1)]
    rows += [(2**60 + i, "big\n", "fr", "ünï", -1) for i in range(5)] + [(-3, "", "", "", 0), (900, "lone\n" * 5000, "x", "Zlone", 2)]
    return rows


def write(spark, path, rows):
    spark.createDataFrame([(*r, "a", 1, 2, "b") for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_query(spark, tmp_path, monkeypatch):
    rows = odd_rows()
    got = QUERIES["op12_merkle"](spark, write(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, plain(rows)))


@pytest.mark.parametrize("levels", [1, 2])
def test_small_superblocks(spark, levels):
    """The same result from more superblocks, whose groups end on different floors."""
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "a", 1, 2, "b") for r in rows], SCHEMA)
    leaves = docs.select("doc_id", "source", op12.leaf_of(*(F.col(c) for c in op12.COLUMNS)).alias("leaf"))
    out = op12.merkle_manifest(leaves, levels=levels).select("doc_id", "leaf", "subroot", "root", F.sha2("siblings", 256).alias("p"), op12.fold(F.col("leaf"), F.col("shape"), F.col("siblings")).alias("f"))
    got = sorted(map(str, map(tuple, out.collect())))
    assert got == sorted(str((*r[:5], r[3])) for r in plain(rows))


def test_one_row_and_none(spark, tmp_path):
    rows = [(5, "a\nb", "en", "s", 3)]
    assert list(map(tuple, QUERIES["op12_merkle"](spark, write(spark, tmp_path / "one", rows)).collect())) == plain(rows)
    assert QUERIES["op12_merkle"](spark, write(spark, tmp_path / "none", [])).collect() == []


def test_changed_rows_are_found(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    out = op12.merkle_manifest(docs)
    root = op12.fold(F.when(F.col("doc_id") == 9, F.sha2(F.lit("forged"), 256)).otherwise(F.col("leaf")), F.col("shape"), F.col("siblings"))
    assert [r.doc_id for r in out.where(root != F.col("root")).collect()] == [9]
