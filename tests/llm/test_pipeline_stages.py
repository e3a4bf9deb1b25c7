"""Every stage of the pipeline on odd rows, and the near copies against a plain version with repeated rows."""

import collections
import zlib

import numpy as np
import pytest
from test_text_operators import brute_components

from presswork.llm import op9_pii as op9

pipeline = pytest.importorskip("corpus_pipeline")
# The names clash with inner ones of the stages.
EXTRA = ["id", "key", "row", "score", "n_removed", "n_replaced", "h", "c0"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)
LONG = "a line of a long text\n" + "\n".join(f"number {i} of a long text with many lines" for i in range(20_000))
TEXTS = [(1, "One line that is here twice.\nAnd a line of its own."), (2, "One line that is here twice.\nAnother line, of two."), (3, None), (4, ""), (4, ""), (None, "No id at all, but a mail a.b@c.com"), (None, None), (5, LONG), (6, "same same"), (6, "same same"), (7, "\n\n")]


@pytest.fixture(scope="module")
def labels(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *EXTRA) for i, t in rows], SCHEMA)


def rows(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


@pytest.mark.parametrize("name", [name for name, _ in pipeline.STAGES])
def test_empty_tables(spark, labels, name):
    out = dict(pipeline.STAGES)[name](spark, frame(spark, []), labels)
    assert out.count() == 0 and (name == "packing" or out.columns == pipeline.COLUMNS)


def test_quality(spark, labels):
    out = pipeline.quality(spark, frame(spark, TEXTS), labels)
    assert out.columns == pipeline.COLUMNS and rows(out) == collections.Counter(TEXTS)


def test_lines(spark, labels):
    out = pipeline.lines(spark, frame(spark, TEXTS), labels)
    want = collections.Counter((i, t or "") for i, t in TEXTS)
    want[2, "One line that is here twice.\nAnother line, of two."] -= 1
    want[2, "Another line, of two."] += 1
    # Numbers of two digits or more have a neighbour within one edit before them.
    kept = rows(out)
    long = next(t for i, t in kept if i == 5)
    assert long.startswith("a line of a long text\nnumber 0 of") and len(long) < len(LONG)
    want[5, LONG] -= 1
    want[5, long] += 1
    assert kept == +want and all(r.n_chars == len(r.text) for r in out.collect())


def test_near_copies(spark, labels):
    out = pipeline.near_copies(spark, frame(spark, TEXTS), labels)
    unique = list(dict.fromkeys(TEXTS))
    roots = brute_components(list(enumerate(t for _, t in unique)))
    assert out.columns == pipeline.COLUMNS and rows(out) == collections.Counter(x for n, x in enumerate(unique) if roots[n][1] == n)


def test_private(spark, labels):
    out = pipeline.private(spark, frame(spark, TEXTS), labels)
    assert rows(out) == collections.Counter((i, op9.pseudonymise_text(t, op9.DEFAULT_KEY)[0]) for i, t in TEXTS)


def test_packing(spark, labels):
    from tokenizers import Tokenizer

    from presswork.llm.common import tokenizer_path

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in TEXTS]
    want = collections.Counter((i, s, len(x[s : s + 4096]), zlib.crc32(np.array(x[s : s + 4096], "<u4").tobytes()), len(x)) for i, x in ids for s in range(0, len(x), 4096))
    out = pipeline.packing(spark, frame(spark, TEXTS), labels).collect()
    assert collections.Counter(tuple(r)[:5] for r in out) == want
