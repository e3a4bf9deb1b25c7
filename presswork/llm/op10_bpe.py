"""Operator 10: BPE encoding and decoding of whole texts with a public tokenizer file.

The encoding itself is in `bpe.py`: a segment tree over the ranks of adjacent pairs gives the leftmost merge
of the lowest rank, many pretokens at a time. There is no shuffle: each row is encoded where it is read.

Nulls and odd input: a null or empty text has no ids and decodes to the empty text. Special tokens in a text
get their ids, as in the `tokenizers` library. Repeated rows are encoded each on its own. Other columns of
the input, whatever their names, aren't read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.bpe import encoder
from presswork.llm.common import table, tokenizer_path


def _binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(values)])


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for first, offsets, ids in coder.encode(batch.column(1)):
                rows = len(offsets) - 1
                text, text_offsets = coder.decode(ids, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), _binary(ids.astype("<u4"), offsets * 4).cast(pa.binary()), _binary(text, text_offsets).cast(pa.binary())],
                    names=["id", "ids", "decoded"],
                )

    return run


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's ids (`ids`, little-endian unsigned 32-bit) and the bytes that they decode to (`decoded`)."""
    picked = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(_encode(path), f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_column)


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    out = encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.decode("decoded", "UTF-8").cast("binary"), 256).alias("decoded_sha256"),
    )
