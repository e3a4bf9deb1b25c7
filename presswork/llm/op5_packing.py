"""Operator 5: packing token pieces into sequences of a fixed length.

Documents are cut into pieces of at most the sequence length. The names and lengths of pieces, without their ids, are
written with a number of their own each. Pieces go to randomised groups of about `group_pieces` by a hash of that
number, whatever their doc_id, and each group is packed on its own by first-fit decreasing: a tournament tree over
the free room of the bins finds the leftmost bin that takes a piece in logarithmic time. Token ids are never shuffled.

Nulls and odd input: a null or empty text is one piece with only the end id. Rows that repeat a document are
packed each on its own, as are rows without a doc_id, which stay so. A very long text gives as many pieces as it needs;
its ids are in memory at once. Pieces of equal length go in the order of doc_id, start and number. An empty table
gives an empty table. Of `docs` only the id and the text are read, so other columns' names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.bpe import encoder
from presswork.llm.common import stored, table, tokenizer_path

GROUP_PIECES = 2048


def _cut(path: str, length: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for first, offsets, ids in coder.encode(batch.column(1)):
                rows = np.arange(len(offsets) - 1)
                total = np.diff(offsets) + 1
                with_end = np.insert(ids, offsets[1:], np.uint32(end_id))
                begin = offsets[:-1] + rows
                parts = -(-total // length)
                row = np.repeat(rows, parts)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * length
                size = np.minimum(total[row] - start, length)
                at = np.append(begin[row] + start, len(with_end))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + row)),
                        pa.array(start),
                        pa.array(size),
                        pa.array(total[row]),
                        pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(with_end.astype("<u4"))]),
                    ],
                    names=["id", "start", "length", "doc_tokens", "ids"],
                )

    return run


def cut(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of each document's ids with the end id: start, length, doc_tokens and the ids themselves."""
    picked = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    out = picked.mapInArrow(_cut(path, length, end_id), f"id {kind}, start long, length long, doc_tokens long, ids binary")
    return out.withColumnRenamed("id", id_column)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces come longest first. A node of the tree holds the most room below it."""
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    free = [room] * (2 * leaves)
    bins, offsets = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for i, size in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, room - free[node]
        free[node] -= size
        node >>= 1
        while node:
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
            node >>= 1
    return bins, offsets


def _pack_group(length: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("id", "ascending"), ("start", "ascending"), ("number", "ascending")])
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), length)
        number = group["group_no"].to_numpy() * (1 << 32) + bins
        return group.drop_columns(["group_no", "number"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offsets))

    return run


def pack(pieces: DataFrame, length: int = 4096, group_pieces: int = GROUP_PIECES, id_column: str = "doc_id") -> DataFrame:
    """Gives each piece (id, start, length and any other columns) a sequence_id and its offset there.

    Pieces and their numbers are written first: a task that is done again reads the same ones.
    """
    named = pieces.withColumnRenamed(id_column, "id")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema)
    staged = stored(named.withColumn("number", F.monotonically_increasing_id()))
    groups = max(1, -(-staged.count() // group_pieces))
    salted = staged.withColumn("group_no", F.pmod(F.xxhash64("number", F.lit(20240607)), F.lit(groups)).cast("long"))
    return salted.groupBy("group_no").applyInArrow(_pack_group(length), kinds + ", sequence_id long, offset long").withColumnRenamed("id", id_column)


def pack_documents(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces of all documents with their checksum and place."""
    return pack(cut(docs, path, length, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids"), length)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
