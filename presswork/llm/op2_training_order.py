"""Operator 2: token sequences written in a keyed training order, as shards of fixed stride.

1. Documents are tokenized and cut into sequences, which are written once with a dense number per task.
2. The number of a sequence among all (the task's base plus its own) goes through a keyed Feistel network
   over the next even power of two; numbers beyond the count walk the cycle until they fall inside. So every
   sequence gets its own slot in 0 .. n - 1, and any slot's sequence can be told from the key alone.
3. Sequences are range partitioned by slot. Each partition writes whole shards: `per_shard` records of `stride`
   bytes each, slot `s` being in shard `s div per_shard` at byte `(s mod per_shard) * stride`. A reader that
   stopped at slot s goes on at that shard and byte, without reading what is before.

A record is doc_id (8 bytes), start (8), length (4), four bytes 0, then `length` ids and zeros. Ids have two bytes,
or four where the tokenizer has more than 65,536; each shard says how many. A shard is one compressed cell of a Parquet
file, so a reader that resumes loads its first shard whole (`per_shard` * `stride` bytes) and goes on from the byte.

Nulls and odd input: a null or empty text is one sequence with only the end id; a null doc_id is stored as the
smallest long and read back as null. Repeated rows get a slot each. A very long text gives as many sequences as it
needs; its ids are in memory at once. An empty table gives no shards. Only doc_id and text are read, so other columns'
names don't matter.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswork.llm.common import shared_dir, table, tokenizer_path
from presswork.llm.op5_packing import cut

HEAD = 24
ROUNDS = 6
NO_ID = -(1 << 63)
#: Rows of 16 bytes, one for each task that wrote; with more of them the join is left to Spark.
MOST_BROADCAST = 100_000
TASK_BYTES = 256 << 20
SHARDS = "shard long, records int, id_bytes int, payload binary"


def vocabulary(tokenizer: str) -> int:
    """One more than the largest id of a tokenizer file."""
    with open(tokenizer, encoding="utf-8") as f:
        own = json.load(f)
    return 1 + max([*own["model"]["vocab"].values(), *(t["id"] for t in own.get("added_tokens", []))], default=0)


def _round(half: np.ndarray, key: int, number: int) -> np.ndarray:
    x = (half + np.uint64(key & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def feistel(values: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0 .. n - 1, or its inverse."""
    bits = max(1, (max(n, 2) - 1).bit_length() + 1 >> 1)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = values.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (_round(left, key, i) & mask), left
            else:
                left, right = right, left ^ (_round(right, key, i) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _number(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), dtype="<u4")
            if len(ids) and int(ids.max()) >> 8 * width:
                raise ValueError(f"an id of {int(ids.max())} doesn't fit into {width} bytes")
            at = np.concatenate([[0], np.cumsum(batch.column("length").to_numpy())]) * width
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("start"),
                    batch.column("length").cast(pa.int32()),
                    pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))]),
                    pa.array(np.full(rows, part, dtype=np.int32)),
                    pa.array(np.arange(seen, seen + rows, dtype=np.int64)),
                ],
                names=["doc_id", "start", "length", "ids", "part", "own"],
            )
            seen += rows

    return run


def _shards(per_shard: int, length: int, width: int):
    stride = HEAD + width * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Records come in the order of their slots, and a shard's records are all in one partition."""
        current, room, filled = None, None, 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array([current]), pa.array([filled], pa.int32()), pa.array([width], pa.int32()), pa.array([room[: filled * stride].tobytes()])], names=["shard", "records", "id_bytes", "payload"])
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            heads = np.zeros(batch.num_rows, dtype=[("id", "<i8"), ("start", "<i8"), ("length", "<i4"), ("pad", "<i4")])
            heads["id"] = batch.column("doc_id").fill_null(NO_ID).to_numpy()
            heads["start"], heads["length"] = batch.column("start").to_numpy(), batch.column("length").to_numpy()
            for slot, head, ids in zip(slots.tolist(), heads, batch.column("ids").to_pylist(), strict=True):
                if slot // per_shard != current:
                    if current is not None:
                        yield done()
                    current, room, filled = slot // per_shard, np.zeros(per_shard * stride, dtype=np.uint8), 0
                at = slot % per_shard * stride
                room[at : at + HEAD] = np.frombuffer(head.tobytes(), dtype=np.uint8)
                room[at + HEAD : at + HEAD + len(ids)] = np.frombuffer(ids, dtype=np.uint8)
                filled = slot % per_shard + 1
        if current is not None:
            yield done()

    return run


def write_training_order(docs: DataFrame, tokenizer: str, out: str, key: int, length: int = 512, per_shard: int = 512, end_id: int = 2, id_bytes: int | None = None) -> int:
    """Writes the shards to the folder `out`; returns the number of sequences. `id_bytes`: 2 or 4, else as the tokenizer needs."""
    spark = docs.sparkSession
    width = id_bytes or (2 if vocabulary(tokenizer) <= 1 << 16 and end_id < 1 << 16 else 4)
    pieces = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer, length, end_id)
    staged_at = shared_dir(spark)
    kinds = "doc_id long, start long, length int, ids binary, part int, own long"
    pieces.mapInArrow(_number(width), kinds).write.option("compression", "zstd").parquet(staged_at)
    staged = spark.read.schema(kinds).parquet(staged_at)
    # A row for each task that wrote: the bases come from a running total of their counts.
    counts = staged.groupBy("part").count()
    bases = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("base"))
    n, tasks = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    if tasks <= MOST_BROADCAST:
        bases = F.broadcast(bases)

    @F.pandas_udf("long")
    def slot_of(number: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), n, key))

    slots = staged.join(bases, "part").select("doc_id", "start", "length", "ids", slot_of(F.col("base") + F.col("own")).alias("slot"))
    shards = max(1, -(-n // per_shard))
    # A partition holds about `TASK_BYTES` at most, however large the corpus is.
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * (HEAD + width * length) // TASK_BYTES))
    partitions = max(1, min(shards, wanted))
    ordered = slots.withColumn("shard", F.floor(F.col("slot") / per_shard)).repartitionByRange(partitions, "shard").sortWithinPartitions("slot")
    written = ordered.select("doc_id", "start", "length", "ids", "slot").mapInArrow(_shards(per_shard, length, width), SHARDS)
    written.write.option("compression", "zstd").parquet(out)
    return n


def read_training_order(spark: SparkSession, path: str, length: int = 512, per_shard: int = 512, first_slot: int = 0) -> DataFrame:
    """The sequences from slot `first_slot` on: slot, doc_id, start, length, ids, shard and byte offset.

    Only the shards from that slot's shard on are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, width, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                kind = np.dtype([("id", "<i8"), ("start", "<i8"), ("length", "<i4"), ("pad", "<i4"), ("ids", f"<u{width}", (length,))])
                records = np.frombuffer(payload.as_buffer(), dtype=kind)
                place = np.arange(len(records), dtype=np.int64)
                slots = place + shard * per_shard
                keep = slots >= first_slot
                records, place, slots = records[keep], place[keep], slots[keep]
                sizes = records["length"].astype(np.int64)
                ids = records["ids"][np.arange(length) < sizes[:, None]].astype("<u4")
                at = np.concatenate([[0], np.cumsum(sizes)]) * 4
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slots),
                        pa.array(records["id"].copy(), mask=records["id"] == NO_ID),
                        pa.array(records["start"].copy()),
                        pa.array(sizes),
                        pa.Array.from_buffers(pa.binary(), len(slots), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)]),
                        pa.array(np.full(len(slots), shard, dtype=np.int64)),
                        pa.array(place * kind.itemsize),
                    ],
                    names=["slot", "doc_id", "start", "length", "ids", "shard", "byte_offset"],
                )

    shards = spark.read.schema(SHARDS).parquet(path).where(F.col("shard") >= first_slot // per_shard)
    return shards.select("shard", "id_bytes", "payload").mapInArrow(run, "slot long, doc_id long, start long, length long, ids binary, shard long, byte_offset long")


def op2_training_order(spark, sf_dir: str) -> DataFrame:
    """All of `documents` in training order, read back from the shards."""
    out = shared_dir(spark)
    write_training_order(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), out, key=0x5EED)
    return read_training_order(spark, out).select("slot", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "shard", "byte_offset")
