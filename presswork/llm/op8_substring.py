"""Operator 8: removal of passages that repeat anywhere, by seed and extend.

A window is `length` consecutive words; each word of a window whose words also start anywhere else goes.

1. Seeds. Every window picks one of its runs of `seed` words, the one of the least hash (winnowing), so copies
   of a window pick copies of the same seed. Consecutive windows of one pick are one occurrence of that anchor,
   with the stretch of words that those windows cover.
2. Join on anchors. Occurrences are counted by anchor, and by anchor and stretch, with partial counts before the
   shuffle. Equal stretches in two places repeat as a whole, and are maximal on both sides as far as the anchor's windows
   go. Where an anchor is shared but a stretch stands alone, it must be extended word by word.
3. Extend. One occurrence of each different stretch of such an anchor is taken, and its windows - the anchor
   extended to the left and to the right in all ways - are matched with those of the others, by counting again.
   Groups are never paired up, so a passage in a third of all documents costs no more than others.
4. Windows found in 2 and 3 are merged to maximal stretches, which are cut from the texts.

Hashes: an anchor with its stretch is 128 bits, a window is 128 bits.

Nulls and odd input: a null text has no words; texts of fewer than `length` words stay whole. Rows that repeat
a text, with another or the same doc_id, count as elsewhere for each other, so all lose their windows; a null
doc_id is kept as it is. An empty table gives an empty table; other columns aren't read. Very long texts are read in one
piece, with some ten times their size in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import stored, table
from presswork.llm.textarrays import ragged, run_hashes, slices, sliding_least, span_hashes, stretch_hashes, utf8, word_spans

LENGTH = 35
SEED = 12
_PLACE_BITS = np.uint64(28)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _occurrences(length: int, seed: int):
    reach = length - seed + 1
    low_bits = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_data, all_offsets = utf8(batch.column(2))
            for first, last in slices(all_offsets):
                offsets = all_offsets[first : last + 1] - all_offsets[first]
                data = all_data[all_offsets[first] : all_offsets[last]]
                starts, ends, rows = word_spans(data, offsets)
                if len(starts) < length:
                    continue
                words = span_hashes(data, starts, ends)
                seeds = run_hashes(words, seed)
                keys = (seeds & ~low_bits) | np.arange(len(seeds), dtype=np.uint64)
                picked = (sliding_least(keys, reach) & low_bits).astype(np.int64)
                row = np.repeat(np.arange(last - first), np.diff(rows))[: len(picked)]
                valid = np.arange(len(picked)) + length <= rows[row + 1]
                window = np.flatnonzero(valid)
                if not len(window):
                    continue
                change = np.ones(len(window), dtype=bool)
                change[1:] = (picked[window[1:]] != picked[window[:-1]]) | (row[window[1:]] != row[window[:-1]])
                at = np.flatnonzero(change)
                low = window[at]
                high = window[np.append(at[1:], len(window)) - 1]
                which = row[low]
                anchor, stretch = seeds[picked[low]], stretch_hashes(words, low, high + length, 1)
                # A stretch that a text has more than once counts as often at its first place; the others, known to repeat, count 0.
                order = np.lexsort((low, stretch, anchor, which))
                same = np.logical_and.reduce([c[order[1:]] == c[order[:-1]] for c in (which, anchor, stretch)])
                heads = np.flatnonzero(np.concatenate([[True], ~same]))
                times = np.zeros(len(order), dtype=np.int64)
                times[order[heads]] = np.diff(np.append(heads, len(order)))
                take = pa.array(which + first)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take),
                        batch.column(1).take(take),
                        _signed(anchor),
                        _signed(stretch),
                        pa.array((low - rows[which]).astype(np.int32)),
                        pa.array((high - rows[which]).astype(np.int32)),
                        pa.array(times),
                    ],
                    names=["id", "h", "anchor", "stretch", "low", "high", "times"],
                )

    return run


def _windows(length: int):
    """All windows of the given occurrences of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_data, all_offsets = utf8(batch.column(2))
            lists = batch.column(3)
            spots = np.asarray(lists.offsets)
            low, high = (lists.values.field(i).to_numpy().astype(np.int64) for i in range(2))
            for first, last in slices(all_offsets):
                offsets = all_offsets[first : last + 1] - all_offsets[first]
                data = all_data[all_offsets[first] : all_offsets[last]]
                starts, ends, rows = word_spans(data, offsets)
                words = span_hashes(data, starts, ends)
                own = slice(spots[first], spots[last])
                row = np.repeat(np.arange(last - first), np.diff(spots[first : last + 1]))
                count = high[own] - low[own] + 1
                begin = ragged(low[own] + rows[row], count)
                row = np.repeat(row, count)
                for part in range(0, len(begin), 1 << 17):
                    b, r = begin[part : part + (1 << 17)], row[part : part + (1 << 17)]
                    take = pa.array(r + first)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(take),
                            batch.column(1).take(take),
                            _signed(stretch_hashes(words, b, b + length, 0)),
                            _signed(stretch_hashes(words, b, b + length, 1)),
                            pa.array((b - rows[r]).astype(np.int32)),
                        ],
                        names=["id", "h", "w1", "w2", "low"],
                    )

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_data, all_offsets = utf8(batch.column(1))
            lists = batch.column(2).fill_null([])
            spots = np.asarray(lists.offsets)
            low, high = (lists.values.field(i).to_numpy().astype(np.int64) for i in range(2))
            for first, last in slices(all_offsets):
                offsets = all_offsets[first : last + 1] - all_offsets[first]
                data = all_data[all_offsets[first] : all_offsets[last]]
                starts, ends, rows = word_spans(data, offsets)
                own = slice(spots[first], spots[last])
                base = rows[np.repeat(np.arange(last - first), np.diff(spots[first : last + 1]))]
                depth = np.zeros(len(starts) + 1, dtype=np.int32)
                np.add.at(depth, base + low[own], 1)
                np.add.at(depth, base + high[own] + length, -1)
                keep = np.cumsum(depth[:-1]) == 0
                kept = np.concatenate([[0], np.cumsum(keep)])[rows]
                s, e = starts[keep], ends[keep]
                size = e - s + 1
                text = np.append(data, np.uint8(32))[ragged(s, size)]
                total = np.concatenate([[0], np.cumsum(size)])
                text[total[1:] - 1] = 32
                begin = total[kept[:-1]]
                end = np.maximum(total[kept[1:]] - 1, begin)
                raw = text.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(np.diff(rows)),
                        pa.array(np.diff(rows) - np.diff(kept)),
                        pa.array([raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary()).cast(pa.string()),
                    ],
                    names=["id", "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """n_words, n_removed and the kept words (`kept`) of each document."""
    picked = docs.select(F.col(id_column).alias("doc"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    kind = picked.schema["doc"].dataType.simpleString()
    # Rows are told apart by id and a 64-bit hash of id and text; a null id counts as a second hash of the text. Rows
    # that agree in both are alike in all that follows.
    own = F.xxhash64("doc") if kind not in ("bigint", "int") else F.col("doc").cast("long")
    keyed = picked.select(F.when(F.col("doc").isNull(), F.xxhash64(F.lit(17), "text")).otherwise(own).alias("id"), F.xxhash64("doc", "text").alias("h"), "text", "doc")
    name = "id long, h long, "
    every = stored(keyed.select("id", "h", "text").mapInArrow(_occurrences(length, seed), name + "anchor long, stretch long, low int, high int, times long"))
    again_here, spots = every.where("times = 0").select("id", "h", "low", "high"), every.where("times > 0")
    # Most anchors are in one place only; all that follows is about the others.
    anchors = spots.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor")
    spots = stored(spots.join(anchors, "anchor", "left_semi"))
    stretches = stored(spots.groupBy("anchor", "stretch").agg(F.sum("times").alias("n"), F.min(F.struct("id", "h", "low", "high")).alias("one")))
    whole = spots.join(stretches.where("n > 1").select("anchor", "stretch"), ["anchor", "stretch"], "left_semi").select("id", "h", "low", "high").unionByName(again_here)
    uneven = stretches.where("n = 1").select("anchor").distinct()
    to_extend = stretches.join(uneven, "anchor", "left_semi").select("one.*").groupBy("id", "h").agg(F.collect_list(F.struct("low", "high")).alias("spots"))
    extended = stored(keyed.select("id", "h", "text").join(to_extend, ["id", "h"]).select("id", "h", "text", "spots").mapInArrow(_windows(length), name + "w1 long, w2 long, low int"))
    again = extended.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    partly = extended.join(again, ["w1", "w2"], "left_semi").select("id", "h", "low", F.col("low").alias("high"))
    ranges = whole.unionByName(partly).groupBy("id", "h").agg(F.collect_set(F.struct("low", "high")).alias("spots"))
    joined = keyed.join(ranges, ["id", "h"], "left").select("doc", "text", "spots")
    out = joined.mapInArrow(_cut(length), f"id {kind}, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("id", id_column)


def op8_substring(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
