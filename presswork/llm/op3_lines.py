"""Operator 3: line deduplication with a deletion-neighbourhood join.

A line (without white space at its ends) goes if an earlier line of the corpus is within the edit bound of it: the
same text or, with the bound of 1, one character put in, left out or changed. Lines of fewer than `least` characters,
where one edit is another word or number, have to be the same text. Earlier means a smaller (doc_id, line number), and an
earlier line counts whether or not it goes itself. Blank lines stay and count for nothing.

1. Equal lines: a hash aggregation gives each text's first place. Texts with a ten-thousandth of all lines are at most
   ten thousand, so their places are broadcast, and no task gets all lines of a common text.
2. Variants: a text gives, as hashed keys, the variants that it has by leaving out one character. Two texts of
   one length are one change apart if they share a variant with the same place left out; texts that differ by
   one in length are one edit apart if the variant of the longer is the shorter. Each key only needs the
   first place of its texts, so equal variants are joined with their first text, never pairwise.
3. Distances of the joined pairs are verified on the texts themselves, by what they have in common from both ends.

A variant is only made where it can meet another. Two texts within one edit agree in all but one half, so texts
that share no half with another (by hash) make none; of the rest, one edit lies in one of sixteen parts and all
others agree, so only the parts whose surroundings another text shares make variants. Both conditions are
necessary ones, so nothing is lost. All hashes come from running sums over a line's characters, so time grows with
the length of a line, also for a text of megabytes without line breaks; some two hundred bytes of memory a character.

Nulls and odd input: a null text has no lines and comes back as the empty text. A null doc_id is later than all others. Rows
that repeat both doc_id and text count as one document, so their lines don't remove each other; other rows of one
doc_id are in the order of line number, then of a hash of the text. An empty table gives an empty table; other
columns are kept as they are, whatever their names, unless they are named like the result's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import stored, table
from presswork.llm.textarrays import any_span_hashes, mix, ragged, slices, utf8, word_spans

PARTS = 16
LAST = (1 << 63) - 1


#: An edit in fewer characters than this is no copy.
LEAST = 16
#: Rows that a task gives on at once, and bytes of lines that it has in hand.
ROWS, BYTES = 50_000, 1 << 18


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character of UTF-8 text, and where each row's begin."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    sizes = np.diff(np.append(starts, len(data)))
    values = data[starts].astype(np.uint64)
    for k in (1, 2, 3):
        more = np.flatnonzero(sizes > k)
        values[more] |= data[starts[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return values, np.searchsorted(starts, offsets)


class Sums:
    """Two 64-bit hashes of stretches of characters, and of two stretches as one text, from running sums."""

    def __init__(self, values: np.ndarray):
        n = len(values) + 1
        self.totals, self.backs = [], []
        for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            powers = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, b, dtype=np.uint64)]))
            self.totals.append(np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((values + np.uint64(1)) * powers(base)[: len(values)])]))
            self.backs.append(powers(pow(base, -1, 1 << 64)))

    def joined(self, s: np.ndarray, a: np.ndarray, b: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
        """Of characters s to a and b to e as one text."""
        length = (a - s + e - b).astype(np.uint64)
        return [mix((t[a] - t[s]) * back[s] + (t[e] - t[b]) * back[b - a + s] + length) for t, back in zip(self.totals, self.backs, strict=True)]


def _tagged(hashes: list[np.ndarray], *tags: np.ndarray) -> list[np.ndarray]:
    for tag in tags:
        hashes = [mix(h + mix(tag.astype(np.uint64) + np.uint64(0x5EED + i))) for i, h in enumerate(hashes)]
    return hashes


def _edge(n: np.ndarray, j: np.ndarray) -> np.ndarray:
    return n * j // PARTS


def surroundings(values: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, list[np.ndarray]]]:
    """(rows, how much longer they are than their partner, part, hashes of all but this part) for partners of their own length and one less."""
    sums, length = Sums(values), np.diff(at)
    for longer in (0, 1):
        n = length - longer
        for j in range(PARTS):
            low, high = _edge(n, j), _edge(n, j + 1)
            use = (low < high) & (n >= 0)
            if longer:
                use = (n >= 0) & (use | (j in (0, PARTS - 1)) | (low > _edge(n, j - 1)))
            rows = np.flatnonzero(use)
            s, e = at[rows], at[rows + 1]
            yield rows, longer, j, _tagged(sums.joined(s, s + low[rows], e - (n[rows] - high[rows]), e), n[rows], np.full(len(rows), j))


def variants(values: np.ndarray, at: np.ndarray, row: np.ndarray, longer: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(rows, kinds, hashes) of the variants in the given parts of rows. Kinds: 0 a changed place, 1 the line itself, 2 the line less a character."""
    sums, length = Sums(values), np.diff(at)
    own = np.unique(row[longer == 0])
    yield own, np.full(len(own), 1), sums.joined(at[own], at[own + 1], at[own + 1], at[own + 1])
    n = length[row] - longer
    low, count = _edge(n, part), _edge(n, part + 1) + longer - _edge(n, part)
    ends = np.cumsum(count)
    first = 0
    while first < len(row):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + ROWS, side="right")))
        own = np.repeat(row[first:last], count[first:last])
        i = ragged(low[first:last], count[first:last])
        kind = np.repeat(np.where(longer[first:last] == 1, 2, 0), count[first:last])
        s, e = at[own], at[own + 1]
        hashes = sums.joined(s, s + i, s + i + 1, e)
        placed = _tagged(hashes, i + 1)
        yield own, kind, [np.where(kind == 0, p, h) for p, h in zip(placed, hashes, strict=True)]
        first = last


def within_one(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two rows of characters are at most one edit apart: they agree from both ends, up to that."""
    if len(one) > len(two):
        one, two = two, one
    n = len(one)
    if len(two) - n > 1:
        return False
    differ = np.flatnonzero(one != two[:n])
    front = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(one[::-1] != two[::-1][:n])
    back = int(differ[0]) if len(differ) else n
    return front + back >= len(two) - 1


def _longs(columns: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(c.view(np.int64)) for c in columns]


def _around(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(l1, longer, part, k1, k2) of lines (l1, line)."""
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for first, last in slices(offsets, BYTES):
                values, at = characters(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                for rows, longer, j, keys in surroundings(values, at):
                    # The shorter of two lines has to have `least` characters.
                    rows, keys = (x[np.diff(at)[rows] - longer >= least] for x in (rows, np.stack(keys, axis=1)))
                    if len(rows):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(rows + first)), *(pa.array(np.full(len(rows), x, dtype=np.int32)) for x in (longer, j)), *_longs([keys[:, 0].copy(), keys[:, 1].copy()])],
                            names=["l1", "longer", "part", "k1", "k2"],
                        )

    return run


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(l1, l2, id, no, h, kind, v1, v2) of lines (l1, l2, id, no, h, line, spots)."""
    for batch in batches:
        data, offsets = utf8(batch.column(5))
        lists = batch.column(6)
        spots = np.asarray(lists.offsets)
        longer, part = (lists.values.field(i).to_numpy().astype(np.int64) for i in range(2))
        for first, last in slices(offsets, BYTES):
            values, at = characters(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            row = np.repeat(np.arange(last - first), np.diff(spots[first : last + 1]))
            own = slice(spots[first], spots[last])
            for rows, kind, keys in variants(values, at, row, longer[own], part[own]):
                take = pa.array(rows + first)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(take) for i in range(5)), pa.array(kind.astype(np.int32)), *_longs(keys)], names=["l1", "l2", "id", "no", "h", "kind", "v1", "v2"]
                )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, no, h) of pairs (id, no, h, line, earlier) at most one edit apart."""
    for batch in batches:
        sides = []
        for column in (3, 4):
            data, offsets = utf8(batch.column(column))
            sides.append((data, offsets))
        whole = [lambda i, d=d, o=o: characters(d[o[i] : o[i + 1]], np.zeros(1, dtype=np.int64))[0] for d, o in sides]
        keep = pa.array(np.array([within_one(whole[0](i), whole[1](i)) for i in range(batch.num_rows)], dtype=bool))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(3)], names=["id", "no", "h"])


def _parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The rows again in batches of about a megabyte of text, so that what is made of them stays small whatever comes in one batch."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        for first, last in slices(offsets):
            yield batch.slice(first, last - first)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, no, two hashes of the line, four hashes of halves) of every line that isn't blank."""
    for batch in _parts(batches, "text"):
        data, offsets = utf8(batch.column(2))
        breaks = np.flatnonzero(data == 10)
        row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
        starts = np.concatenate([offsets[:-1], breaks + 1])
        ends = np.concatenate([offsets[1:], breaks])
        rows = np.concatenate([np.arange(batch.num_rows), row_of_break])
        # Starts go up within a row, and ends with them; sorting both by row keeps them matched.
        order, end_order = np.lexsort((starts, rows)), np.lexsort((ends, rows))
        starts, rows, ends = starts[order], rows[order], ends[end_order]
        number = np.arange(len(rows)) - np.searchsorted(rows, rows)
        words, stops, _ = word_spans(data, np.unique(np.concatenate([starts, offsets])))
        low, high = np.searchsorted(words, starts), np.searchsorted(words, ends)
        full = high > low
        begin, end, rows, number = words[low[full]], stops[high[full] - 1], rows[full], number[full]
        bounds = np.append(begin, end[-1:] if len(end) else 0)
        for a, b in slices(bounds, BYTES):
            base = int(begin[a])
            part, s, e = data[base : int(end[b - 1])], begin[a:b] - base, end[a:b] - base
            # Halves are of characters: where each begins, and the first one of each line.
            chars = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))
            c0, c1 = np.searchsorted(chars, s), np.searchsorted(chars, e)
            spans, tags = [], []
            for longer in (0, 1):
                n = c1 - c0 - longer
                half = n // 2
                spans += [(s, chars[c0 + half]), (chars[c1 - (n - half)], e)]
                tags.append(n.astype(np.uint64))
            one = any_span_hashes(part, [(s, e), *spans])
            (two,) = any_span_hashes(part, [(s, e)], 1)
            halves = [mix(x + tags[i // 2] * np.uint64(8) + np.uint64(i % 2)) for i, x in enumerate(one[1:])]
            take = pa.array(rows[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(number[a:b].astype(np.int32)), *(pa.array(x.view(np.int64)) for x in (one[0], two, *halves))],
                names=["id", "h", "no", "l1", "l2", "a1", "a2", "b1", "b2"],
            )


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that `picks` names, with their hashes."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    for batch in _parts(batches, "text"):
        out: list[tuple] = []
        for id_, h, text, picks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            split = text.split("\n")
            out += [(p["l1"], p["l2"], id_, p["no"], h, split[p["no"]].strip(" \t\n\v\f\r")) for p in picks]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["l1", "l2", "id", "no", "h", "line"])


def earlier_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bound: int = 1, least: int = LEAST) -> DataFrame:
    """The place (id, no, and h, the hash of the text) of every line that goes; a null id is the largest long. `bound`: 0 or 1."""
    if bound not in (0, 1):
        raise ValueError("the bound is 0 or 1 edit")
    texts = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)).alias("id"), F.col(text_column).cast("string").alias("text")).withColumn("h", F.xxhash64("text")).where("text <> ''")
    lines = stored(texts.select("id", "h", "text").mapInArrow(_lines, "id long, h long, no int, l1 long, l2 long, a1 long, a2 long, b1 long, b2 long"))
    place = F.struct("id", "no", "h")
    first = stored(lines.groupBy("l1", "l2").agg(F.min(place).alias("at"), F.count("*").alias("n")))
    # No more than ten thousand texts can have a ten-thousandth of all lines each.
    often = max(1000, lines.count() // 10_000)
    common = F.broadcast(first.where(F.col("n") > often).select("l1", "l2", "at"))
    own = lines.select("id", "no", "h", "l1", "l2")
    rare = own.join(common.select("l1", "l2"), ["l1", "l2"], "left_anti").join(first.where((F.col("n") > 1) & (F.col("n") <= often)), ["l1", "l2"])
    again = own.join(common, ["l1", "l2"]).select("id", "no", "h", "at").unionByName(rare.select("id", "no", "h", "at")).where(place != F.col("at")).select("id", "no", "h")
    if bound == 0:
        return again.distinct()

    halves = lines.select("l1", "l2", F.explode(F.array("a1", "a2", "b1", "b2")).alias("half"))
    shared = halves.groupBy("half").agg(F.min("l1").alias("low"), F.max("l1").alias("high")).where("low < high").select("half")
    likely = halves.join(shared, "half", "left_semi").select("l1", "l2").distinct().join(first, ["l1", "l2"]).select("l1", "l2", "at.id", "at.no", "at.h")
    picks = likely.groupBy("id", "h").agg(F.collect_list(F.struct("no", "l1", "l2")).alias("picks"))
    found = texts.join(picks, ["id", "h"]).select("id", "h", "text", "picks").mapInArrow(_pick, "l1 long, l2 long, id long, no int, h long, line string")
    kept = stored(found.dropDuplicates(["l1", "l2"]))

    spots = stored(kept.select("l1", "line").mapInArrow(_around(least), "l1 long, longer int, part int, k1 long, k2 long"))
    meeting = spots.groupBy("k1", "k2").agg(F.min("l1").alias("low"), F.max("l1").alias("high")).where("low < high").select("k1", "k2")
    chosen = spots.join(meeting, ["k1", "k2"], "left_semi").groupBy("l1").agg(F.collect_set(F.struct("longer", "part")).alias("spots"))
    made = stored(kept.join(chosen, "l1").select("l1", "l2", "id", "no", "h", "line", "spots").mapInArrow(_made, "l1 long, l2 long, id long, no int, h long, kind int, v1 long, v2 long"))
    one = F.struct("id", "no", "h", "l1", "l2")
    firsts = made.groupBy("v1", "v2").agg(*(F.min(F.when(F.col("kind") == k, one)).alias(f"p{k}") for k in range(3)))
    partner = F.when(F.col("kind") == 0, F.col("p0")).when(F.col("kind") == 1, F.col("p2")).otherwise(F.col("p1"))
    joined = made.join(firsts, ["v1", "v2"]).select("l1", "l2", "id", "no", "h", partner.alias("p")).where("p IS NOT NULL AND struct(p.id, p.no, p.h) < struct(id, no, h)")
    pairs = joined.select("l1", "l2", "id", "no", "h", F.col("p.l1").alias("q1"), F.col("p.l2").alias("q2")).distinct()
    text = kept.select("l1", "l2", "line")
    other = kept.select(F.col("l1").alias("q1"), F.col("l2").alias("q2"), F.col("line").alias("earlier"))
    near = pairs.join(text, ["l1", "l2"]).join(other, ["q1", "q2"]).select("id", "no", "h", "line", "earlier").mapInArrow(_verified, "id long, no int, h long")
    return again.unionByName(near).distinct()


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches, "text"):
        out, lines, gone = [], [], []
        for text, drops in zip(batch.column("text").to_pylist(), batch.column("drops").to_pylist(), strict=True):
            if not drops:
                out.append(text or "")
                lines.append(0 if text is None else text.count("\n") + 1)
                gone.append(0)
                continue
            split, drop = text.split("\n"), set(drops)
            out.append("\n".join(x for i, x in enumerate(split) if i not in drop))
            lines.append(len(split))
            gone.append(len(drop))
        names = [n for n in batch.schema.names if n not in ("text", "drops")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.string()), pa.array(np.array(lines, dtype=np.int64)), pa.array(np.array(gone, dtype=np.int64))], names=[*names, "text", "n_lines", "n_removed"])


def drop_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bound: int = 1, least: int = LEAST) -> DataFrame:
    """The documents with the kept lines as their text, and the columns n_lines and n_removed."""
    gone = earlier_lines(docs, id_column, text_column, bound, least).groupBy(F.col("id").alias("_at"), F.col("h").alias("_h")).agg(F.collect_set("no").alias("drops"))
    rest = [c for c in docs.columns if c not in (text_column, "n_lines", "n_removed")]
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.col(text_column).cast("string").alias("text"))
    at = F.coalesce(F.col(f"c{rest.index(id_column)}").cast("long"), F.lit(LAST))
    joined = named.withColumn("_at", at).withColumn("_h", F.xxhash64("text")).join(gone, ["_at", "_h"], "left").drop("_at", "_h")
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))
    out = joined.mapInArrow(_drop, f"{kinds}, text string, n_lines long, n_removed long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), F.col("text").alias(text_column), "n_lines", "n_removed")


def op3_lines(spark, sf_dir: str) -> DataFrame:
    out = drop_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
