"""Operator 6: document quality by a linear-chain conditional random field over lines.

Every line has features of its own bytes and words and of the lines before and after it. A chain with two
labels (good, bad) over the lines of a document is fitted to labelled documents, all lines of which carry the
document's label. Scoring takes forward-backward marginals of every line; their mean, weighted by line length,
goes through a logistic curve that is fitted on the same documents, and is the score.

Since labels are known for whole documents only, the chain sees no change of label when it is fitted; a document's
own lines then differ by their features and by what the lines around them say.

The fit uses at most `sample` labelled documents (those of the least hashes of doc_id; of these, texts of up to
`longest` characters and `most_lines` lines): their line features, not their texts, come to the driver, which bounds
them to `sample` * `most_lines` rows of 160 bytes. Scoring reads all rows and whole texts, where they are, without a
shuffle; a text of many lines is scored in blocks of lines, so memory grows by about a hundred bytes a line.
Language, source, doc_id and labels are no features.

Nulls and odd input: a null or empty text is one empty line. Labels that are null or neither 0 nor 1 aren't
used; of repeated labels of a document the smallest counts, and of rows that repeat a doc_id the least text is fitted.
Without both labels in the sample every document scores the share of label 1, (ones + 1/2) / (labels + 1): 0.5 without
any. Repeated rows score alike. An empty table gives an empty table. Columns are kept whatever their names, but for
one named `score`, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import table
from presswork.llm.textarrays import slices, span_hashes, utf8, word_spans

SAMPLE = 3000
LONGEST = 20_000
MOST_LINES = 200
#: Lines of a text that are scored at once.
BLOCK = 16_384

_KINDS = np.zeros((6, 256), dtype=bool)  # letters, capitals, digits, symbols, exclamation marks, bars
_KINDS[0, [*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = True
_KINDS[1, 65:91] = True
_KINDS[2, 48:58] = True
_KINDS[3, [ord(c) for c in "#$%&*@^~<>{}[]=+_/\\|"]] = True
_KINDS[4, ord("!")] = True
_KINDS[5, ord("|")] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?:;\"'"]] = True
OWN = 13
FEATURES = 1 + 3 * OWN


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, its length in bytes, and each row's first line (one entry more than rows)."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    # A line ends at each line break and at the end of its row.
    is_row = np.concatenate([np.zeros(len(breaks), dtype=bool), np.ones(rows, dtype=bool)])
    stops = np.concatenate([breaks, offsets[1:]])
    # Where a row ends, the next one may begin with a line break: the end comes first.
    order = np.lexsort((~is_row, stops))
    stops, is_row = stops[order], is_row[order]
    lines = len(stops)
    starts = np.empty(lines, dtype=np.int64)
    if lines:
        starts[0] = 0
        starts[1:] = stops[:-1] + ~is_row[:-1]
    firsts = np.concatenate([[0], np.flatnonzero(is_row) + 1])
    length = stops - starts
    size = np.maximum(length, 1).astype(np.float64)

    def within(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return total[stops] - total[starts]

    letters, capitals, digits, symbols, cries, bars = (within(k[data]) for k in _KINDS)
    if len(data) > 1:
        accented = np.zeros(len(data), dtype=bool)
        accented[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        capitals = capitals + within(accented)
    edges = np.unique(np.concatenate([starts, offsets]))
    begin, end, _ = word_spans(data, edges)
    low, high = np.searchsorted(begin, starts), np.searchsorted(begin, stops)
    words = np.maximum(high - low, 1).astype(np.float64)
    hashes = span_hashes(data, begin, end)
    repeat = np.zeros(len(begin), dtype=bool)
    repeat[1:] = hashes[1:] == hashes[:-1]
    if len(begin):
        repeat[low[low < len(begin)]] = False
    odd_end = (_KINDS[3] | _KINDS[4])[data[end - 1]] if len(begin) else repeat

    def of_words(mark: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])
        return total[high] - total[low]

    whole = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes)]) if len(begin) else np.zeros(1, dtype=np.uint64)
    content = whole[high] - whole[low]
    same = np.zeros(lines, dtype=bool)
    same[1:] = (content[1:] == content[:-1]) & (high[1:] > low[1:])
    same[firsts[:-1]] = False
    tail = np.zeros(lines, dtype=bool)
    full = length > 0
    tail[full] = _STOP[data[stops[full] - 1]]
    own = np.stack(
        [
            np.log1p(length) / 5,
            np.minimum(symbols / size * 5, 1),
            np.minimum(cries / size * 5, 1),
            np.minimum(bars / words, 1),
            capitals / np.maximum(letters, 1),
            of_words(odd_end) / words,
            of_words(repeat) / words,
            digits / size,
            np.minimum(letters / words / 10, 2),
            tail,
            length == 0,
            same,
            letters / size,
        ],
        axis=1,
    ).astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[firsts[:-1]] = 0
    after[firsts[1:] - 1] = 0
    return np.concatenate([np.ones((lines, 1)), own, before, after], axis=1), length, firsts


def _chains(firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step: documents that have such a line, longest first, and that line's number."""
    count = np.diff(firsts)
    order = np.argsort(-count, kind="stable")
    falling = -count[order]
    for step in range(int(count.max()) if len(count) else 0):
        docs = order[: np.searchsorted(falling, -step, side="left")]
        yield docs, firsts[docs] + step


def marginals(emit: np.ndarray, firsts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log of forward and backward sums of each line (lines x 2), and each document's log partition."""
    forward, backward = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
    steps = list(_chains(firsts))
    for i, (_, at) in enumerate(steps):
        forward[at] = emit[at] if i == 0 else emit[at] + np.logaddexp(forward[at - 1, :1] + move[0], forward[at - 1, 1:] + move[1])
    for docs, at in reversed(steps):
        on = at + 1 < firsts[docs + 1]
        nxt = at[on] + 1
        ahead = emit[nxt] + backward[nxt]
        backward[at[on]] = np.logaddexp(move[:, 0] + ahead[:, :1], move[:, 1] + ahead[:, 1:])
    last = firsts[1:] - 1
    return forward, backward, np.logaddexp(forward[last, 0], forward[last, 1])


def _emissions(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    good = x @ weights
    return np.stack([-good / 2, good / 2], axis=1)


def fit_chain(x: np.ndarray, firsts: np.ndarray, labels: np.ndarray, rounds: int = 150, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and moves between labels of greatest likelihood, by gradient ascent with moments."""
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    line_label = np.repeat(labels, np.diff(firsts))
    inner = np.ones(len(x), dtype=bool)
    inner[firsts[:-1]] = False
    later = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (line_label[later - 1], line_label[later]), 1)
    for turn in range(1, rounds + 1):
        move = theta[-4:].reshape(2, 2)
        emit = _emissions(x, theta[:-4])
        forward, backward, whole = marginals(emit, firsts, move)
        of_line = np.repeat(whole, np.diff(firsts))
        good = np.exp(forward[:, 1] + backward[:, 1] - of_line)
        gradient = np.zeros_like(theta)
        gradient[:-4] = x.T @ (line_label - good)
        pair = forward[later - 1][:, :, None] + move + (emit[later] + backward[later])[:, None, :] - of_line[later][:, None, None]
        gradient[-4:] = (seen - np.exp(pair).sum(axis=0)).ravel()
        gradient = gradient / len(labels) - decay * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += 0.1 * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def document_means(x: np.ndarray, length: np.ndarray, firsts: np.ndarray, weights: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Mean marginal of "good" over each document's lines, weighted by length (plus one)."""
    forward, backward, whole = marginals(_emissions(x, weights), firsts, move)
    good = np.exp(forward[:, 1] + backward[:, 1] - np.repeat(whole, np.diff(firsts)))
    weight = length + 1.0
    return np.add.reduceat(good * weight, firsts[:-1]) / np.add.reduceat(weight, firsts[:-1]) if len(firsts) > 1 else np.zeros(0)


def _scan(start: np.ndarray, steps: np.ndarray, block: int = 4096) -> np.ndarray:
    """Log sums over all paths from `start` (2) through 2 x 2 steps, after each of them; blocks by doubling."""
    out = np.empty((len(steps), 2))
    for low in range(0, len(steps), block):
        through, reach = steps[low : low + block].copy(), 1
        while reach < len(through):
            first, then = through[:-reach], through[reach:]
            through[reach:] = np.logaddexp(first[:, :, :1] + then[:, :1, :], first[:, :, 1:] + then[:, 1:, :])
            reach *= 2
        out[low : low + block] = np.logaddexp(start[0] + through[:, 0], start[1] + through[:, 1])
        start = out[min(low + block, len(steps)) - 1]
    return out


def long_mean(data: np.ndarray, weights: np.ndarray, move: np.ndarray) -> float:
    """`document_means` of one text of many lines. A block takes along the two lines before and the one behind it."""
    breaks = np.flatnonzero(data == 10)
    lines = len(breaks) + 1
    begins, ends = np.append(0, breaks + 1), np.append(breaks, len(data))
    emit, length = np.empty((lines, 2)), ends - begins
    for low in range(0, lines, BLOCK):
        high = min(low + BLOCK, lines)
        first, last = max(low - 2, 0), min(high + 1, lines)
        x, _, _ = line_features(data[begins[first] : ends[last - 1]], np.array([0, ends[last - 1] - begins[first]]))
        emit[low:high] = _emissions(x[low - first : high - first], weights)
    forward, backward = np.empty((lines, 2)), np.zeros((lines, 2))
    forward[0] = emit[0]
    if lines > 1:
        steps = move + emit[1:, None, :]
        forward[1:] = _scan(emit[0], steps)
        backward[:-1] = _scan(np.zeros(2), steps[::-1].transpose(0, 2, 1))[::-1]
    good = np.exp(forward[:, 1] + backward[:, 1] - np.logaddexp(forward[-1, 0], forward[-1, 1]))
    return float(np.average(good, weights=length + 1.0))


def fit_curve(means: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from mean to label, by Newton's method with a little decay."""
    design = np.stack([means - 0.5, np.ones_like(means)], axis=1)
    theta = np.array([4.0, 0.0])
    for _ in range(40):
        p = 1 / (1 + np.exp(-design @ theta))
        gradient = design.T @ (labels - p) - 0.05 * theta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        theta = theta + np.linalg.solve(hessian, gradient)
    return float(theta[0]), float(theta[1])


def _features(most_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for low, high in slices(offsets):
                x, length, firsts = line_features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                own = x.astype(np.float32)
                for row, a, b in zip(range(low, high), firsts[:-1], firsts[1:], strict=True):
                    if b - a <= most_lines:
                        yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, 1), batch.column(2).slice(row, 1), pa.array([own[a:b].tobytes()], pa.binary()), pa.array([length[a:b].tobytes()], pa.binary())], names=["label", "h", "x", "length"])

    return run


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", sample: int = SAMPLE, longest: int = LONGEST, most_lines: int = MOST_LINES, id_column: str = "doc_id", text_column: str = "text") -> dict:
    """The model: weights, moves and curve, or only the share of label 1. `use`: a condition on the label rows' doc_id that says which may be learned from."""
    marked = labels.where(use & F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.min(label).cast("int").alias("label"))
    # The row number has a bound, `sample`, so this side can be broadcast at any size of the corpus.
    picked = marked.withColumn("h", F.xxhash64("id", F.lit(11))).orderBy("h", "id").limit(sample)
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= longest)
    chosen = texts.join(F.broadcast(picked), "id").groupBy("id", "label", "h").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = chosen.select("text", "label", "h").mapInArrow(_features(most_lines), "label int, h long, x binary, length binary").collect()
    rows.sort(key=lambda r: (r.h, bytes(r.x)))
    y = np.array([r.label for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return {"share": (float(y.sum()) + 0.5) / (len(y) + 1)}
    parts = [np.frombuffer(r.x, dtype=np.float32).reshape(-1, FEATURES) for r in rows]
    x = np.concatenate(parts).astype(np.float64)
    firsts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    length = np.concatenate([np.frombuffer(r.length, dtype=np.int64) for r in rows])
    weights, move = fit_chain(x, firsts, y)
    return {"weights": weights, "move": move, "curve": fit_curve(document_means(x, length, firsts, weights, move), y)}


def scores_of(column: pa.Array, model: dict) -> np.ndarray:
    """The scores of a column of texts."""
    data, offsets = utf8(column)
    if "share" in model:
        return np.full(len(offsets) - 1, model["share"])
    slope, offset = model["curve"]
    means = np.empty(len(offsets) - 1)
    # Features of a line take the memory of some sixty bytes of text.
    breaks = np.searchsorted(np.flatnonzero(data == 10), offsets)
    for low, high in slices(offsets + 64 * breaks):
        own = data[offsets[low] : offsets[high]]
        if high - low == 1 and breaks[high] - breaks[low] >= BLOCK:
            means[low] = long_mean(own, model["weights"], model["move"])
        else:
            means[low:high] = document_means(*line_features(own, offsets[low : high + 1] - offsets[low]), model["weights"], model["move"])
    return 1 / (1 + np.exp(-(slope * (means - 0.5) + offset)))


def score(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns of the documents, and their `score`."""

    def run(texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores_of(batch.column("text"), model))], names=[*batch.schema.names[:-1], "score"])

    rest = [c for c in docs.columns if c != "score"]
    named = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)), F.col(text_column).cast("string").alias("text"))
    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(rest))
    return named.mapInArrow(run, f"{kinds}, score double").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(rest)), "score")


def held_out(id_column: Column) -> Column:
    """Rows that a model may not learn from."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
