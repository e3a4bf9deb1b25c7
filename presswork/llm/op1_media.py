"""Operator 1: media columns of progressive JPEG.

`encode_media` stores the bytes of each text as the quantised coefficients of a progressive JPEG file with
4:2:0 chroma: DC and AC scans with spectral selection and successive approximation, and restart markers.
`decode_media` reads such columns: it gathers all scans into coefficient arrays, takes the payload from them,
inverse-transforms them in numpy, repeats chroma to full size and gives the RGB tensor of each image.
The work is in `jpeg.py`; there is no shuffle.

Nulls and odd input: a null or empty text is a payload of 64 zero bytes; a null media value gives nulls. A file
that isn't a progressive JPEG, is damaged, or has more than `most_pixels`, gives nulls and the reason in `error`; it
stops neither the rows beside it nor the job. Very long texts take some forty times their size in memory, one at a time.
Repeated rows are each stored on their own and alike. An empty table gives an empty table; other columns,
whatever their names, aren't read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm import jpeg
from presswork.llm.common import table
from presswork.llm.textarrays import ragged, slices, utf8


#: Of one image; its tensor has three times as many bytes.
MOST_PIXELS = 1 << 28


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for first, last in slices(offsets):
            lengths = np.diff(offsets[first : last + 1])
            padded = np.maximum(64, -(-lengths // 64) * 64)
            at = np.concatenate([[0], np.cumsum(padded)])
            payloads = np.zeros(at[-1], dtype=np.uint8)
            payloads[ragged(at[:-1], lengths)] = data[offsets[first] : offsets[last]]
            files = jpeg.write_payloads(payloads, at, lengths)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(files, pa.binary())], names=["id", "media"])


def encode_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A JPEG file (`media`) for each document's bytes."""
    picked = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    return picked.mapInArrow(_encode, f"id {kind}, media binary").withColumnRenamed("id", id_column)


Read = tuple[int | None, bytes | None, int | None, int | None, bytes | None, str | None]


def _read(files: list[bytes], most_pixels: int) -> list[Read]:
    """(n_bytes, payload, width, height, rgb, error) of each file. Files are read together; if that fails, by halves, until the bad one is alone."""
    try:
        images, coefficients = jpeg.read_coefficients(files, most_pixels)
        tensors = jpeg.to_rgb(images, coefficients)
    except (ValueError, IndexError, KeyError, OverflowError, struct.error) as error:
        if len(files) > 1:
            return [x for half in (files[: len(files) // 2], files[len(files) // 2 :]) for x in _read(half, most_pixels)]
        return [(None, None, None, None, None, f"{type(error).__name__}: {error}")]
    out = []
    for image, rgb in zip(images, tensors, strict=True):
        size, payload = jpeg.payload_of(image, coefficients) or (None, None)
        out.append((size, None if payload is None else payload.tobytes(), image.width, image.height, rgb.tobytes(), None))
    return out


def _decode(most_pixels: int):
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(1).cast(pa.large_binary())
            sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(media), 0).to_numpy())])
            for first, last in slices(sizes):
                files = batch.column(1).slice(first, last - first)
                there = [i for i, x in enumerate(files.is_valid().to_pylist()) if x]
                rows: list[Read] = [(None,) * 6] * (last - first)
                for i, row in zip(there, _read([files[i].as_py() for i in there], most_pixels), strict=True) if there else ():
                    rows[i] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first), files, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                    names=["id", "media", "n_bytes", "payload", "width", "height", "rgb", "error"],
                )

    return run


def decode_media(media: DataFrame, id_column: str = "doc_id", media_column: str = "media", most_pixels: int = MOST_PIXELS) -> DataFrame:
    """The media with its size, its RGB tensor (`rgb`: height x width x 3 bytes), what `encode_media` stored in it (null for other files), and why it can't be read (`error`)."""
    picked = media.select(F.col(id_column).alias("id"), F.col(media_column).alias("media"))
    kind = picked.schema["id"].dataType.simpleString()
    out = picked.mapInArrow(_decode(most_pixels), f"id {kind}, media binary, n_bytes long, payload binary, width int, height int, rgb binary, error string")
    return out.withColumnRenamed("id", id_column)


def write_media(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes the media column and the tensors of all documents to the folder `path`, and reads that table."""
    decode_media(encode_media(docs, id_column, text_column), id_column).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def op1_media(spark, sf_dir: str) -> DataFrame:
    out = decode_media(encode_media(table(spark, sf_dir, "documents")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(length(payload) - 63, 1), 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "width", "height", F.crc32("rgb")).alias("feature"),
    )
