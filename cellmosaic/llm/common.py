"""Helpers that the text operators share.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``.  Texts are
handled as Arrow buffers: a batch is cut into slices of bounded size, and a
slice is tokenised in numpy without one Python object per word.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: The word pattern in the syntax of Java, DuckDB and Python alike.
WORD = r"[^\x20\x09-\x0D]+"

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True

#: Gives free memory of the C library back; None where it has no such call.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)

#: Bytes of text that are handled at a time inside a Python worker.
SLICE_BYTES = 1 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints; set to a local one only where none is set, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(found)
    return found


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names`` with underscores added until none is among ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


class Shared:
    """Tables written to the shared folder in the course of one query.

    Written tables cut the lineage and survive lost executors.  ``drop`` removes
    one as soon as its successor has been written; what a result still reads is
    removed when the application ends.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.n = spark, 0
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def put(self, df: DataFrame, free: bool = False) -> DataFrame:
        """With ``free``, the shuffle files behind the table are given up at once; else they stay until the driver happens to collect its garbage."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        if free:
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        for f in frames:
            for name in f.inputFiles()[:1]:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class Words:
    """The words of the texts of a slice.

    ``first[d]:first[d + 1]`` are the words of text ``d``; ``start`` and ``end``
    are byte positions in ``data``; ``code`` numbers the distinct words, which
    ``distinct`` holds.  ``offset`` are the byte limits of the texts.
    """

    data: np.ndarray
    offset: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    code: np.ndarray
    distinct: pa.Array


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and the limits of each; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    limits = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if offsets is not None and len(texts) else np.zeros(1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return whole[limits[0] : limits[-1]], limits - limits[0]


def words_of(texts: pa.Array, encode: bool = True) -> Words:
    data, offset = text_bytes(texts)
    blank = _BLANK[data]
    before = np.ones(len(data), dtype=bool)
    before[1:] = blank[:-1]
    before[offset[:-1][offset[:-1] < len(data)]] = True
    after = np.ones(len(data), dtype=bool)
    after[:-1] = blank[1:]
    if len(data):
        after[offset[1:][offset[1:] > 0] - 1] = True
    start, end = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    first = np.searchsorted(start, offset)
    if not encode:
        return Words(data, offset, start, end, first, np.zeros(0, dtype=np.int32), pa.array([], pa.large_binary()))
    size = end - start
    limits = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=limits[1:])
    spans = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(limits), pa.py_buffer(np.ascontiguousarray(data[~blank]))])
    coded = spans.dictionary_encode()
    return Words(data, offset, start, end, first, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each part has about ``limit`` bytes of text, or one text that is longer.

    Workers are used again by later stages; between batches and at the end they
    give back to the system what they no longer need.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
        _give_back()
    _give_back()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the limits ``first``, zero for empty ranges."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of each code point."""
    return (data & 0xC0) != 0x80
