"""What the operators share: tables in the cluster's shared folder, words of Arrow text, components."""
from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text handled at once; bounds the memory of the vectorised steps.
SLICE_BYTES = 1 << 20
_LOCAL: list[str] = []


# ---------------------------------------------------------------- shared folder
def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="llm-"))
        root = "file://" + _LOCAL[0]
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back: it ends the lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text (null: empty); other columns are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _zip(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [pack.compress(t.as_buffer()) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.binary())], names=[*batch.schema.names[:-1], "zipped"])


def zipped_text(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, more, zipped) of (doc_id, more, text), further columns being long: texts that are to be shuffled travel compressed."""
    schema = ", ".join(f"{c} long" for c in ("doc_id", *more))
    return docs.select("doc_id", *more, F.col("text").cast("binary")).mapInArrow(tidy(_zip), f"{schema}, zipped binary")


def zipped_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """What ``text_slices`` gives, from a ``zipped`` column: one slice is unpacked at a time."""
    import zstandard

    unpack, first, held, texts = zstandard.ZstdDecompressor(), 0, 0, []

    def whole(end):
        bounds = np.cumsum([0, *map(len, texts)])
        return first, end, np.frombuffer(b"".join(texts), np.uint8), bounds

    for row, zipped in enumerate(column):
        text = unpack.decompress(zipped.as_buffer())
        if texts and held + len(text) > size:
            yield whole(row)
            first, held, texts = row, 0, []
        texts.append(text)
        held += len(text)
    if texts:
        yield whole(len(column))


def tidy(run: Callable) -> Callable:
    """The task function ``run``, after whose last batch the worker gives its unused memory back to the system.

    Workers stay alive between stages; without this an executor carries the largest need of all its earlier tasks.
    """
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim is not None:
                trim(0)
    return whole


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def _random_words(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE = _random_words(256, 1)
_BYTE[_SPACE] = 0
_BASE = U64(0x9FB21C651E98DF25)
_GRAM = U64(0xA24BAED4963EE407)


# ---------------------------------------------------------------- words
def large_text(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, row bounds in them) for runs of whole texts of about ``size`` bytes."""
    text = large_text(column)
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64, count=n + 1, offset=text.offset * 8)
    body = text.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of several texts: byte starts and ends, and each text's first word."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    lead: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        if not len(self.start):
            return np.zeros(0, U64)
        of = np.maximum(np.cumsum(self.lead) - 1, 0)
        longest = int((self.end - self.start).max())
        power = np.cumprod(np.concatenate([[U64(1)], np.full(longest - 1, _BASE, U64)]), dtype=U64)
        place = np.clip(np.arange(len(self.data)) - self.start[of], 0, longest - 1)
        return mix(np.add.reduceat(_BYTE[self.data] * power[place], self.start))


def split_words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    word = ~_SPACE[data]
    opens = np.zeros(len(data) + 1, dtype=bool)
    opens[bounds] = True
    lead = word.copy()
    lead[1:] &= ~word[:-1] | opens[1:-1]
    tail = word.copy()
    tail[:-1] &= ~word[1:] | opens[1:-1]
    start, end = np.flatnonzero(lead), np.flatnonzero(tail) + 1
    return Words(data, start, end, np.searchsorted(start, bounds), lead)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k consecutive words, run i starting at word i; runs may cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    h = words[:n].copy()
    for j in range(1, k):
        h = h * _GRAM + words[j:j + n]
    return mix(h)


def sequence_hash(words: np.ndarray) -> np.ndarray:
    """One hash for a whole short sequence, apart from those of fixed runs."""
    h = U64(len(words) + 0x5EED)
    with np.errstate(over="ignore"):
        for w in words:
            h = h * _GRAM + w
    return mix(np.array([h], U64))


# ---------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b). Ids without a link are not returned.

    Every round takes the smallest label among neighbours, then the label's own label, so long chains
    halve. Only aggregates and joins: a vertex with very many links has no group of its own.
    """
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                    .select("id", F.least("id", "m").alias("component")))
    while True:
        near = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        step = labels.join(near, "id").select("id", F.col("component").alias("old"),
                                              F.least("component", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("next"))
        moved = stored(step.join(jump, "new", "left").select("id", "old", F.least("new", "next").alias("component")))
        labels = moved.select("id", "component")
        if moved.where("component < old").isEmpty():
            return labels
