"""Repeated passages between documents: seeds, and whole runs around them.

Seeds are winnowed anchors: in every run of ``length`` words the word gram with the smallest hash. Two equal
runs choose the same anchor at the same place, so no repeat of the wanted length is missed. Documents meet on
anchors that two or more of them hold. No match is extended word by word: each run that chose such a seed is hashed whole; a run
matches if its words start in an earlier document too, and overlapping matches join to maximal repeats.

Rows with equal texts are settled first: all but those with the smallest id lose every word that lies in
a run. Only these are searched. The runs at the seeds are grouped by content and carry the smallest
document id of their group. So thousands of copies of a passage cost as many rows as they have words, and both
groupings are aggregates and joins whose hot keys Spark can combine early or split.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import U64, gram_hashes, keyed_text, split_words, stored, tidy, zipped_slices, zipped_text

ANCHOR_WORDS = 5


def _slices(column: pa.Array, length: int):
    """(first row, end row, words, hashes, run starts, their anchor hashes, bounds of rows in these) of slices of zipped texts."""
    span = length - ANCHOR_WORDS + 1
    for lo, hi, data, bounds in zipped_slices(column):
        words = split_words(data, bounds)
        hashes = words.hashes()
        grams = gram_hashes(hashes, ANCHOR_WORDS)
        first, end = words.first[:-1], np.maximum(words.first[1:] - length + 1, words.first[:-1])
        count = end - first
        runs = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        if len(runs):
            view = np.lib.stride_tricks.sliding_window_view(grams, span)
            least = view.min(axis=1)[runs]
        else:
            least = np.zeros(0, U64)
        yield lo, hi, words, hashes, runs, least, np.concatenate([[0], np.cumsum(count)])


def _anchors(length: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, _, _, runs, least, at in _slices(batch.column(2), length):
                own = [np.unique(least[at[i]:at[i + 1]]) for i in range(hi - lo)]
                doc = np.repeat(np.arange(lo, hi), [len(o) for o in own])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64)), pa.array(ids[doc]), pa.array(texts[doc])],
                                                 names=["anchor", "doc_id", "digest"])
    return run


def _runs(length: int):
    """Content hash and start of each run whose anchor is among the document's shared ones."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_numpy(zero_copy_only=False)
            shared = batch.column(3)
            values, cuts = shared.values.to_numpy().view(U64), shared.offsets.to_numpy()
            for lo, hi, words, hashes, runs, least, at in _slices(batch.column(2), length):
                full = gram_hashes(hashes, length)
                keep = np.concatenate([np.isin(least[at[i]:at[i + 1]], values[cuts[lo + i]:cuts[lo + i + 1]])
                                       for i in range(hi - lo)])
                doc = np.repeat(np.arange(hi - lo), np.diff(at))[keep]
                kept = runs[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full[kept].view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array(texts[lo:hi][doc]),
                     pa.array((kept - words.first[doc]).astype(np.int32))], names=["run", "doc_id", "digest", "start"])
    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _remove(length: int):
    def run(batches):
        for batch in batches:
            starts, copy = batch.column(2), batch.column(3)
            for lo, hi, data, bounds in zipped_slices(batch.column(1)):
                words = split_words(data, bounds)
                count = np.diff(words.first)
                # one place after the words of each row, so that no stretch runs on into the next row
                base = words.first[:-1] + np.arange(hi - lo)
                depth = np.zeros(len(words.start) + hi - lo + 1, np.int32)
                for i in range(hi - lo):
                    own = starts[lo + i].values
                    own = own.to_numpy() if own is not None else np.zeros(0, np.int32)
                    if copy[lo + i].as_py():
                        own = np.arange(count[i] - length + 1)
                    np.add.at(depth, base[i] + own, 1)
                    np.add.at(depth, base[i] + own + length, -1)
                covered = np.cumsum(depth[:-1]) > 0
                edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
                opens, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
                cuts = np.searchsorted(opens, np.append(base, len(covered)))
                row = np.repeat(np.arange(hi - lo), np.diff(cuts))
                stay = np.flatnonzero(~np.delete(covered, base + count))
                rows = np.searchsorted(stay, words.first)
                text, at = _joined_words(data, words.start[stay], words.end[stay], rows)
                spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(x - base[row], pa.int32()) for x in (opens, ends)], fields=list(SPANS.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(count - np.diff(rows), pa.int64()),
                     pa.StringArray.from_buffers(hi - lo, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text)), spans],
                    names=["doc_id", "n_words", "n_removed", "kept", "spans"])
    return run


def _joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words of each row joined by one space, and the bounds of the rows in them; ``rows`` bounds words."""
    spaced = np.ones(len(end), bool)
    spaced[rows[1:][np.diff(rows) > 0] - 1] = False
    text, depth = data.copy(), np.zeros(len(data) + 1, np.int8)
    text[end[spaced]] = 0x20  # where another word follows, the byte after a word is white space
    depth[start] += 1
    depth[end + spaced] -= 1
    return text[np.cumsum(depth[:-1], dtype=np.int8) > 0], np.concatenate([[0], np.cumsum(end - start + spaced)])[rows]


def remove_repeats(docs: DataFrame, length: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) for every document.

    A word goes if a run of ``length`` words that covers it also starts in a document with a smaller doc_id,
    judged on the input, row by row. ``kept`` joins the other words by one space; ``spans`` are the removed stretches
    (first word, end word), maximal. Null texts are empty, null doc_ids neither give nor lose words; rows that
    repeat a doc_id are one document for this, which takes no words from itself. Other columns are ignored.
    """
    if length <= ANCHOR_WORDS:
        raise ValueError(f"length must be over {ANCHOR_WORDS}")
    key = ["doc_id", "digest"]  # a row, or equal ones: an id may be repeated with other texts
    text = keyed_text(docs).select("doc_id", F.xxhash64("text").alias("digest"), "text")
    packed = zipped_text(text, "digest")
    # one exchange by the key serves the three joins below; an inner one would ask for a digest that is not null by itself
    known = packed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    digest = text.where("doc_id IS NOT NULL").select(*key, F.xxhash64(F.lit(1), "text").alias("more"))
    least = digest.groupBy("digest", "more").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = stored(digest.join(least, ["digest", "more"]).where("doc_id > least").select(*key).distinct())
    anchors = known.join(copies, key, "left_anti").select(*key, "zipped").mapInArrow(
        tidy(_anchors(length)), "anchor long, doc_id long, digest long")
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    seeds = anchors.join(shared, "anchor").groupBy(*key).agg(F.collect_set("anchor").alias("anchors"))
    runs = known.join(seeds, key).select(*key, "zipped", "anchors").mapInArrow(
        tidy(_runs(length)), "run long, doc_id long, digest long, start int")
    first = runs.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("run", "first")
    gone = runs.join(first, "run").where("first < doc_id").groupBy(*key).agg(F.collect_set("start").alias("starts"))
    gone = gone.withColumn("copy", F.lit(False)).unionByName(copies.select(
        *key, F.array().cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    gone = gone.groupBy(*key).agg(F.flatten(F.collect_list("starts")).alias("starts"), F.max("copy").alias("copy"))
    marked = known.join(gone, key, "left").select("doc_id", "zipped", "starts", "copy").union(
        packed.where("doc_id IS NULL").select("doc_id", "zipped", F.lit(None).cast("array<int>"), F.lit(False)))
    return marked.mapInArrow(
        tidy(_remove(length)), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")
