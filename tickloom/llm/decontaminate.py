"""Benchmark passages in documents.

Windows as long as a benchmark item slide over each document; a document shorter than the item is one window.
Their SimHash fingerprints are looked up in a multi-index: eight 8-bit blocks, each searched within one bit, so
every item fingerprint within 15 of 64 bits is a candidate. Candidates are confirmed by exact weighted Jaccard
similarity of word shingles, a shingle weighing as many bytes as its words have. A window that shares too little
weight with all items of its length cannot reach that similarity, so no fingerprint is made for it.

Of windows at similarity 0.8 some 3 % have fingerprints farther away. So each window whose shingles share enough
weight with one item to reach the similarity is a candidate for that item at any distance: no window is lost.

The benchmark is taken in blocks of a bounded number of items; every block is held against all documents.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import U64, gram_hashes, keyed_text, mix, split_words, text_slices, tidy

SHINGLE = 3
SIMILARITY = 0.8
BLOCKS, BLOCK_RADIUS = 8, 1
#: Fingerprints up to this distance are found for certain: BLOCKS * (BLOCK_RADIUS + 1) - 1.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BLOCK_ITEMS = 2_000

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A"):ord("Z") + 1] += 32
_PLAIN[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32
_BIT = np.arange(64, dtype=U64)
_FILTER_BITS = 22


def _shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes and weights by first word, and each text's first word; punctuation and case do not count."""
    words = split_words(_PLAIN[data], bounds)
    grams = gram_hashes(words.hashes(), SHINGLE)
    size = np.concatenate([[0], np.cumsum(words.end - words.start)])
    return grams, (size[SHINGLE:] - size[:-SHINGLE]) if len(grams) else np.zeros(0, np.int64), words.first


def _short_texts(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(text, word hashes) of the texts that have words, but too few for a shingle: each is one shingle as a whole."""
    words = split_words(_PLAIN[data], bounds)
    hashes, count = words.hashes(), np.diff(words.first)
    for i in np.flatnonzero((count > 0) & (count < SHINGLE)):
        a, b = words.first[i], words.first[i + 1]
        yield int(i), tuple(hashes[a:b].tolist())


def _fingerprints(grams: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """SimHash of ``count`` shingles from each start (ascending)."""
    out = np.zeros(len(starts), U64)
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + 4096))
        lo, hi = starts[at], starts[end - 1] + count
        signs = ((grams[lo:hi, None] >> _BIT) & U64(1)).astype(np.int64) * 2 - 1
        total = np.zeros((hi - lo + 1, 64), np.int64)
        np.cumsum(signs * weights[lo:hi, None], axis=0, out=total[1:])
        part = starts[at:end] - lo
        bits = total[part + count] - total[part] > 0
        out[at:end] = (bits.astype(U64) << _BIT).sum(axis=1, dtype=U64)
        at = end
    return out


def _similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    a, ia = np.unique(a, return_index=True)
    b, ib = np.unique(b, return_index=True)
    both = np.isin(a, b, assume_unique=True)
    shared = wa[ia][both].sum()
    return float(shared / (wa[ia].sum() + wb[ib].sum() - shared))


class Index:
    """Items of one block: shingles, fingerprints, and near[block, value, item]."""

    def __init__(self, items: list[tuple[int, str]]):
        text = pa.array([t or "" for _, t in items], pa.large_string())
        self.ids, self.grams, self.weights = [], [], []
        self.short: dict[tuple[int, ...], list[int]] = {}
        row = 0
        for lo, hi, data, bounds in text_slices(text):
            grams, weights, first = _shingles(data, bounds)
            for i in range(hi - lo):
                a, b = first[i], first[i + 1] - SHINGLE + 1
                if b > a:
                    self.ids.append(items[row + i][0])
                    self.grams.append(grams[a:b])
                    self.weights.append(weights[a:b])
            for i, key in _short_texts(data, bounds):
                self.short.setdefault(key, []).append(items[row + i][0])
            row += hi - lo
        self.counts = np.array([len(g) for g in self.grams], int)
        self.prints = np.array([_fingerprints(g, w, np.zeros(1, int), len(g))[0]
                                for g, w in zip(self.grams, self.weights, strict=True)], U64)
        self.least = {}
        self.near = {}
        values = np.arange(256, dtype=U64)
        for count in np.unique(self.counts):
            own = np.flatnonzero(self.counts == count)
            unique = [np.unique(self.grams[i], return_index=True)[1] for i in own]
            self.least[int(count)] = SIMILARITY * min(int(self.weights[i][u].sum()) for i, u in zip(own, unique, strict=True))
            blocks = (self.prints[own, None] >> (U64(8) * np.arange(BLOCKS, dtype=U64))) & U64(255)
            self.near[int(count)] = own, np.bitwise_count(blocks.T[:, None, :] ^ values[None, :, None]) <= BLOCK_RADIUS
        every = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, U64)
        self.every = every
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(every & U64((1 << _FILTER_BITS) - 1)).astype(int)] = True
        size = np.array([len(np.unique(g)) for g in self.grams], int)
        #: holders[cuts[v]:cuts[v + 1]]: the items that hold the shingle every[v]; needs: the weight an item's window must share.
        value = np.searchsorted(every, np.concatenate([np.unique(g) for g in self.grams])) if self.grams else np.zeros(0, int)
        self.holders = np.repeat(np.arange(len(size)), size)[np.argsort(value, kind="stable")]
        self.cuts = np.searchsorted(np.sort(value), np.arange(len(every) + 1))
        self.needs = np.array([SIMILARITY * w[np.unique(g, return_index=True)[1]].sum() for g, w in zip(self.grams, self.weights, strict=True)])
        self.floor = min(self.least.values(), default=np.inf)

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, float]]:
        """(row, item_id, first word, words, distance, similarity): the best window of each item in each text."""
        if not len(self.every) and not self.short:
            return
        for row, hi, data, bounds in text_slices(column):
            for i, key in _short_texts(data, bounds) if self.short else ():
                yield from ((row + i, item, 0, len(key), 0, 1.0) for item in sorted(set(self.short.get(key, ()))))
            if not len(self.every):
                continue
            grams, weights, first = _shingles(data, bounds)
            hit = self.filter[(grams & U64((1 << _FILTER_BITS) - 1)).astype(int)]
            spot = np.flatnonzero(hit)
            hit[spot] = np.isin(grams[spot], self.every)
            mass = np.concatenate([[0], np.cumsum(weights * hit)])
            for i in range(hi - row):
                a, b = first[i], first[i + 1] - SHINGLE + 1
                if b > a and mass[b] - mass[a] >= self.floor:
                    for found in self._windows(grams[a:b], weights[a:b], mass[a:b + 1]):
                        yield row + i, *found

    def _able(self, grams, weights) -> np.ndarray:
        """Items of which the text holds enough distinct shingles, by weight, somewhere."""
        found, at = np.unique(grams, return_index=True)
        value = np.searchsorted(self.every, found).clip(0, len(self.every) - 1)
        held = self.every[value] == found
        value, weight = value[held], weights[at[held]]
        many = self.cuts[value + 1] - self.cuts[value]
        place = np.repeat(self.cuts[value] - np.cumsum(many) + many, many) + np.arange(many.sum())
        total = np.bincount(self.holders[place], np.repeat(weight, many), len(self.needs))
        return np.flatnonzero(total >= self.needs)

    def _windows(self, grams, weights, mass):
        best, able = {}, self._able(grams, weights)
        for whole, (own, near) in self.near.items():
            count = min(whole, len(grams))  # a text shorter than the item is one window
            starts = np.flatnonzero(mass[count:] - mass[:-count] >= self.least[whole])
            if not len(starts):
                continue
            prints = _fingerprints(grams, weights, starts, count)
            values = ((prints[:, None] >> (U64(8) * np.arange(BLOCKS, dtype=U64))) & U64(255)).astype(int)
            listed = near[np.arange(BLOCKS), values].any(axis=1)
            listed &= np.bitwise_count(prints[:, None] ^ self.prints[own]) <= RADIUS
            for k in np.flatnonzero(np.isin(own, able)):
                own_mass = np.concatenate([[0], np.cumsum(weights * np.isin(grams, self.grams[own[k]]))])
                listed[:, k] |= own_mass[starts + count] - own_mass[starts] >= self.needs[own[k]]
            for w, k in zip(*np.nonzero(listed), strict=True):
                item, start = own[k], int(starts[w])
                s = _similarity(grams[start:start + count], weights[start:start + count], self.grams[item], self.weights[item])
                key = (-s, start)
                if s >= SIMILARITY and key < best.get(item, ((1.0,),))[0]:
                    best[item] = key, int(np.bitwise_count(prints[w] ^ self.prints[item])), count
        for item, (key, distance, count) in sorted(best.items()):
            yield self.ids[item], key[1], count + SHINGLE - 1, distance, -key[0]


def index_blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of BLOCK_ITEMS items or so each; null and repeated items are fine, items without words are left out."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    blocks = -(-items.count() // BLOCK_ITEMS)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        yield Index([(r.item_id, r.text) for r in rows])


MATCH = "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double"


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row (doc_id, item_id, start_word, n_words, distance, similarity) for each item found in each document.

    Words are runs without white space and ASCII punctuation, any case. An item of one or two words is one shingle, as
    is a document of that length, so it is found in documents that say just this; in longer ones so few words are
    no sign of the item. Null texts hold nothing; a repeated doc_id gives rows for each of its rows; other columns are ignored.
    """
    text, out = keyed_text(docs), None
    for index in index_blocks(benchmark):
        def run(batches, index=index):
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[m[0]], *m[1:]) for m in index.matches(batch.column(1))]
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                                 names=[f.split()[0] for f in MATCH.split(", ")])

        part = text.mapInArrow(tidy(run), MATCH)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], MATCH) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, all columns kept."""
    at, schema = docs.columns.index("text"), docs.schema
    for index in index_blocks(benchmark):
        def run(batches, index=index):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[m[0] for m in index.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), schema)
    return docs
