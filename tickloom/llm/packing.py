"""Hierarchical packing of tokenised documents into windows of several context sizes.

Documents are cut into full windows and a rest. A piece belongs to the smallest tier (256, 512, 1024, 2048)
that holds it. Tiers are packed from the longest: the gap beside a piece is filled with shorter pieces, often
of shorter tiers, and a window of a tier below the longest is closed only when it is exactly full. What is
left goes best-fit into windows of the longest tier, the only ones padded.

Which lengths share a window is planned on counts by length: at most 2,048 numbers, whatever the input.
Every pattern of the plan repeats until one of its lengths runs out. A piece finds its window from its
running number among pieces of its length, which is a sum over tasks plus a count inside its task, so no
piece data is sorted or gathered.
"""
from __future__ import annotations

import string
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import keyed_text, large_text, shared_folder, text_slices, tidy

WINDOW = 2048
TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Window tokens of one training step; steps get equal numbers of windows of each size.
STEP_TOKENS = 1 << 18


# ---------------------------------------------------------------- tokens
class Encoder:
    """Token ids of whole texts, each distinct run between blanks tokenised once while it stays in the cache.

    The tokenizer splits at white space before anything else, so the ids of a text are those of its runs. Tasks of one
    worker share the cache, as half of the runs of a task have come up in the one before.
    """
    #: Runs of each of the two generations kept; a run met again moves to the younger one.
    CACHE = 300_000
    #: Runs tokenised together.
    GROUP = 256
    SEPARATOR = "<|startoftext|>"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = self.tokenizer.token_to_id(self.SEPARATOR)
        suffix, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        #: Which ids end a word, where the vocabulary marks that.
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.marked = bool(self.last.any())
        self.known: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _least_words(run: str) -> int:
        """Fewest words of a run of letters with or without punctuation after them; 0: some other run."""
        body = run.rstrip(string.punctuation)
        return 1 + (len(body) < len(run)) if body.isalpha() else 0

    def _groups(self, runs: list[str], glue: str):
        groups = [runs[i:i + self.GROUP] for i in range(0, len(runs), self.GROUP)]
        return zip(groups, self._ids([glue.join(g) for g in groups]), strict=True)

    def _keep(self, runs: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        raw = ids.tobytes()
        for run, a, b in zip(runs, (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
            self.known[run] = raw[a:b]

    def _learn(self, runs: list[str]) -> None:
        words = {r: n for r in runs if (n := self._least_words(r))} if self.marked else {}
        rest = [r for r in runs if r not in words]
        for group, ids in self._groups(list(words), " "):
            bounds, ends = np.cumsum([words[r] for r in group]), np.flatnonzero(self.last[ids]) + 1
            if len(ends) == bounds[-1]:  # no run has fewer words than it was given, so none has more
                ends = ends[bounds - 1]
                self._keep(group, ids, np.concatenate([[0], ends[:-1]]), ends)
            else:
                rest += group
        odd = [r for r in rest if self.cut is None or self.SEPARATOR in r]
        self.known.update(zip(odd, (i.tobytes() for i in self._ids(odd)), strict=True))
        plain = [r for r in rest if self.cut is not None and self.SEPARATOR not in r]
        for group, ids in self._groups(plain, self.SEPARATOR):
            ends = np.flatnonzero(ids == self.cut)
            self._keep(group, ids, np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(ids)]]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        runs = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > self.CACHE:
            self.old, self.known = self.known, {"": b""}
        fresh = set().union(*runs) - self.known.keys()
        again = fresh & self.old.keys()
        self.known.update((r, self.old[r]) for r in again)
        self._learn(list(fresh - again))
        return [b"".join(map(self.known.__getitem__, r)) for r in runs]


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


PIECE = "doc_id long, start long, length int, doc_tokens long, task int, nth long, ids binary"


def _pieces(path: str, window: int):
    def run(batches):
        encoder, task, seen = _encoder(path), TaskContext.get().partitionId(), [0] * (window + 1)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            text = large_text(batch.column(1))
            for lo, hi, _, _ in text_slices(text, 2 << 20):
                docs = batch.column(0).slice(lo, hi - lo).to_pylist()
                out = [[] for _ in range(7)]
                for doc, ids in zip(docs, encoder.encode(text.slice(lo, hi - lo).to_pylist()), strict=True):
                    ids += end
                    many = len(ids) // 4
                    for start in range(0, many, window):
                        part = ids[4 * start:4 * (start + window)]
                        size = len(part) // 4
                        for column, value in zip(out, (doc, start, size, many, task, seen[size], part), strict=True):
                            column.append(value)
                        seen[size] += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)],
                                                 names=[c.split()[0] for c in PIECE.split(", ")])
    return run


# ---------------------------------------------------------------- plan
def _exact(size: int) -> bool:
    return size & (size - 1) == 0


def plan(counts: dict[int, int], window: int = WINDOW, tiers: Sequence[int] = TIERS):
    """[(window size, {length: pieces}, repeats)]: patterns that together use every counted piece once."""
    left = np.zeros(window + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    below = np.arange(window + 1)  # the largest length not over this one that may still have pieces
    patterns = []

    def largest(x: int, used: dict[int, int]) -> int:
        while x > 0:
            root = x
            while below[root] != root:
                root = below[root]
            while below[x] != root:
                below[x], x = root, below[x]
            if root == 0 or left[root] > used.get(int(root), 0):
                return int(root)
            if left[root] == 0:
                below[root] = root - 1
                x = root
            else:
                x = root - 1
        return 0

    def fill(first: int, size: int) -> tuple[dict[int, int], int]:
        used, gap = {first: 1}, size - first
        while gap and (x := largest(gap, used)):
            n = int(min(gap // x, left[x] - used.get(x, 0)))
            used[x] = used.get(x, 0) + n
            gap -= n * x
        return used, gap

    def emit(used: dict[int, int], size: int) -> None:
        n = int(min(left[x] // c for x, c in used.items()))
        patterns.append((size, used, n))
        for x, c in used.items():
            left[x] -= n * c

    for size in tiers:
        for first in range(size, size // 2 if size != min(tiers) else 0, -1):
            while left[first]:
                used, gap = fill(first, size)
                if gap:
                    break
                emit(used, size)
    for first in range(window, 0, -1):
        while left[first]:
            used, gap = fill(first, window)
            held = window - gap
            emit(used, held if _exact(held) else window)
    return sorted(patterns, key=lambda p: -p[0])


def _tables(patterns):
    """Arrays for the lookup: run starts by (length, running number), and what each run says."""
    seq, at = 0, {}
    rows = []
    tokens = sum(size * n for size, _, n in patterns)
    for size, used, n in patterns:
        offset = 0
        for length, c in used.items():
            begin = at.get(length, 0)
            rows.append(((length << 40) + begin, begin, c, seq, offset, size))
            at[length] = begin + n * c
            offset += length * c
        seq += n
    rows.sort()
    return np.array(rows, dtype=np.int64).reshape(-1, 6), max(1, -(-tokens // STEP_TOKENS))


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, tiers: Sequence[int] = TIERS,
         carry: Sequence[Column] | None = None) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, *carry, sequence_id, offset, window, step_group).

    ``tokenizer`` is the path of a tokenizer file that every executor has. ``carry`` are columns made of a
    piece's ``ids`` (binary, little-endian unsigned 32-bit); by default the ids themselves. Null and empty
    texts give one piece with the end id alone; repeated rows are packed each; other columns are ignored.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark)
    keyed_text(docs).mapInArrow(tidy(_pieces(tokenizer, window)), PIECE).write.option("compression", "zstd").parquet(folder)
    pieces = spark.read.schema(PIECE).parquet(folder)
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table, steps = _tables(plan(counts, window, tiers))
    kept = [F.col("ids")] if carry is None else list(carry)
    rows = pieces.select("doc_id", "start", "length", "doc_tokens", *kept, "task", "nth")
    rows = rows.join(base, ["task", "length"]).withColumn("nth", F.col("nth") + F.col("base")).drop("task", "base")

    def place(batches):
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy().astype(np.int64)
            nth = batch.column(batch.schema.get_field_index("nth")).to_numpy()
            run = table[np.searchsorted(table[:, 0], (length << 40) + nth, side="right") - 1]
            inside = nth - run[:, 1]
            seq = run[:, 3] + inside // run[:, 2]
            more = {"sequence_id": seq, "offset": run[:, 4] + inside % run[:, 2] * length, "window": run[:, 5],
                    "step_group": seq % steps}
            own = [n for n in batch.schema.names if n != "nth"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in own] + [pa.array(v) for v in more.values()],
                names=own + list(more))

    schema = rows.drop("nth").schema
    for name in ("sequence_id", "offset", "window", "step_group"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(place, schema)
