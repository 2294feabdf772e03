"""Spelling variants: words one edit apart, found in a trie of letter counts.

A word's frequency vector holds how often each letter group occurs in it. The trie arranges words by these counts,
one level for each group. One inserted letter is a surplus of one in a single group, a replaced letter a surplus of one
and a deficit of one (or no change, within a group). The search walks the trie with a word's own counts and may
spend one surplus and one deficit on its way down; the words of the leaves it reaches are verified letter by letter.
Each pair is found once: from its shorter word, or from the word whose difference begins with the surplus.

The upper levels of the trie are keys that Spark partitions by: every word is a resident of its own node and a
visitor of the nodes its search would enter. Nodes with too many residents are split by further levels, and leaves
that no level splits are cut into blocks, so a task holds at most about ``NODE_LIMIT`` residents.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import stored, tidy

MIN_LENGTH = 6
MIN_COUNT = 5
#: A near word is the form of a word that it outnumbers so often.
RATIO = 5
#: Levels of the trie that one round of partitioning settles.
STEP = 4
#: Residents of a node that one task may hold, and visitors searched at once.
NODE_LIMIT = 1 << 15
VISITORS = 1 << 14
#: Pairs of a word and a leaf word looked at together.
PAIRS = 1 << 20

# The lower-case letters by how common they are; other letters are dealt over a few groups by code point.
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
OTHERS = 6
GROUPS = len(LETTERS) + OTHERS
_GROUP = np.array([LETTERS.find(chr(c)) if chr(c) in LETTERS else len(LETTERS) + c % OTHERS for c in range(256)], np.int64)

_ROUTE = "node binary, state int, word string, n long"
_PAIR = "a string, a_n long, b string, b_n long"


# ---------------------------------------------------------------- words
def counted_words(docs: DataFrame, variant_part: int = 199) -> DataFrame:
    """(word, n): words of at least ``MIN_LENGTH`` letters that occur at least ``MIN_COUNT`` times in all documents.

    Where ``variant_part`` divides the CRC-32 of ``doc_id:word``, the word loses the letter at that checksum modulo its length.
    Shorter runs cannot become words, so the pattern passes them over. A null doc_id is an empty one.
    """
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
                       F.explode(F.regexp_extract_all(low, F.lit("([a-zÀ-ÿ]{%d,})" % MIN_LENGTH), F.lit(1))).alias("run"))
    h = F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    word = F.when(h % variant_part == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))))
    words = runs.select(F.coalesce(word, F.col("run")).alias("word")).where(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


# ---------------------------------------------------------------- vectors
def vectors(words: list[str]) -> np.ndarray:
    """The counts of the letter groups, word x group."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    cell = np.repeat(np.arange(len(words)) * GROUPS, size) + _GROUP[code % 256]
    return np.bincount(cell, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def _entered(counts: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, state, counts of the node) for every node that a search in ``state`` may enter over the given levels.

    State 0 has spent nothing, 1 the surplus, 2 both.
    """
    n, k = counts.shape
    rows, states, nodes = [np.arange(n)], [state], [counts]

    def add(pick, new, *steps):
        moved = counts[pick]
        for level, by in steps:
            moved[:, level] += by
        ok = (moved >= 0).all(axis=1)
        rows.append(pick[ok])
        states.append(np.full(ok.sum(), new, state.dtype))
        nodes.append(moved[ok])

    for i in range(k):
        add(np.flatnonzero(state == 0), 1, (i, 1))
        add(np.flatnonzero(state == 1), 2, (i, -1))
        for j in range(i + 1, k):
            add(np.flatnonzero(state == 0), 2, (i, 1), (j, -1))
    return np.concatenate(rows), np.concatenate(states), np.concatenate(nodes)


def _keys(nodes: np.ndarray, before: pa.Array | None = None) -> pa.Array:
    width = 4 * nodes.shape[1]
    own = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(nodes), [None, pa.py_buffer(np.ascontiguousarray(nodes, ">i4"))])
    own = own.cast(pa.binary())
    return own if before is None else pa.array([a + b for a, b in zip(before.to_pylist(), own.to_pylist(), strict=True)], pa.binary())


#: The state of a resident.
HOME = -1


def _descend(depth: int):
    """Rows (node, state, word, n) moved from the levels above ``depth`` to the next ``STEP``; depth 0 takes (word, n)."""
    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            if not words:
                continue
            level = vectors(words)[:, depth:depth + STEP]
            state = batch.column("state").to_numpy() if depth else np.full(len(words), HOME, np.int32)
            above = batch.column("node") if depth else None
            home = np.flatnonzero(state == HOME)
            away = np.flatnonzero(state != HOME) if depth else home
            row, to, nodes = _entered(level[away], state[away] if depth else np.zeros(len(away), np.int32))
            row = np.concatenate([home, away[row]])
            nodes = np.concatenate([level[home], nodes])
            to = np.concatenate([np.full(len(home), HOME, np.int32), to.astype(np.int32)])
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [_keys(nodes, None if above is None else above.take(at)), pa.array(to), batch.column("word").take(at), batch.column("n").take(at)],
                names=["node", "state", "word", "n"])
    return tidy(run)


# ---------------------------------------------------------------- search
class _Trie:
    """Residents by node and by the counts below ``depth``; all levels are arrays."""

    def __init__(self, nodes: list, words: list, counts: list, depth: int):
        self.roots = {node: i for i, node in enumerate(dict.fromkeys(nodes))}
        root = np.array([self.roots[x] for x in nodes], np.int64)
        vector = vectors(words)[:, depth:]
        order = np.lexsort([*vector.T[::-1], root])
        self.words, self.n = [words[i] for i in order], np.array(counts, np.int64)[order]
        vector, at = vector[order], root[order]
        self.width = int(vector.max(initial=0)) + 2
        self.levels = []
        for level in range(vector.shape[1]):
            key = at * self.width + vector[:, level]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            self.levels.append(key[new])
            at = np.cumsum(new) - 1
        self.start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
        self.halves = _halves(self.words, 0), _halves(self.words, 1)

    def leaves(self, root: np.ndarray, state: np.ndarray, vector: np.ndarray):
        """(visitor, state, leaf) of every leaf that the searches reach."""
        who, node = np.arange(len(root)), root
        for level, keys in enumerate(self.levels):
            count = vector[who, level]
            steps = [(who, state, node * self.width + count)]
            for spent, by in ((0, 1), (1, -1)):
                at = np.flatnonzero((state == spent) & (count + by < self.width) & (count + by >= 0))
                steps.append((who[at], state[at] + 1, node[at] * self.width + count[at] + by))
            steps[0] = tuple(x[count < self.width] for x in steps[0])
            who, state, key = map(np.concatenate, zip(*steps, strict=True))
            node = np.searchsorted(keys, key)
            hit = np.flatnonzero(keys[np.minimum(node, len(keys) - 1)] == key)
            who, state, node = who[hit], state[hit], node[hit]
        return who, state, node


def _halves(words: list[str], longer: int) -> np.ndarray:
    """Hashes of the first and the last half of each word; ``longer``: halves as long as those of a word one letter shorter."""
    out = np.empty((2, len(words)), np.int64)
    for i, w in enumerate(words):
        m = len(w) - longer
        out[0, i], out[1, i] = hash(w[:m // 2]), hash(w[len(w) - m + m // 2:])
    return out


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one letter replaced or inserted."""
    longer = len(b) - len(a)
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return longer in (0, 1) and a[i + 1 - longer:] == b[i + 1:]
    return longer == 1


def _search(trie: _Trie, nodes: list, states: list, words: list, counts: list, depth: int):
    """Verified pairs (visitor, its n, resident, its n)."""
    known = [i for i, x in enumerate(nodes) if x in trie.roots]
    if not known:
        return
    words, counts = [words[i] for i in known], [counts[i] for i in known]
    root = np.array([trie.roots[nodes[i]] for i in known], np.int64)
    who, state, leaf = trie.leaves(root, np.array([states[i] for i in known], np.int64), vectors(words)[:, depth:])
    own = _halves(words, 0)
    size = trie.start[leaf + 1] - trie.start[leaf]
    ends = np.cumsum(size)
    at = 0
    while at < len(size):  # many leaves at once, or one large leaf
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        part = np.arange(at, end)
        pick = np.repeat(part, size[part])
        resident = np.arange(len(pick)) - np.repeat(np.cumsum(size[part]) - size[part], size[part]) + trie.start[leaf[pick]]
        visitor, longer = who[pick], state[pick] == 1
        # an edit leaves one half of the word as it is
        same = np.zeros(len(pick), bool)
        for half in (0, 1):
            same |= own[half][visitor] == np.where(longer, trie.halves[1][half][resident], trie.halves[0][half][resident])
        out = []
        for i in np.flatnonzero(same):
            a, b = words[visitor[i]], trie.words[resident[i]]
            # two words of one leaf find each other: one of the two is enough
            if (state[pick[i]] != 0 or a < b) and one_edit(a, b):
                out.append((a, counts[visitor[i]], b, int(trie.n[resident[i]])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64()) * 2, strict=True)],
                                             names=["a", "a_n", "b", "b_n"])
        at = end


def _match(depth: int):
    """Pairs of the rows of whole nodes, each node's residents before its visitors; visitors are streamed."""
    def run(batches):
        homes: list = []
        guests: list = []
        trie = None
        for batch in batches:
            for node, state, word, n in zip(*(batch.column(c).to_pylist() for c in ("node", "state", "word", "n")), strict=True):
                if state == HOME:
                    if trie is not None or len(homes) >= NODE_LIMIT and homes[-1][0] != node or len(guests) >= VISITORS:
                        trie = trie or _Trie(*zip(*homes, strict=True), depth)
                        yield from _search_all(trie, guests, depth)
                        trie, homes, guests = None, [], []
                    homes.append((node, word, n))
                elif homes and homes[-1][0] == node:  # a node without residents has nothing to find
                    guests.append((node, state, word, n))
                    if len(guests) >= VISITORS and len(homes) >= NODE_LIMIT // 4:
                        trie = trie or _Trie(*zip(*homes, strict=True), depth)
                        yield from _search_all(trie, guests, depth)
                        guests = []
        if guests:
            yield from _search_all(trie or _Trie(*zip(*homes, strict=True), depth), guests, depth)
    return tidy(run)


def _search_all(trie: _Trie, guests: list, depth: int):
    for i in range(0, len(guests), VISITORS):
        yield from _search(trie, *map(list, zip(*guests[i:i + VISITORS], strict=True)), depth)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): every pair of the distinct words (word, n) that differ by one letter, once, in either order."""
    rows, depth, found = words.select("word", "n"), 0, None
    while True:
        routes = rows.mapInArrow(_descend(depth), _ROUTE)
        depth += STEP
        if found is not None:
            routes = stored(routes)
        homes = routes.where(F.col("state") == HOME).groupBy("node").agg(F.count(F.lit(1)).alias("residents"))
        large = stored(homes.where(F.col("residents") > NODE_LIMIT))
        many = large.count()
        if many:
            # at most one row for NODE_LIMIT words, so small beside the words; broadcast only where it is small outright
            large = F.broadcast(large) if many <= 1 << 16 else large
            settled, rows = routes.join(large, "node", "left_anti"), routes.join(large, "node")
        else:
            settled, rows = routes, None
        pairs = settled.repartition("node").sortWithinPartitions("node", "state").mapInArrow(_match(depth), _PAIR)
        found = pairs if found is None else found.union(pairs)
        if rows is None:
            return found
        if depth >= GROUPS:
            return found.union(_blocks(rows))
        rows = rows.drop("residents")


def _blocks(routes: DataFrame) -> DataFrame:
    """Pairs within leaves of any size: residents are dealt to blocks, visitors go to each of them."""
    blocks = F.ceil(F.col("residents") / NODE_LIMIT).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    at = F.when(F.col("state") == HOME, F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))
    rows = routes.withColumn("block", F.explode(at)).withColumn("node", F.concat("node", F.col("block").cast("string").cast("binary")))
    return rows.select("node", "state", "word", "n").repartition("node").sortWithinPartitions("node", "state").mapInArrow(_match(GROUPS), _PAIR)


# ---------------------------------------------------------------- forms
def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n).

    n_near: words one edit away. form: of these the one of largest n (ties: the first in code-point order), if it occurs
    at least ``RATIO`` times as often; else null. root: the word that forms lead to, or the word itself. A form occurs
    more often than its word, so the way to the root is short and has no cycle.
    """
    words = stored(words)
    pairs = near_pairs(words)
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form")).alias("near")).union(
        pairs.select(F.col("b"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("form"))))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    form = F.when(-F.col("near.less") >= RATIO * F.col("n"), F.col("near"))
    out = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("near")).select(
        "word", "n", "n_near", F.col("near.form").alias("form"), (-F.col("near.less")).alias("form_n")))
    ways = stored(out.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the steps that are followed
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                 F.col("next").isNotNull().alias("moved")))
        ways = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return out.join(ways, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of all whole texts of (doc_id, text).

    Null and empty texts hold no word; rows that repeat a doc_id count each; without words there is no row. Other columns are ignored.
    """
    return variants(counted_words(docs)).select("word", "form", "root", "n", "n_near", "form_n")
