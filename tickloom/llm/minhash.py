"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Minwise values of the set form a tree of nodes: each
node picks some positions, and a document goes to one child for each picked position, named by its value
there. Documents of similarity s share a child with probability s for each pick; several root branches
make the chance to miss a pair of the required similarity small. Nodes with few documents are compared
exhaustively; larger ones branch on, to four levels.

Documents with equal sets are one member. Large groups of near copies stay linear: every node first links its
members to its smallest one, and once these links are confirmed, nodes whose members all belong to one
component are done. Elsewhere the members outside the node's main component are compared with all others; a
node is small if it has few of them. Candidates are filtered by one-bit sketches and confirmed on full sets.

At the deepest level a member of a large node is only compared if enough of its shingles lie in sets of other components and
homes: a link at 0.8 needs 0.8 of them in one such set, so this loses none. It takes one row for each shingle of these
members, not for each pair, and leaves out the copies that have more words of their own than a link allows. No pair is measured twice.

The chance to miss a pair at 0.8, by calculation: trees 7.6e-7 at two levels (1.3e-6 when it is counted that all
branches read the same 128 values), sketches 2.5e-8 on top (5.7e-5 at 27 bits). One tree of four levels alone,
for pairs that share large nodes only, misses 8.1e-4 (1.2e-3); so members of large nodes go through two more trees,
and the three together miss 5.4e-10 of these pairs (1.5e-8).

Groups of copies edited too much for a link would still give many close pairs. Documents close to a common first member, or
joined by a chain of such ones (a home), therefore meet once more, as differences from the home's smallest member: the size of the
difference of two differences is that of the sets. Blocks of members outside the group's main component are held against blocks
of all its members, exactly, and only links leave a task.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import (U64, components, gram_hashes, keyed_text, mix, sequence_hash, split_words, stored,
                                 text_slices, tidy, zipped_slices, zipped_text)

POSITIONS = 128
#: Root branches; the chance to lose a pair at the threshold is about (1 - 0.8 * 0.63) ** 20 at two levels.
BRANCHES = 20
#: Expected picks at a node: 1 / similarity keeps one shared path for a pair at the threshold.
PICKS = 1.25
NODE_LIMIT = 128
#: Levels after which nodes are compared whatever their size.
MAX_LEVELS = 4
#: Trees with root positions of their own; those after the first take the members of its large nodes.
TREES = 3
#: Blocks of a group compared in one task, and shingles held at once there.
APART_ROWS, GROUP_ROWS, COLUMNS = 1024, 2048, 2048
#: Documents whose ids are broadcast to the scan of the texts: 8 MB.
FEW_IDS = 1 << 20
#: Of 128 sketch bits a pair of similarity 0.8 differs in 12.8 on average, deviation 3.4; beyond 34 in 2.5e-8 of the cases.
SKETCH_BITS = 34

_RANDOM = np.random.default_rng(20240607)
_FLIP = _RANDOM.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)
_TURN = _RANDOM.integers(0, 1 << 31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingle_sets(slices: Iterator[tuple], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than k words: the whole sequence as one; none: empty."""
    for _, _, data, bounds in slices:
        words = split_words(data, bounds, lower=True)
        hashes = words.hashes()
        grams = gram_hashes(hashes, k)
        for lo, hi in zip(words.first[:-1], words.first[1:], strict=True):
            if hi - lo >= k:
                yield np.unique(grams[lo:hi - k + 1])
            else:
                yield sequence_hash(hashes[lo:hi]) if hi > lo else np.zeros(0, U64)


def signature(members: np.ndarray) -> np.ndarray:
    """128 minwise values of a set."""
    low = (members >> U64(32)).astype(np.uint32)
    best = np.full(POSITIONS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(low), 4096):
        best = np.minimum(best, ((low[at:at + 4096, None] ^ _FLIP) * _TURN).min(axis=0))
    return best


def _features(k: int):
    def run(batches):
        for batch in batches:
            sizes, one, two, sigs, bits = [], [], [], [], []
            for members in shingle_sets(text_slices(batch.column(1)), k):
                sizes.append(len(members))
                one.append(int(mix(members ^ U64(0x1234567)).sum(dtype=U64)))
                two.append(int(mix(members + U64(0x7654321)).sum(dtype=U64)))
                sig = signature(members)
                sigs.append(sig.astype("<u4").tobytes())
                bits.append(np.packbits((sig * np.uint32(0x9E3779B1)) >> np.uint32(31)))
            sketch = np.array(bits, np.uint8).reshape(-1, 16).view("<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(one, U64).view(np.int64)),
                 pa.array(np.array(two, U64).view(np.int64)), pa.array(np.ascontiguousarray(sketch[:, 0])),
                 pa.array(np.ascontiguousarray(sketch[:, 1])), pa.array(sigs, pa.binary())],
                names=["doc_id", "n_shingles", "d0", "d1", "s0", "s1", "sig"])
    return run


def branch(paths: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of (node, member) rows: the row and the child's name, for each position the node picks."""
    rows, names = [], []
    limit = U64(int(PICKS / POSITIONS * 2.0 ** 64))
    spot = mix(np.arange(POSITIONS, dtype=U64) + U64(77))
    for at in range(0, len(paths), 2048):
        part = paths[at:at + 2048]
        row, place = np.nonzero(mix(part[:, None] ^ spot) < limit)
        rows.append(row + at)
        names.append(mix((part[row] ^ spot[place]) * U64(0xC2B2AE3D27D4EB4F) + sigs[row + at, place]))
    return (np.concatenate(rows), np.concatenate(names)) if rows else (np.zeros(0, int), np.zeros(0, U64))


_SPOT = "path long, up long, rep long"


def _paths(tree: int, levels: int):
    """Rows of ``_SPOT`` for members (rep, sig): their nodes ``levels`` below the roots of a tree.

    ``up`` is the node two levels above, or the root where there is none.
    """
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = batch.column(batch.schema.get_field_index("rep")).to_numpy(zero_copy_only=False)
            raw = batch.column(batch.schema.get_field_index("sig")).to_pylist()
            for lo in range(0, len(raw), 2000):
                sigs = np.frombuffer(b"".join(raw[lo:lo + 2000]), "<u4").reshape(-1, POSITIONS)
                n = len(sigs)
                row = np.tile(np.arange(n), BRANCHES)
                place = np.repeat(np.arange(BRANCHES) * (POSITIONS // BRANCHES) + 2 * tree, n)
                path = mix(mix(place.astype(U64) + U64(99)) + sigs[row, place])
                up = path
                for level in range(2, levels + 1):
                    above, path = branch(path, sigs[row])
                    row = row[above]
                    up = path if level <= levels - 2 else up[above]
                out = {"path": path.view(np.int64), "up": up.view(np.int64), "rep": rep[lo:lo + n][row]}
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out.values()], names=list(out))
    return tidy(run)


def _sets(k: int, slices):
    def run(batches):
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(slices(batch.column(1)), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["doc_id", "members"])
    return run


def _close(a0, a1, b0, b1) -> Column:
    return F.bit_count(F.col(a0).bitwiseXOR(F.col(b0))) + F.bit_count(F.col(a1).bitwiseXOR(F.col(b1))) <= SKETCH_BITS


def _few(ids: DataFrame) -> DataFrame:
    """Ids to be joined with wider rows: at most ``FEW_IDS`` are broadcast, so the wider rows stay where they are."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def full_sets(docs: DataFrame, pairs: DataFrame, k: int, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, members): the full sets of the documents of pairs (a, b), beside those already ``known``.

    Texts of at most ``FEW_IDS`` documents are picked in the scan and go nowhere; those of more are shuffled compressed.
    """
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    if known is not None:
        ids = ids.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
    ids = stored(ids)
    text = keyed_text(docs)
    if ids.count() <= FEW_IDS:
        rows = text.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(tidy(_sets(k, text_slices)), "doc_id long, members array<long>")
    else:
        rows = zipped_text(text).join(ids, "doc_id").mapInArrow(tidy(_sets(k, zipped_slices)), "doc_id long, members array<long>")
    made = stored(rows)
    return made if known is None else known.union(made)


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared): sizes and common shingles of the full sets of pairs (a, b). Other sets are not shuffled."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = sets.join(_few(ids), "doc_id", "left_semi")
    both = (pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb")), "b"))
    return stored(both.select("a", "b", F.size("ma").alias("na"), F.size("mb").alias("nb"),
                              F.size(F.array_intersect("ma", "mb")).alias("shared")))


def _similar(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * |A and B| >= percent * |A or B|."""
    return pairs.where(100 * F.col("shared") >= percent * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b").distinct()


def _block_links(percent: int):
    """Links between a block of apart members and a block of members, at most one for each component met."""
    def run(apart: pa.Table, rows: pa.Table) -> pa.Table:
        a, b = [], []
        if apart.num_rows and rows.num_rows:
            flat = [t.column("diff").combine_chunks() for t in (apart, rows)]
            sizes = [np.diff(f.offsets.to_numpy()) for f in flat]
            values = [f.flatten().to_numpy() for f in flat]
            of = [np.repeat(np.arange(len(n)), n) for n in sizes]
            both = np.intersect1d(*values)
            at = [np.searchsorted(both, v).clip(0, max(0, len(both) - 1)) for v in values]
            hit = [both[p] == v if len(both) else np.zeros(len(v), bool) for p, v in zip(at, values, strict=True)]
            shared = np.zeros((apart.num_rows, rows.num_rows), np.float32)
            for lo in range(0, len(both), COLUMNS):
                mats = []
                for n, p, h, o in zip(sizes, at, hit, of, strict=True):
                    part = h & (p >= lo) & (p < lo + COLUMNS)
                    m = np.zeros((len(n), min(COLUMNS, len(both) - lo)), np.float32)
                    m[o[part], p[part] - lo] = 1
                    mats.append(m)
                shared += mats[0] @ mats[1].T
            (ra, ca, na), (rb, cb, nb) = ([t.column(c).to_numpy() for c in ("rep", "component", "size")] for t in (apart, rows))
            differ = sizes[0][:, None] + sizes[1][None] - 2 * shared
            good = ((100 + percent) * differ <= (100 - percent) * (na[:, None] + nb[None])) & (ca[:, None] != cb[None])
            for i in np.flatnonzero(good.any(axis=1)):
                j = np.flatnonzero(good[i])
                j = j[np.unique(cb[j], return_index=True)[1]]
                a.append(np.full(len(j), ra[i]))
                b.append(rb[j])
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"a": cat(a), "b": cat(b)})
    return run


def group_links(homes: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of the documents (home, rep) that share a home."""
    diff = (homes.join(sets.select(F.col("doc_id").alias("rep"), F.col("members").alias("own")).dropDuplicates(["rep"]), "rep")
            .join(sets.select(F.col("doc_id").alias("home"), F.col("members").alias("base")).dropDuplicates(["home"]), "home"))
    rows = (diff.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "home", "rep", F.coalesce("component", "rep").alias("component"), F.size("own").cast("long").alias("size"),
        F.concat(F.array_except("own", "base"), F.array_except("base", "own")).alias("diff")))
    rows = stored(rows)
    groups = (rows.groupBy("home", "component").agg(F.count("*").alias("n")).groupBy("home")
              .agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", "n").alias("main")).where("n > most")
              .select("home", "main", F.ceil((F.col("n") - F.col("most")) / APART_ROWS).cast("int").alias("na"),
                      F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("nb")))
    rows = rows.join(groups, "home")
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    data = ["home", "i", "j", "rep", "component", "size", "diff"]
    apart = rows.where("component <> main").withColumn("i", place("na")).withColumn("j", every("nb")).select(*(F.col(c).alias(c) for c in data))
    whole = rows.withColumn("j", place("nb")).withColumn("i", every("na")).select(*data)
    key = ["home", "i", "j"]
    return stored(apart.groupBy(key).cogroup(whole.groupBy(key)).applyInArrow(_block_links(percent), "a long, b long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for documents (doc_id, text).

    Null and empty texts have the empty set, link with nothing and are kept. A repeated doc_id gives repeated
    rows with the data of each row; both belong to the component of any of them. Null doc_ids come out with a
    null component and kept = true. Other columns are ignored.
    """
    spark = docs.sparkSession
    feats = stored(keyed_text(docs).mapInArrow(
        tidy(_features(shingle)), "doc_id long, n_shingles long, d0 long, d1 long, s0 long, s1 long, sig binary"))
    full = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["n_shingles", "d0", "d1"]
    reps = full.groupBy(digest).agg(F.min("doc_id").alias("rep"))
    names = stored(full.select("doc_id", *digest).join(reps, digest).select("doc_id", "rep"))
    members = (feats.join(names.where("doc_id = rep").select("rep").distinct(), feats.doc_id == F.col("rep"))
               .select("rep", "s0", "s1", "sig").dropDuplicates(["rep"]))
    members = stored(members)
    spots = stored(_met(members, 0, 2))

    stars = spots.where("rep <> top").select(F.col("top").alias("a"), F.col("rep").alias("b")).distinct()
    for c in "ba":
        stars = stars.join(members.select(F.col("rep").alias(c), F.col("s0").alias(c + "s0"), F.col("s1").alias(c + "s1")), c)
    pairs = stored(stars.where(_close("as0", "as1", "bs0", "bs1")).select("a", "b"))
    sets = full_sets(docs, pairs, shingle)
    labels = components(_similar(measured(pairs, sets), percent))
    homes = components(pairs).select(F.col("id").alias("rep"), F.col("component").alias("home"))
    labels = _joined(labels, group_links(homes, sets, labels, percent))

    wide, done = None, pairs
    for tree in range(TREES):
        level, large = 2, None
        while True:
            # members alone in a node go no further, so signatures are not exchanged and few rows meet labels and homes
            if wide is not None:
                spots = stored(_met(members, tree, level, large))
            rows = stored(spots.drop("top").join(_placed(members.drop("sig"), homes, labels), "rep"))
            nodes = stored(_open_nodes(rows))
            last = level >= MAX_LEVELS
            large = _few(nodes.where(F.col("apart") > NODE_LIMIT).select("path"))
            pairs = _compare(rows.join(nodes.where(F.col("apart") <= NODE_LIMIT), "path"))
            if last and not large.isEmpty():
                crowd = stored(rows.join(large, "path", "left_semi").select("rep").distinct())
                sets = full_sets(docs, crowd.select(F.col("rep").alias("a"), F.col("rep").alias("b")), shingle, sets)
                wanted = sets.join(_few(crowd.withColumnRenamed("rep", "doc_id")), "doc_id", "left_semi")
                crowd = stored(_sharing(_placed(crowd, homes, labels), wanted, percent))
                pairs = pairs.union(_compare(rows.join(crowd, "rep", "left_semi").join(nodes.where(F.col("apart") > NODE_LIMIT), "path")))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            pairs = stored(pairs.join(done, ["a", "b"], "left_anti"))
            if not pairs.isEmpty():
                done = done.union(pairs)
                sets = full_sets(docs, pairs, shingle, sets)
                found = _similar(measured(pairs, sets), percent)
                if not found.isEmpty():
                    labels = _joined(labels, found)
            if wide is None:
                wide = stored(rows.join(large, "path", "left_semi").select("rep").distinct())
                members = stored(members.join(_few(wide), "rep", "left_semi"))
            if last or large.isEmpty() or wide.isEmpty():
                break
            level += 2
        if wide.isEmpty():
            break

    whole = names.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "doc_id", F.coalesce("component", "rep").alias("found")).groupBy("doc_id").agg(F.min("found").alias("found"))
    component = F.coalesce("found", "doc_id")
    return feats.select("doc_id", "n_shingles").join(whole, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (id, component) after further links (a, b): only the links between components are followed."""
    of = {c: labels.select(F.col("id").alias(c), F.col("component").alias("c" + c)) for c in "ab"}
    between = links.join(of["a"], "a", "left").join(of["b"], "b", "left").select(
        F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    more = components(between)
    moved = labels.join(more.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select(
        "id", F.coalesce("to", "component").alias("component"))
    return stored(moved.union(more.join(labels, "id", "left_anti").select("id", "component")))


def _met(members: DataFrame, tree: int, level: int, large: DataFrame | None = None) -> DataFrame:
    """(path, rep, top): the members of nodes with several, and the smallest of each; only of those below ``large`` nodes, if given."""
    rows = members.select("rep", "sig").mapInArrow(_paths(tree, level), _SPOT)
    if large is not None:
        rows = rows.join(large.select(F.col("path").alias("up")), "up", "left_semi")
    node = Window.partitionBy("path")
    return (rows.select("path", "rep").withColumns({"n": F.count(F.lit(1)).over(node), "top": F.min("rep").over(node)})
            .where("n > 1").drop("n"))


def _placed(members: DataFrame, homes: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (rep ...) with their home and component; both are rep itself where there is none."""
    return (members.join(homes, "rep", "left").join(labels.withColumnRenamed("id", "rep"), "rep", "left")
            .withColumns({"home": F.coalesce("home", "rep"), "component": F.coalesce("component", "rep")}))


def _sharing(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep): the members (rep, home, component) that can link to one of another component and home.

    At least ``percent`` of their shingles lie in sets of such others. Components only grow, so a member left out here needs no
    later look. Of several sets of a repeated id the smallest counts.
    """
    each = members.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select(
        "rep", "home", "component", F.size("members").alias("size"), F.explode("members").alias("shingle"))
    among = Window.partitionBy("shingle")  # each shingle of a member is exploded and exchanged once, and stays one row
    met = (each.withColumns({f"{n}_{c}": f(c).over(among) for c in ("home", "component") for n, f in (("least", F.min), ("most", F.max))})
           .where("least_home < most_home AND least_component < most_component"))
    return (met.groupBy("rep")
            .agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("size")).where(100 * F.col("n") >= percent * F.col("size")).select("rep"))


def _open_nodes(rows: DataFrame) -> DataFrame:
    """Nodes (path, n, apart, main) that can hold a new link: members of several components and of several homes.

    ``apart`` counts the members outside the node's largest component, ``main``.
    """
    kinds = rows.groupBy("path", "component").agg(F.count("*").alias("n"), F.min("home").alias("first"), F.max("home").alias("last"))
    return (kinds.groupBy("path").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("component", "n").alias("main"),
                                      F.count("*").alias("kinds"), F.min("first").alias("first"), F.max("last").alias("last"))
            .where("kinds > 1 AND first < last").select("path", "n", (F.col("n") - F.col("most")).alias("apart"), "main"))


def _compare(rows: DataFrame) -> DataFrame:
    """Pairs with close sketches of a member outside its node's main component and any member of another component.

    Members of one home have met already. Large nodes are dealt in blocks of members against blocks of apart ones.
    """
    names = {"rep": "", "component": "c", "s0": "s0", "s1": "s1", "home": "h"}
    na, nb = (F.ceil(F.col(c) / size).cast("int") for c, size in (("apart", APART_ROWS), ("n", GROUP_ROWS)))
    own = lambda parts: F.pmod(F.xxhash64("rep"), parts).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
    a = rows.where("component <> main").withColumn("i", own(na)).withColumn("j", every(nb))
    a = a.select("path", "i", "j", *(F.col(c).alias("a" + x) for c, x in names.items()))
    b = rows.withColumn("j", own(nb)).withColumn("i", every(na))
    b = b.select("path", "i", "j", "main", *(F.col(c).alias("b" + x) for c, x in names.items()))
    once = (F.col("bc") == F.col("main")) | (F.col("a") < F.col("b"))
    pairs = a.join(b, ["path", "i", "j"]).where(
        once & (F.col("ac") != F.col("bc")) & (F.col("ah") != F.col("bh")) & _close("as0", "as1", "bs0", "bs1"))
    return pairs.select("a", "b")
