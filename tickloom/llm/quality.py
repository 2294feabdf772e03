"""Document quality by Bradley-Terry pairwise ranking.

A good and a bad labelled document form a preference pair. The chance that one beats the other is the logistic
function of the difference of their scores, and a score is linear in features of the whole text; so logistic
loss on feature differences fits the weights. All labelled documents and all their pairs count: a document meets the
other label's documents by their numbers and sums in narrow bins of score, so a Newton step is two passes over the
features, and only bins and matrices of the features reach the driver. The cut lies at the score quantile that equals the
share of rejected labels, and scores are shifted so that this cut reads 0.3.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import U64, keyed_text, split_words, stored, text_slices, tidy

CUT = 0.3
#: Width of the bins of score in which documents of one label meet those of the other; at most about BINS of them.
BIN = 1 / 64
BINS = 4096
STEPS = 25
#: Different scores among which the cut is looked up at once; a longer range is first narrowed to one of BINS parts.
CUT_SCORES = 1 << 14

_GROUPS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!", "|", "*#$%&", "@", ".,", "\n", " ",
           "<>{}[]()\\/_=;", ":\"'?-+~^`"]
_CLASS = np.full(256, len(_GROUPS), dtype=np.uint8)
for _i, _chars in enumerate(_GROUPS):
    _CLASS[[ord(c) for c in _chars]] = _i
N_FEATURES = len(_GROUPS) + 1 + 7


def text_features(column: pa.Array) -> np.ndarray:
    """One row of features for each text; empty texts give zeros but for the length."""
    out = []
    for lo, hi, data, bounds in text_slices(column):
        n, size = hi - lo, np.diff(bounds)
        row = np.repeat(np.arange(n), size)
        share = np.bincount(row * 13 + _CLASS[data], minlength=n * 13).reshape(n, 13) / np.maximum(size, 1)[:, None]
        words = split_words(data, bounds)
        h, count = words.hashes(), np.diff(words.first)
        of = np.repeat(np.arange(n), count)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        keys = np.sort((h >> U64(20)) | (of.astype(U64) << U64(44)))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        kinds = np.bincount((keys[fresh] >> U64(44)).astype(int), minlength=n)
        length = words.end - words.start
        known = np.maximum(count, 1)
        out.append(np.column_stack([
            np.sqrt(share), np.log1p(count), np.bincount(of, length, n) / known / 10,
            np.sqrt(np.bincount(of, again, n) / known), kinds / known,
            np.log1p(kinds) - np.log1p(count) * 0.8, np.bincount(of, length > 20, n) / known,
            np.bincount(of, length == 1, n) / known]))
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        raw = _standard(features, self.mean, self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(raw - self.cut + np.log(CUT / (1 - CUT)), -60, 60)))


def _named(prefix: str) -> list[str]:
    return [f"{prefix}{i}" for i in range(N_FEATURES)]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, N_FEATURES)


def _standard(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -6, 6)


def _binned(rows: DataFrame, mean, scale, w: np.ndarray, width: float) -> dict[int, tuple]:
    """For each label: bins of score in use, documents in them, sums of their features."""
    def run(batches):
        for batch in batches:
            label, z = np.asarray(batch.column(0)), _standard(_matrix(batch.column(1)), mean, scale)
            place = np.column_stack([label, np.floor(z @ w / width)]).astype(np.int64)
            used, of, n = np.unique(place, axis=0, return_inverse=True, return_counts=True)
            sums = np.zeros((len(used), N_FEATURES))
            np.add.at(sums, of.reshape(-1), z)
            yield pa.RecordBatch.from_arrays([pa.array(used[:, 0]), pa.array(used[:, 1]), pa.array(n.astype(np.int64)),
                                              *[pa.array(c) for c in sums.T]], names=["label", "bin", "n", *_named("z")])

    schema = "label long, bin long, n long, " + ", ".join(f"{c} double" for c in _named("z"))
    got = rows.mapInArrow(tidy(run), schema).groupBy("label", "bin").agg(*[F.sum(c).alias(c) for c in ("n", *_named("z"))]).collect()
    out = {}
    for v in (0, 1):
        own = np.array([r[1:] for r in sorted(got) if r.label == v], dtype=float).reshape(-1, N_FEATURES + 2)
        out[v] = own[:, 0].astype(np.int64), own[:, 1], own[:, 2:]
    return out


def _squares(rows: DataFrame, mean, scale, w: np.ndarray, width: float, weights: dict[int, tuple]) -> np.ndarray:
    """The sum of weight * x * x' over all documents; ``weights`` holds bins and their weights for each label."""
    def run(batches):
        total = np.zeros((N_FEATURES, N_FEATURES))
        for batch in batches:
            label, z = np.asarray(batch.column(0)), _standard(_matrix(batch.column(1)), mean, scale)
            place = np.floor(z @ w / width).astype(np.int64)
            for v, (bins, weight) in weights.items():
                own = label == v
                at = np.minimum(np.searchsorted(bins, place[own]), len(bins) - 1)
                total += (z[own] * weight[at][:, None]).T @ z[own]
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1)], pa.list_(pa.float64()))], names=["s"])

    each = rows.mapInArrow(tidy(run), "s array<double>").select(F.posexplode("s").alias("at", "s"))
    got = each.groupBy("at").agg(F.sum("s").alias("s")).collect()
    return np.array([r.s for r in sorted(got)]).reshape(N_FEATURES, N_FEATURES)


def _newton(rows: DataFrame, mean, scale, l2: float) -> np.ndarray:
    """Weights of the least mean logistic loss over all (good, bad) pairs."""
    w = np.zeros(N_FEATURES)
    for _ in range(STEPS):
        width = max(BIN, 12 * np.abs(w).sum() / BINS)
        binned = _binned(rows, mean, scale, w, width)
        (bad_bins, bad_n, bad), (good_bins, good_n, good) = binned[0], binned[1]
        bad_at, good_at = bad @ w / bad_n, good @ w / good_n
        lost, curved = [np.zeros(len(bad_n)), np.zeros(len(good_n))], [np.zeros(len(bad_n)), np.zeros(len(good_n))]
        cross = np.zeros((N_FEATURES, N_FEATURES))
        for lo in range(0, len(good_n), 256):
            own = slice(lo, lo + 256)
            lose = 1 / (1 + np.exp(np.clip(good_at[own, None] - bad_at[None, :], -40, 40)))
            curve = lose * (1 - lose)
            lost[1][own], curved[1][own] = lose @ bad_n, curve @ bad_n
            lost[0] += good_n[own] @ lose
            curved[0] += good_n[own] @ curve
            cross += good[own].T @ curve @ bad
        pairs = good_n.sum() * bad_n.sum()
        gradient = (lost[0] @ bad - lost[1] @ good) / pairs + l2 * w
        squares = _squares(rows, mean, scale, w, width, {0: (bad_bins, curved[0]), 1: (good_bins, curved[1])})
        step = np.linalg.solve((squares - cross - cross.T) / pairs + l2 * np.eye(N_FEATURES), gradient)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return np.round(w, 6)  # so that the order in which tasks add up does not show


def _cut_at(scores: DataFrame, weight: tuple[float, float], share: float) -> float:
    """The middle between the score where the weights of labels 0 and 1 add up to ``share`` and the next one.

    Equal scores across that point stay above it.
    """
    def read(groups):
        got = sorted(groups.agg(F.count_if(F.col("label") == 0).alias("n0"), F.count_if(F.col("label") == 1).alias("n1"),
                                F.min("score").alias("lo"), F.max("score").alias("hi")).drop("part").collect(), key=lambda r: r.lo)
        return got, np.array([[r.n0, r.n1] for r in got])

    def reaching(counts):
        reached = (before + np.cumsum(counts, axis=0)) @ np.array(weight) >= share * (1 - 1e-9)
        return int(np.argmax(reached)) if reached.any() else len(counts) - 1

    before, part = np.zeros(2), scores
    while part.select("score").distinct().limit(CUT_SCORES + 1).count() > CUT_SCORES:
        lo, hi = part.agg(F.min("score"), F.max("score")).first()
        place = F.least(F.floor((F.col("score") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        got, counts = read(part.groupBy(place.alias("part")))
        at = reaching(counts)
        before = before + counts[:at].sum(axis=0)
        part = scores.where(F.col("score").between(got[at].lo, got[at].hi))
    got, counts = read(part.groupBy(F.col("score").alias("part")))
    at = reaching(counts)
    here = got[at].lo
    after = scores.where(F.col("score") > here).agg(F.min("score")).first()[0]
    over = (before + counts[:at + 1].sum(axis=0)) @ np.array(weight) > share * (1 + 1e-9)
    return here - 1e-9 if after is None or (over and counts[at].sum() > 1) else (here + after) / 2


def _featurise(batches):
    for batch in batches:
        x = text_features(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))],
                                         names=["doc_id", "x"])


def fit(docs: DataFrame, labels: DataFrame, l2: float = 1e-3) -> Model:
    """Fit on labels (doc_id, label 0 or 1); other label values and ids without a document are left out.

    Every labelled document takes part. Without documents of one label all weights are zero and every score is 0.5, so
    nothing is rejected.
    """
    labels = (labels.where("label IN (0, 1) AND doc_id IS NOT NULL")
              .groupBy("doc_id").agg(F.max("label").cast("int").alias("label")))
    total = dict(labels.groupBy("label").count().collect())
    x = keyed_text(docs).where("doc_id IS NOT NULL").mapInArrow(tidy(_featurise), "doc_id long, x array<double>")
    rows = stored(x.join(labels, "doc_id").select("label", "x"))
    found = dict(rows.groupBy("label").count().collect())
    if len(found) < 2:
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), np.log(CUT / (1 - CUT)))
    each = [F.col("x")[i] for i in range(N_FEATURES)]
    moments = rows.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    mean, scale = np.round(np.array(moments[:N_FEATURES]), 9), np.round(np.array(moments[N_FEATURES:]), 9) + 1e-6
    w = _newton(rows, mean, scale, l2)
    share_bad = total[0] / sum(total.values())

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_standard(_matrix(batch.column(1)), mean, scale) @ w)],
                                             names=["label", "score"])

    scores = stored(rows.mapInArrow(tidy(run), "label int, score double"))
    return Model(mean, scale, w, _cut_at(scores, (share_bad / found[0], (1 - share_bad) / found[1]), share_bad))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every document; null texts count as empty. Other columns are ignored."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(text_features(batch.column(1))))],
                                             names=["doc_id", "score"])

    return keyed_text(docs).mapInArrow(tidy(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score reaches the cut, all columns kept."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(model.scores(text_features(batch.column(at))) >= CUT))

    return docs.mapInArrow(tidy(run), docs.schema)
