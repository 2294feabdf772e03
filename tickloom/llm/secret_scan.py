"""Secrets in documents: fixed patterns, and a character convolutional network over every other candidate.

Candidates are runs of 12 or more token characters with a digit. The network reads a candidate with its
surroundings, a long one in overlapping windows over the whole run, and its highest output counts. Findings of the
patterns, of all three kinds, label the training windows (half of them once more with the text before the window's
part of the candidate blanked, so that the shape of a token counts too); windows that see none are negatives. Its
outputs are calibrated on held-out windows, and the threshold is the highest one that keeps the wanted recall there.
Every candidate that no finding covers whole is judged; findings inside it stay beside it.
"""
from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import keyed_text, large_text, text_slices, tidy

#: Documents that training reads: those with the smallest hash of doc_id, about this many.
SAMPLE_DOCUMENTS = 20_000
#: Training candidates of each class.
SAMPLE_CANDIDATES = 4_000
RECALL = 0.95
BEFORE, WINDOW = 20, 72
LEAST = 12
#: Windows of a long candidate begin so far apart: any 40 characters of it lie in one; the last sees what follows, as much as BEFORE.
STRIDE = 32

# The patterns of the three kinds, in order.
KINDS = ["assign", "access", "hex"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MODEL = "model"

_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HEX = np.zeros(256, bool)
_HEX[[*range(48, 58), *range(97, 103)]] = True
#: Characters as the network sees them: 0 is padding, other printable ASCII one each, the rest one.
_SEEN = np.full(256, 96, np.uint8)
_SEEN[32:127] = np.arange(1, 96)
_SEEN[0] = 0


def _runs(mask: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true bytes of at least a length, cut at text bounds."""
    opens = np.zeros(len(mask) + 1, bool)
    opens[bounds] = True
    lead, tail = mask.copy(), mask.copy()
    lead[1:] &= ~mask[:-1] | opens[1:-1]
    tail[:-1] &= ~mask[1:] | opens[1:-1]
    start, end = np.flatnonzero(lead), np.flatnonzero(tail) + 1
    keep = end - start >= least
    return start[keep], end[keep]


def base_spans(text: str, hexes: bool = True) -> list[tuple[int, str, int]]:
    """(start, kind, end) of pattern findings in code points, by start, then kind as listed."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if hexes:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return [(s, KINDS[k], e) for s, k, e in sorted(found)]


def _window(text: str, start: int, end: int) -> np.ndarray:
    raw = text[max(0, start - BEFORE):start].rjust(BEFORE, "\0") + text[start:start + WINDOW - BEFORE]
    codes = np.frombuffer(raw.encode("utf-32-le"), np.uint32)[:WINDOW]
    out = np.zeros(WINDOW, np.uint8)
    out[:len(codes)] = _SEEN[np.minimum(codes, 255)]
    return out


def _windows(text: str, start: int, end: int) -> np.ndarray:
    """Windows over a whole candidate and its surroundings, one a row."""
    seen = min(end + BEFORE, len(text))
    more = max(0, -(-(seen - start - (WINDOW - BEFORE)) // STRIDE)) if end - start > STRIDE else 0
    return np.array([_window(text, start + k * STRIDE, end) for k in range(more + 1)])


def examine(column: pa.Array):
    """For each text: its string, pattern findings, and candidates (start, end, windows) outside ... or inside them."""
    column = large_text(column)
    for lo, hi, data, bounds in text_slices(column):
        texts = column.slice(lo, hi - lo).to_pylist()
        start, end = _runs(_TOKEN[data], bounds, LEAST)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
        keep = digits[end] > digits[start]
        start, end = start[keep], end[keep]
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        of = np.searchsorted(bounds, start, side="right") - 1
        base = chars[bounds]
        hexed = np.zeros(hi - lo, bool)
        hexed[np.searchsorted(bounds, _runs(_HEX[data], bounds, 16)[0], side="right") - 1] = True
        at = np.searchsorted(of, np.arange(hi - lo + 1))
        for i, text in enumerate(texts):
            cands = [(int(chars[s] - base[i]), int(chars[e] - base[i]))
                     for s, e in zip(start[at[i]:at[i + 1]], end[at[i]:at[i + 1]], strict=True)]
            yield text, base_spans(text, bool(hexed[i])), [(s, e, _windows(text, s, e)) for s, e in cands]


# ---------------------------------------------------------------- network
@dataclass
class Network:
    """Embedding, one convolution, maximum over places, one hidden layer; plain numpy."""
    parts: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0

    WIDTH = 5

    @classmethod
    def fresh(cls, seed: int = 5, embed: int = 12, filters: int = 32, hidden: int = 16) -> Network:
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return cls({"embed": make(97, embed) * 3, "conv": make(cls.WIDTH * embed, filters), "cb": np.zeros(filters, np.float32),
                    "dense": make(filters, hidden), "db": np.zeros(hidden, np.float32), "out": make(hidden, 1),
                    "ob": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray):
        p = self.parts
        e = p["embed"][x]
        e[x == 0] = 0
        view = np.lib.stride_tricks.sliding_window_view(e, self.WIDTH, axis=1)
        cols = np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), e.shape[1] - self.WIDTH + 1, -1)
        maps = cols @ p["conv"] + p["cb"]
        top = maps.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(maps, top[:, None], 1)[:, 0], 0)
        hidden = np.maximum(pooled @ p["dense"] + p["db"], 0)
        return cols, top, pooled, hidden, (hidden @ p["out"] + p["ob"])[:, 0]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        cols, top, pooled, hidden, z = self.forward(x)
        dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(x))[:, None].astype(np.float32)
        dh = dz @ p["out"].T * (hidden > 0)
        dp = dh @ p["dense"].T * (pooled > 0)
        picked = np.take_along_axis(cols, top[:, :, None], 1)
        grad = {"out": hidden.T @ dz, "ob": dz.sum(0), "dense": pooled.T @ dh, "db": dh.sum(0),
                "conv": np.einsum("nfc,nf->cf", picked, dp, optimize=True), "cb": dp.sum(0)}
        back = (dp[:, :, None] * p["conv"].T[None]).reshape(len(x), top.shape[1], self.WIDTH, -1)
        chars = np.take_along_axis(x[:, None, :], top[:, :, None] + np.arange(self.WIDTH), 2)
        grad["embed"] = np.zeros_like(p["embed"])
        np.add.at(grad["embed"], chars, back)
        return grad

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, rate: float = 3e-3, batch: int = 64) -> None:
        rng, first, second, step = np.random.default_rng(6), {}, {}, 0
        weight = np.where(y > 0, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum()))
        for _ in range(max(epochs, -(-400 * batch // max(1, len(x))))):
            order = rng.permutation(len(x))
            for lo in range(0, len(order), batch):
                part, step = order[lo:lo + batch], step + 1
                for k, g in self.gradients(x[part], y[part], weight[part]).items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                    self.parts[k] = (self.parts[k] - rate * (first[k] / (1 - 0.9 ** step))
                                     / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Logistic calibration of the raw output, then the highest threshold that keeps the recall."""
        z = self.forward(x)[4]
        a, b = 1.0, 0.0
        for _ in range(300):
            d = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30))) - y
            a, b = a - 0.05 * (d * z).mean() - 1e-4 * a, b - 0.05 * d.mean()
        self.slope, self.shift = max(a, 1e-3), b
        good = np.sort(self.probability(x)[y > 0])
        self.threshold = float(good[int(np.floor((1 - recall) * len(good)))])

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        z = np.concatenate([self.forward(x[lo:lo + 512])[4] for lo in range(0, len(x), 512)])
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


def _labelled(batches):
    for batch in batches:
        key, y, x = [], [], []
        for doc, (_, spans, cands) in zip(batch.column(0).to_pylist(), examine(batch.column(1)), strict=True):
            for s, e, windows in cands:
                for k, window in enumerate(windows):
                    lo = s + k * STRIDE
                    hi = min(lo + WINDOW - BEFORE, e)
                    most = max((min(b, hi) - max(a, lo) for a, _, b in spans), default=0)
                    if 0 < most < LEAST and len(windows) > 1:
                        continue  # an edge of a finding says neither
                    key.append(hash((doc or 0, lo)))
                    y.append(int(most > 0))
                    x.append(window.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(y, pa.int32()), pa.array(x, pa.binary())],
                                         names=["k", "y", "x"])


def fit(docs: DataFrame, recall: float = RECALL) -> Network | None:
    """Train on candidates of a bounded sample of documents; None where one class is missing."""
    text = keyed_text(docs)
    many, space = text.count(), 1 << 30
    share = F.pmod(F.xxhash64("doc_id"), F.lit(space)) < int(space * min(1.0, SAMPLE_DOCUMENTS / max(1, many)))
    found = text.where(share).mapInArrow(tidy(_labelled), "k long, y int, x binary")
    rows = []
    for value in (0, 1):
        rows += found.where(F.col("y") == value).orderBy(F.xxhash64("k"), "x").limit(SAMPLE_CANDIDATES).collect()
    y = np.array([r.y for r in rows])
    x = np.array([np.frombuffer(r.x, np.uint8) for r in rows]).reshape(-1, WINDOW)
    held = np.arange(len(y)) % 4 == 3
    if min((y == v).sum() for v in (0, 1)) < 8:
        return None
    bare = x[~held & (y > 0)][::2].copy()
    bare[:, :BEFORE] = 0
    net = Network.fresh()
    net.train(np.concatenate([x[~held], bare]), np.concatenate([y[~held], np.ones(len(bare))]).astype(np.float32))
    net.calibrate(x[held], y[held], recall)
    return net


def all_spans(text: str, spans, cands, net: Network | None) -> list[tuple[int, str, int]]:
    """Pattern findings and, of the candidates that none of them covers whole, those that the network accepts."""
    free = [c for c in cands if not any(a <= c[0] and c[1] <= b for a, _, b in spans)]
    if net is None or not free:
        return spans
    first = np.cumsum([0, *(len(c[2]) for c in free[:-1])])
    good = np.maximum.reduceat(net.probability(np.concatenate([c[2] for c in free])), first) >= net.threshold
    more = [(c[0], MODEL, c[1]) for c, ok in zip(free, good, strict=True) if ok]
    order = {k: i for i, k in enumerate([*KINDS, MODEL])}
    return sorted([*spans, *more], key=lambda x: (x[0], order[x[1]], x[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, base, spans): arrays of (kind, start, end) in code points, end exclusive, for every document.

    ``base`` holds the pattern findings; ``spans`` these and the network's. Null texts are empty; other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            base, spans = [], []
            for text, found, cands in examine(batch.column(1)):
                base.append(found)
                spans.append(all_spans(text, found, cands, net))
            shaped = [pa.array([[{"kind": k, "start": s, "end": e} for s, k, e in row] for row in rows], pa.list_(SPAN))
                      for rows in (base, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *shaped], names=["doc_id", "base", "spans"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return keyed_text(docs).mapInArrow(tidy(run), f"doc_id long, base {span}, spans {span}")


def redact(docs: DataFrame, net: Network | None, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every span (overlapping ones merged) replaced; n_chars follows. Null texts stay null."""
    names, schema = docs.columns, docs.schema

    def run(batches):
        for batch in batches:
            at = names.index("text")
            texts = []
            for text, found, cands in examine(batch.column(at)):
                out, last = [], 0
                for s, _, e in all_spans(text, found, cands, net):
                    if e > last:
                        out += [text[last:s], mask] if s >= last else []
                        last = e
                texts.append("".join([*out, text[last:]]))
            fresh = pa.array([t if ok else None for t, ok in zip(texts, batch.column(at).is_valid().to_pylist(), strict=True)],
                             batch.schema.field(at).type)
            batch = batch.set_column(at, batch.schema.field(at), fresh)
            if "n_chars" in names:
                k = names.index("n_chars")
                sizes = [None if t is None else len(t) for t in fresh.to_pylist()]
                batch = batch.set_column(k, batch.schema.field(k), pa.array(sizes, batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(tidy(run), schema)
