"""Language of documents and of stretches in mixed documents.

Words are scored per language by letter trigrams counted over the whole training corpus. The script of a word
narrows the languages it may have. Viterbi over the words of a text, with a penalty for each switch, labels
each word; equal labels in a row are a span. A text's language is the one with most letters under its spans.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import keyed_text, split_words, text_slices

CELLS = 1 << 16
SWITCH = 12.0
#: A language may have a script that at least this share of its training words has.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
SLICE = 4 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[[*range(0x09, 0x0E), *range(33, 65), *range(91, 97), *range(123, 127)]] = 32
#: Scripts by the first byte of a character in UTF-8.
SCRIPTS = ["none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other"]
_SCRIPT = np.zeros(256, np.int8)
for _name, _first, _last in [("latin", 0x61, 0x7A), ("latin", 0xC3, 0xCA), ("other", 0xCB, 0xCD), ("greek", 0xCE, 0xCF),
                             ("cyrillic", 0xD0, 0xD4), ("other", 0xD5, 0xD5), ("hebrew", 0xD6, 0xD7), ("arabic", 0xD8, 0xDF),
                             ("indic", 0xE0, 0xE0), ("other", 0xE1, 0xE2), ("kana", 0xE3, 0xE3), ("han", 0xE4, 0xE9),
                             ("hangul", 0xEA, 0xED), ("other", 0xEE, 0xF4)]:
    _SCRIPT[_first:_last + 1] = SCRIPTS.index(_name)


def _fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; ASCII digits and punctuation become blanks."""
    out = _FOLD[data]
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    out[after & (data >= 0x80) & (data <= 0x9E)] += 32
    return out


def _word_cells(data: np.ndarray, bounds: np.ndarray):
    """Words, the trigram cell at each byte of a word and at its end, and which word each cell belongs to."""
    text = np.concatenate([_fold(data), [32]]).astype(np.uint32)
    words = split_words(text[:-1].astype(np.uint8), bounds)
    one = np.concatenate([[32], text[:-1]]).astype(np.uint32)
    two = np.concatenate([[32, 32], text[:-2]]).astype(np.uint32)
    size = words.end - words.start + 1
    begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    spot = np.repeat(words.start - begin[:-1], size) + np.arange(begin[-1])
    c, b, a = text[spot], one[spot], two[spot]
    lead = begin[:-1]
    b[lead], a[lead] = 32, 32
    if len(spot):
        late = lead + 1
        a[late] = 32
        c[begin[1:] - 1] = 32
    cells = (((a * np.uint32(0x9E3779B1) ^ b * np.uint32(0x85EBCA6B)) + c * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    script = np.maximum.reduceat(_SCRIPT[words.data], words.start) if len(words.start) else np.zeros(0, np.int8)
    return words, cells, begin, script


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray   # language x cell: log probability
    allowed: np.ndarray  # script x language


def _count(batches):
    cells: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        for lo, hi, data, bounds in text_slices(batch.column(1)):
            words, cell, begin, script = _word_cells(data, bounds)
            doc = np.repeat(np.arange(hi - lo), np.diff(words.first))
            for lang in set(langs[lo:hi]):
                own = (langs[lo:hi] == lang)[doc]
                total = cells.setdefault(lang, np.zeros(CELLS + len(SCRIPTS), np.int64))
                total[:CELLS] += np.bincount(cell[np.repeat(own, np.diff(begin))], minlength=CELLS)
                total[CELLS:] += np.bincount(script[own], minlength=len(SCRIPTS))
    for lang, total in cells.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])],
                                         names=["lang", "cell", "n"])


def fit(docs: DataFrame) -> Model:
    """Count all documents (text, lang). What comes to the driver is at most 65,547 counts for each language."""
    text = docs.where("lang IS NOT NULL").select("lang", F.coalesce("text", F.lit("")).alias("text"))
    rows = text.mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    total = np.zeros((len(languages), CELLS + len(SCRIPTS)))
    total[np.searchsorted(languages, rows["lang"].to_numpy(dtype=object)) if len(rows) else [], rows["cell"]] = rows["n"]
    grams, scripts = total[:, :CELLS] + 0.05, total[:, CELLS:]
    table = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
    allowed = (scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T >= SCRIPT_SHARE
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, table, allowed)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best label of each word; scores word x label, text i holding words first[i]:first[i + 1].

    All texts advance together, so the loop runs over places in a text, not over words.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    label = np.zeros(len(scores), np.int16)
    if not len(scores) or scores.shape[1] < 2:
        return label
    stay = np.zeros(scores.shape, bool)
    jump = np.zeros(len(scores), np.int16)
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # texts with more than t words
    best = scores[begin[:active[0]]].copy()
    for t in range(1, longest):
        a = active[t]
        at, v = begin[:a] + t, best[:a]
        top = v.argmax(axis=1)
        floor = v[np.arange(a), top] - switch
        keep = v >= floor[:, None]
        best[:a] = np.where(keep, v, floor[:, None]) + scores[at]
        stay[at], jump[at] = keep, top
    state = best.argmax(axis=1) if len(best) else np.zeros(0, int)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at, now = begin[:a] + t, state[:a]
        label[at] = now
        if t:
            state[:a] = np.where(stay[at, now], now, jump[at])
    return label


def _has_letter(data: bytes) -> bool:
    return any(c.isalpha() for c in data.decode("utf-8", "replace"))


def label_words(column: pa.Array, model: Model):
    """For slices of texts: (first row, end row, data, bounds, words, label of each word)."""
    for lo, hi, data, bounds in text_slices(column, SLICE):
        words, cells, begin, script = _word_cells(data, bounds)
        scores = np.zeros((len(words.start), len(model.languages)), np.float32)
        if len(scores):
            for i in range(len(model.languages)):
                scores[:, i] = np.add.reduceat(model.table[i][cells], begin[:-1])
            scores[~model.allowed[script]] -= 1000
        yield lo, hi, data, bounds, words, viterbi(scores, words.first, SWITCH)


def _verdicts(column: pa.Array, model: Model):
    for lo, hi, data, bounds, words, label in label_words(column, model):
        n, k = hi - lo, len(model.languages)
        doc = np.repeat(np.arange(n), np.diff(words.first))
        mass = np.bincount(doc * k + label, words.end - words.start, n * k).reshape(n, k) if k else np.zeros((n, 1))
        top = mass.argmax(axis=1)
        share = mass[np.arange(n), top] / np.maximum(mass.sum(axis=1), 1)
        ascii_letter = np.concatenate([[0], np.cumsum((data | 32) - ord("a") < 26)])
        known = ascii_letter[bounds[1:]] > ascii_letter[bounds[:-1]]
        for i in np.flatnonzero(~known):
            known[i] = _has_letter(data[bounds[i]:bounds[i + 1]].tobytes())
        known &= k > 0
        yield lo, hi, data, bounds, words, label, np.where(known, top, -1), np.where(known, share, 0.0)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every document: the main language and its share of the letters.

    Null texts and texts without a letter are 'und' with score 0; so is every text if nothing was learned.
    Ties go to the language first in the alphabet. Other columns are ignored.
    """
    def run(batches):
        for batch in batches:
            for lo, hi, _, _, _, _, top, share in _verdicts(batch.column(1), model):
                names = np.array([*model.languages, UNKNOWN], dtype=object)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names[top], pa.string()),
                                                  pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, spans) with spans (start, end, lang) in code points: stretches of words of one language."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            for lo, hi, data, bounds, words, label, _, _ in _verdicts(batch.column(1), model):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                out = []
                for i in range(hi - lo):
                    a, b, base = words.first[i], words.first[i + 1], chars[bounds[i]]
                    cut = a + np.flatnonzero(np.diff(label[a:b], prepend=-1)) if model.languages and b > a else []
                    out.append([{"start": int(chars[words.start[s]] - base), "end": int(chars[words.end[e - 1]] - base),
                                 "lang": model.languages[label[s]]} for s, e in zip(cut, [*cut[1:], b], strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, kind)], names=["doc_id", "spans"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, spans array<struct<start:long,end:long,lang:string>>")
