"""Toxicity: a convolutional text classifier in numpy.

A token is a run of letters or digits, A-Z lower-cased.  Its vector is the sum
of two hashed embeddings, of the word and of its first five bytes; a bucket
that fewer than ``SEEN`` training texts have is zero, and only the others are kept.  Filters of
widths 1, 2 and 3 run over the tokens, are rectified and max-pooled over the
whole text, and one dense layer gives the margin.  The first embedding
component starts at the word's smoothed log-odds in the training sample, which
lets max pooling find the telling words from the first step on; all weights
are then trained by Adam.

The language is predicted from the text by the model of ``langid``, which is
fitted on the languages of the same training rows; scores see the text alone.  Margins
are calibrated (Platt) and the threshold chosen per predicted language on a
held-back part of the sample, and the score is shifted so that every
language's threshold is 0.5.

Defined edge cases: null or empty text, or one without tokens, gets the score
of an all-zero pooling; without labels of both classes every score is 0;
repeated rows are each returned; an id with several labels is an example of
each, of several texts of an id the least is learned; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import langid
from . import textmodel as tm
from .session import ship

#: Rows per class of the training sample.
PER_CLASS = 1200
#: Hash buckets of words and of word beginnings, embedding size, filters per width.
WORDS, STEMS, SIZE, FILTERS, WIDTHS = 1 << 20, 1 << 18, 12, 8, (1, 2, 3)
#: Values of a filter that the pooling keeps: one telling word may stand anywhere, two rarely do.
MOST = 2
STEM_BYTES = 5
#: Training texts that must have a bucket, so that rare words are not learned by heart.
SEEN = 4
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Fewest calibration rows of either class for a language to have its own threshold.
OWN = 10

TOKEN = tm.LETTERS.copy()
TOKEN[0x30:0x3A] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Row, word bucket and stem bucket of each token, and the number of rows."""
    data, offsets = at.buffer(column)
    data = at.LOWER[data]
    spans = at.Spans(data, offsets, TOKEN)
    hasher = at.Hasher(data, tm.VALUES)
    word = hasher.spans(spans.start, spans.end)
    stem = hasher.spans(spans.start, np.minimum(spans.end, spans.start + STEM_BYTES))
    return spans.row, (word & np.uint64(WORDS - 1)).astype(np.int64), (stem & np.uint64(STEMS - 1)).astype(np.int64), len(offsets) - 1


@dataclass
class Model:
    known: np.ndarray | None = None  # the buckets of the training texts; stems follow the words
    embed: np.ndarray | None = None  # (1 + len(known), SIZE), zeros first
    filters: list[np.ndarray] = field(default_factory=list)  # (width * SIZE, FILTERS)
    shifts: list[np.ndarray] = field(default_factory=list)
    dense: np.ndarray | None = None
    bias: float = 0.0
    languages: langid.Model = field(default_factory=langid.Model)
    calibration: dict[str, tuple[float, float]] = field(default_factory=dict)  # '' for any other

    def pooled(self, row: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``MOST`` largest rectified values per text and filter, and the token where each begins (-1: none, or not in training)."""
        out, where = [], []
        some, first = np.unique(row, return_index=True)
        for width, f, b in zip(WIDTHS, self.filters, self.shifts, strict=True):
            padded = np.concatenate([x, np.zeros((width - 1, SIZE), np.float32)]) if width > 1 else x
            value = sum(padded[k : k + len(x)] @ f[k * SIZE : (k + 1) * SIZE] for k in range(width)) + b
            if width > 1:  # a window stays in its text
                value[np.append(row, np.full(width - 1, -1))[width - 1 :] != row] = 0
            for _ in range(MOST):
                best, place = np.zeros((n, FILTERS), np.float32), np.full((n, FILTERS), -1, np.int64)
                if len(some):
                    best[some] = np.maximum(np.maximum.reduceat(value, first, axis=0), 0)
                    i, k = np.nonzero((value == best[row]) & (value > 0))
                    place[row[i[::-1]], k[::-1]] = i[::-1]
                    i, k = np.nonzero(place >= 0)
                    value[place[i, k], k] = 0  # the next round finds the next one
                out.append(best)
                where.append(place)
        return np.concatenate(out, axis=1), np.concatenate(where, axis=1)

    _slots = None

    def slots(self, word: np.ndarray, stem: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the embedding of each token's word and stem."""
        if self._slots is None:
            self._slots = np.zeros(WORDS + STEMS, np.int32)
            self._slots[self.known] = np.arange(1, len(self.known) + 1)
        return self._slots[word], self._slots[WORDS + stem]

    def margins(self, column: pa.Array) -> np.ndarray:
        row, word, stem, n = tokens(column)
        w, s = self.slots(word, stem)
        pooled, _ = self.pooled(row, self.embed[w] + self.embed[s], n)
        return pooled @ self.dense + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        if self.embed is None:
            return np.zeros(len(column))
        margin = self.margins(column).astype(np.float64)
        langs, _ = self.languages.predict(column)
        a, b = np.array([self.calibration.get(x) or self.calibration[""] for x in langs]).reshape(-1, 2).T
        return tm.sigmoid(a * margin + b)


def fit(examples: list[tuple[int, str]], languages: langid.Model, seed: int = 10) -> Model:
    """examples: (1 toxic or 0, text), in an order that has nothing to do with the label."""
    y = np.array([1.0 if t else 0.0 for t, _ in examples])
    if not 0 < y.sum() < len(y):
        return Model(languages=languages)
    column, n = pa.array([t for _, t in examples], pa.large_string()), len(examples)
    parts = [(i, tokens(column.slice(i, 128))) for i in range(0, n, 128)]  # a few texts at a time: memory follows these
    row, word, stem = (np.concatenate([t[k] + (i if k == 0 else 0) for i, t in parts]) for k in range(3))
    back = np.arange(n) % 4 == 0
    if not 0 < y[back].sum() < back.sum() or not 0 < y[~back].sum() < (~back).sum():
        back = np.zeros(n, bool)
    rng = np.random.default_rng(seed)
    both = np.concatenate([word, WORDS + stem])
    bucket, texts = np.unique(np.unique(np.concatenate([row, row]) * (WORDS + STEMS) + both) % (WORDS + STEMS), return_counts=True)
    model = Model(known=bucket[texts >= SEEN].astype(np.int32), languages=languages)
    word, stem = model.slots(word, stem)
    size = 1 + len(model.known)
    model.embed = (0.05 * rng.standard_normal((size, SIZE))).astype(np.float32)
    model.embed[0] = 0
    for slot in (word, stem):
        seen = np.unique(row * size + slot)  # presence per text
        r, b = seen // size, seen % size
        use = ~back[r]
        up = np.bincount(b[use], weights=y[r[use]], minlength=size) + 0.5
        down = np.bincount(b[use], weights=1 - y[r[use]], minlength=size) + 0.5
        odds = np.log(up / (y[~back].sum() + 1)) - np.log(down / ((1 - y[~back]).sum() + 1))
        own = np.unique(slot[slot > 0])
        model.embed[own, 0] = np.clip(odds, -3, 3)[own] / 3
    for width in WIDTHS:
        f = (rng.standard_normal((width * SIZE, FILTERS)) / np.sqrt(width * SIZE)).astype(np.float32)
        f[::SIZE] = np.abs(f[::SIZE]) + 0.5
        model.filters.append(f)
        model.shifts.append(np.full(FILTERS, -0.3, np.float32))
    model.dense = np.full(MOST * FILTERS * len(WIDTHS), 0.1, np.float32)
    start = np.searchsorted(row, np.arange(n + 1))
    weights = [model.embed, *model.filters, *model.shifts, model.dense]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    balance = np.where(y > 0, 0.5 / y[~back].mean(), 0.5 / (1 - y[~back]).mean())
    order, step, bias_m, bias_v = np.flatnonzero(~back), 0, 0.0, 0.0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(order), max(1, len(order) // BATCH)):
            step += 1
            take = np.concatenate([np.arange(start[i], start[i + 1]) for i in part])
            r = np.repeat(np.arange(len(part)), start[part + 1] - start[part])
            w, s = word[take], stem[take]
            x = model.embed[w] + model.embed[s]
            pooled, where = model.pooled(r, x, len(part))
            p = tm.sigmoid(pooled @ model.dense + model.bias)
            g = ((p - y[part]) * balance[part] / len(part)).astype(np.float32)
            gp = np.where(where >= 0, g[:, None] * model.dense, 0)
            grads: list[np.ndarray] = [np.zeros_like(model.embed)]
            gx = np.zeros((len(x) + max(WIDTHS), SIZE), np.float32)
            padded = np.concatenate([x, np.zeros((max(WIDTHS), SIZE), np.float32)])
            shifts = []
            for j, width in enumerate(WIDTHS):
                gf = np.zeros_like(model.filters[j])
                part_ = slice(j * MOST * FILTERS, (j + 1) * MOST * FILTERS)
                some, own = gp[:, part_], where[:, part_]
                for k in range(MOST * FILTERS):
                    ok, f = own[:, k] >= 0, k % FILTERS
                    place, value = own[ok, k], some[ok, k]
                    for d in range(width):
                        gf[d * SIZE : (d + 1) * SIZE, f] += value @ padded[place + d]
                        np.add.at(gx, place + d, value[:, None] * model.filters[j][d * SIZE : (d + 1) * SIZE, f])
                grads.append(gf)
                shifts.append(some.sum(axis=0).reshape(MOST, FILTERS).sum(axis=0))
            touched = np.flatnonzero(np.abs(gx[: len(x)]).sum(axis=1))
            rows_ = np.unique(np.concatenate([w[touched], s[touched]]))
            rows_ = rows_[rows_ > 0]
            np.add.at(grads[0], w[touched], gx[touched])
            np.add.at(grads[0], s[touched], gx[touched])
            grads += [*shifts, pooled.T @ g]
            rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for i, (wt, gr, (m, v)) in enumerate(zip(weights, grads, moments, strict=True)):
                at_ = rows_ if i == 0 else slice(None)  # embeddings move only where touched
                m[at_] = 0.9 * m[at_] + 0.1 * gr[at_]
                v[at_] = 0.999 * v[at_] + 0.001 * gr[at_] ** 2
                wt[at_] -= rate * m[at_] / (np.sqrt(v[at_]) + 1e-8)
            gb = float(g.sum())
            bias_m, bias_v = 0.9 * bias_m + 0.1 * gb, 0.999 * bias_v + 0.001 * gb * gb
            model.bias -= rate * bias_m / (np.sqrt(bias_v) + 1e-8)
    margin = np.concatenate([model.margins(column.slice(i, 256)) for i in range(0, n, 256)]).astype(np.float64)
    langs = np.array([x for i in range(0, n, 256) for x in languages.predict(column.slice(i, 256))[0]])
    by = back if back.any() else ~back
    for lang in ["", *sorted(set(langs.tolist()))]:
        own = by & ((langs == lang) | (lang == ""))
        if lang and min(y[own].sum(), (1 - y[own]).sum()) < OWN:
            continue
        a, b = tm.platt(margin[own], np.where(y[own] > 0, 1, -1))
        if a > 0:
            model.calibration[lang] = (a, b - _threshold(a * margin[own] + b, y[own]))
    model.calibration.setdefault("", (1.0, 0.0))
    model._slots = None
    return model


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The calibrated margin that errs least (both classes weigh the same), in the middle of the gap."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.concatenate([[0], np.cumsum(y) / y.sum()]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1] / (1 - y).sum(), [0]])
    best = np.flatnonzero(errors <= errors.min() + 1e-12)
    k = int(best[len(best) // 2])
    return float((z[max(0, k - 1)] + z[min(len(z) - 1, k)]) / 2)


def train(docs: DataFrame, labels: DataFrame, *, held_out: tuple[int, int] = (5, 0), id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    marks = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("class")).filter(F.col("class").isin(0, 1))
    marks = marks.filter(tm.fold("id", held_out[0]) != held_out[1])
    rows = [(toxic, text) for _, toxic, text in tm.sample(docs, marks, PER_CLASS, id_column, text_column)]
    return fit(rows, langid.train(docs, held_out=held_out, id_column=id_column, text_column=text_column, lang_column=lang_column))


def annotate(docs: DataFrame, model: Model, *, held_out: tuple[int, int] = (5, 0), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score is at least 0.5) of every row."""
    shared = ship(docs.sparkSession, model)
    source = docs.select(F.col(id_column).alias("doc_id"), (tm.fold(id_column, held_out[0]) == held_out[1]).alias("held_out"), F.col(text_column).alias("text"))

    def score(part: pa.RecordBatch) -> list[pa.Array]:
        s = shared().scores(part.column("text"))
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, held_out boolean, score double, predicted int"
    return tm.map_slices(source, schema, score, ["doc_id", "held_out"])
