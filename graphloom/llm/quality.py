"""Quality rules: base counts, then a calibrated hashed logistic regression.

The model sees hashed words and character trigrams of the whole text (case kept),
is trained on a bounded sample of labelled rows, and its margins are turned
into probabilities by Platt scaling on a held-back part of that sample.  A text
stays if it passes the base rules and its probability of being good is at
least ``THRESHOLD``.

Defined edge cases: a null text has no words and fails; without labelled rows
of both classes the base rules decide alone; labels of repeated ids all count;
repeated rows are each returned; ``keep`` leaves other columns as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import textmodel as tm
from .session import ship

#: Rows per class of the training sample, and the least probability of a good text.
PER_CLASS, THRESHOLD = 1500, 0.3

LEAST_WORDS, REPEATED_PERCENT = 50, 50
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

RESULT = "doc_id {id}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, p_good double"


@dataclass
class Model:
    weights: np.ndarray | None = None
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def probability(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.weights is None:
            return np.ones(n)
        rows, buckets = tm.hashed(data, offsets, None, False)
        margin = np.bincount(rows, weights=self.weights[buckets] * tm.scale(rows, buckets, n), minlength=n) + self.bias
        return tm.sigmoid(self.scale * margin + self.shift)


def fit(examples: list[tuple[int, str]]) -> Model:
    """examples: (1 good or 0, text), in an order that has nothing to do with the label."""
    y = np.array([1 if good else -1 for good, _ in examples])
    if not (y > 0).any() or not (y < 0).any():
        return Model()
    x = tm.Examples([t for _, t in examples], None, False)
    back = np.arange(len(y)) % 4 == 0  # held back for the calibration
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back = np.zeros(len(y), bool)
    w, bias = tm.fit_linear(x, y, tm.logistic_slope, use=~back)
    by = back if back.any() else ~back
    return Model(w.astype(np.float32), bias, *tm.platt((x.dot(w) + bias)[by], y[by]))


def train(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> Model:
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("class")).filter(F.col("class").isin(0, 1))
    return fit([(good, text) for _, good, text in tm.sample(docs, marks, PER_CLASS, id_column, text_column)])


def repeats(words: list[bytes]) -> int:
    """Words in three-word windows found twice or more, the first included."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    total, reach = 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + 3 - max(i, reach)
            reach = i + 3
    return total


def repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


@dataclass
class Scores:
    words: np.ndarray
    chars: np.ndarray
    symbols: np.ndarray
    lines: np.ndarray
    repeated: np.ndarray
    probability: np.ndarray

    @property
    def failed(self) -> np.ndarray:
        return (self.words < LEAST_WORDS) | (100 * self.repeated > REPEATED_PERCENT * self.words)

    @property
    def kept(self) -> np.ndarray:
        return ~self.failed & (self.probability >= THRESHOLD)


def examine(column: pa.Array, model: Model) -> Scores:
    raw = at.as_bytes(column)
    data, offsets = at.buffer(raw)
    texts = raw.to_pylist()
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))

    def per_text(flag: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=flag, minlength=len(texts)).astype(np.int64)

    words = [t.split() for t in texts]
    return Scores(
        np.fromiter(map(len, words), np.int64, len(texts)), per_text(~at.WHITE[data] & at.starts_of_characters(data)), per_text(SYMBOL[data]),
        np.fromiter(map(repeated_lines, texts), np.int64, len(texts)), np.fromiter(map(repeats, words), np.int64, len(texts)), model.probability(data, offsets),
    )


def annotate(docs: DataFrame, model: Model, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    shared = ship(docs.sparkSession, model)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def score(part: pa.RecordBatch) -> list[pa.Array]:
        s = examine(part.column("text"), shared())
        return [pa.array(x) for x in (s.words, s.chars, s.symbols, s.lines, s.repeated, s.failed, s.kept, s.probability)]

    return tm.map_slices(source, RESULT.format(id=docs.schema[id_column].dataType.simpleString()), score, ["doc_id"])


def keep(docs: DataFrame, model: Model, *, text_column: str = "text") -> DataFrame:
    """The documents, all columns, that the rules keep."""
    shared = ship(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, text_column):
                yield part.filter(pa.array(examine(part.column(text_column), shared()).kept))

    return docs.mapInArrow(run, docs.schema)
