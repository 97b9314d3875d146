"""Pieces that the trained text models share: samples, hashed features, linear fits."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at

#: Buckets of hashed words and of hashed character trigrams; trigrams follow the words.
GRAM_BITS = 17
WORDS, GRAMS = 1 << 17, 1 << GRAM_BITS
BUCKETS = WORDS + GRAMS
#: Odd multiplier of the trigram hash.
MIDDLE = np.uint64(0xC2B2AE3D27D4EB4F)

#: Longest text, in bytes, of a training sample; scoring has no such bound.
SAMPLE_TEXT = 1 << 16
SPARE = 4

VALUES = at.byte_values(8)
LETTERS = np.zeros(256, bool)
LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def fold(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids are the empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % parts


def sample(docs: DataFrame, classes: DataFrame, per_class: int, id_column: str = "doc_id", text_column: str = "text") -> list[tuple]:
    """(id, class, text) of at most ``per_class`` labelled rows of each class, by a hash of the id.

    classes: (id, class).  Classes are counted; then only ids whose hash is below
    a threshold that lets about ``SPARE`` times as many through, and at least
    one, go to the driver, which takes the first of each class.  So no class is
    ranked in one task, and only the ids taken meet the documents.  An id with
    several labels is an example of each; of several texts of an id the least
    is taken.
    """
    classes = classes.filter(F.col("id").isNotNull()).select("id", "class", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("hash"))
    bound = F.when(F.lit(False), 0)
    for r in classes.groupBy("class").agg(F.count("*").alias("n"), F.min("hash").alias("least")).collect():
        bound = bound.when(F.col("class") == r["class"], max(r["least"] + 1, min(1 << 30, (SPARE * per_class << 30) // r["n"])))
    first: dict[object, list] = {}
    for r in sorted(classes.filter(F.col("hash") < bound.otherwise(0)).distinct().collect(), key=lambda r: (r["hash"], str(r["id"]))):
        first.setdefault(r["class"], []).append((r["id"], r["class"]))
    chosen = [x for some in first.values() for x in some[:per_class]]
    chosen = docs.sparkSession.createDataFrame(chosen, classes.select("id", "class").schema)
    texts = docs.select(F.col(id_column).alias("key"), F.col(text_column).alias("body")).filter(F.octet_length("body") <= SAMPLE_TEXT)
    rows = texts.join(F.broadcast(chosen), F.col("key") == F.col("id")).groupBy("id", "class").agg(F.min("body").alias("body")).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[0]), str(r[1])))


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each code point as one number, and where each begins."""
    first = at.starts_of_characters(data)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    place = np.flatnonzero(first)
    size = np.diff(np.append(place, len(data)))
    value = data[place].astype(np.uint64)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        value[more] |= data[place[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return value, place


def hashed(data: np.ndarray, offsets: np.ndarray, member: np.ndarray | None, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and of every character trigram of the texts.

    Words are runs of ``member`` bytes (None: of other bytes than white space);
    trigrams run over the code points, one outside words counting as a blank.
    """
    if lower:
        data = at.LOWER[data]
    inside = ~at.WHITE if member is None else member
    spans = at.Spans(data, offsets, inside)
    words = (at.Hasher(data, VALUES).spans(spans.start, spans.end) & np.uint64(WORDS - 1)).astype(np.int64)
    rows, buckets = [spans.row], [words]
    value, place = characters(data, offsets)
    if len(value) > 2:
        value = np.where(inside[data[place]], value, np.uint64(0x20))
        gram = (value[:-2] * np.uint64(at.BASE) + value[1:-1] * MIDDLE + value[2:]) * MIDDLE >> np.uint64(64 - GRAM_BITS)
        row = np.searchsorted(offsets, place, "right") - 1
        good = row[:-2] == row[2:]
        rows.append(row[:-2][good])
        buckets.append(WORDS + gram[good].astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def scale(rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
    """Weight of each feature occurrence: words and trigrams each sum to 1 in a text."""
    gram = (buckets >= WORDS).astype(np.int64)
    total = np.bincount(2 * rows + gram, minlength=2 * n)
    return 1.0 / total[2 * rows + gram]


class Examples:
    """Texts as a sparse matrix of hashed features."""

    def __init__(self, texts: list[str], member: np.ndarray | None, lower: bool) -> None:
        rows, buckets, weights, base = [], [], [], 0
        for i in range(0, len(texts), 128):
            part = texts[i : i + 128]
            data, offsets = at.buffer(pa.array(part, pa.large_string()))
            r, b = hashed(data, offsets, member, lower)
            key, count = np.unique(r * BUCKETS + b, return_counts=True)
            r, b = key // BUCKETS, key % BUCKETS
            gram = (b >= WORDS).astype(np.int64)
            total = np.bincount(2 * r + gram, weights=count, minlength=2 * len(part))
            rows.append((r + base).astype(np.int32))
            buckets.append(b.astype(np.int32))
            weights.append((count / total[2 * r + gram]).astype(np.float32))
            base += len(part)
        self.n = base
        self.row = np.concatenate([np.zeros(0, np.int32), *rows])
        self.bucket = np.concatenate([np.zeros(0, np.int32), *buckets])
        self.weight = np.concatenate([np.zeros(0, np.float32), *weights])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.bucket] * self.weight, minlength=self.n)

    def gradient(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.bucket, weights=g[self.row] * self.weight, minlength=BUCKETS)


def fit_linear(x: Examples, y: np.ndarray, slope: Callable[[np.ndarray, np.ndarray], np.ndarray], *, use: np.ndarray | None = None, steps: int = 60, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam; y is +1 or -1, classes weigh the same.

    slope(margins, y) is the loss derivative by margin, per example.
    """
    use = np.ones(x.n, bool) if use is None else use
    balance = np.where(y > 0, 0.5 / max(1, (use & (y > 0)).sum()), 0.5 / max(1, (use & (y < 0)).sum())) * use
    w, bias, m, v, mb, vb = np.zeros(BUCKETS), 0.0, np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, steps + 1):
        g = slope(x.dot(w) + bias, y) * balance
        gw, gb = x.gradient(g) + 1e-7 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= rate * fix * m / (np.sqrt(v) + 1e-9)
        bias -= 0.1 * rate * fix * mb / (np.sqrt(vb) + 1e-9)
    return w, float(bias)


def logistic_slope(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    return -y / (1 + np.exp(np.clip(y * margin, -50, 50)))


def hinge_slope(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared hinge, of a linear support vector machine."""
    return -2 * y * np.maximum(0, 1 - y * margin)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 300) -> tuple[float, float]:
    """Scale and shift of margins that give calibrated probabilities of y = +1 (smoothed targets)."""
    up, down = (y > 0).sum(), (y < 0).sum()
    if not up or not down:
        return 1.0, 0.0
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    spread = margin.std() or 1.0
    centre, a, b = margin.mean(), 1.0, 0.0
    z = (margin - centre) / spread
    for _ in range(steps):  # Newton steps with a small ridge
        p = sigmoid(a * z + b)
        g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a / spread), float(b - a * centre / spread)


def map_slices(source: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str]) -> DataFrame:
    """mapInArrow over bounded slices; fn gives the columns of ``schema`` after the kept ones."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), *fn(part)], names)

    return source.mapInArrow(run, schema)
