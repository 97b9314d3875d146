"""Language identification: family first, then one-versus-one SVMs within it.

Features are hashed words and character trigrams over letter runs, A-Z lower-cased.
One linear SVM per family tells it from the others (none if there is just
one); within the predicted family one linear SVM per pair of languages votes,
ties going to the larger sum of margins.  The score is the product of the
logistic transforms of the winning family margin and of the mean margin of the
winner's duels.

Every language of the labelled rows is learned, on at most ``PER_LANGUAGE`` rows
of it by a hash of the id.
Defined edge cases: null text, or one without a letter, is ``und`` with score
0; with no labelled rows every text is ``und``; with one language every text
with a letter gets it; a text whose letters are all unseen still gets the most
likely language by the biases; repeated rows are each returned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import textmodel as tm
from .session import ship

#: Rows per language of the training sample.
PER_LANGUAGE = 400

#: Language families by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "be", "bg", "pl", "cs", "sk", "sl", "hr", "sr", "mk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "mr", "ne", "bn", "gu", "pa"],
    "semitic": ["ar", "he", "mt"],
}
FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    languages: list[list[str]] = field(default_factory=list)  # of each family
    weights: np.ndarray = field(default_factory=lambda: np.zeros((tm.BUCKETS, 0), np.float32))
    biases: np.ndarray = field(default_factory=lambda: np.zeros(0))
    duels: list[list[tuple[int, int, int]]] = field(default_factory=list)  # (winner if > 0, winner if < 0, column)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        texts = at.as_bytes(column)
        data, offsets = at.buffer(texts)
        n = len(offsets) - 1
        rows, buckets = tm.hashed(data, offsets, tm.LETTERS, True)
        share = tm.scale(rows, buckets, n)
        margins = np.stack([np.bincount(rows, weights=self.weights[buckets, k] * share, minlength=n) + self.biases[k] for k in range(len(self.biases))], axis=1) if len(self.biases) else np.zeros((n, 0))
        ascii_letters = np.bincount(np.repeat(np.arange(n), np.diff(offsets)), weights=(tm.LETTERS[data] & (data < 0x80)), minlength=n)
        out, score = [], np.zeros(n)
        for i in range(n):
            if not self.families or (not ascii_letters[i] and not any(c.isalpha() for c in texts[i].as_py().decode("utf-8", "replace"))):
                out.append("und")
                continue
            f, sure = 0, 1.0
            if len(self.families) > 1:
                f = int(margins[i, : len(self.families)].argmax())
                sure = float(tm.sigmoid(3 * margins[i, f]))
            votes = np.zeros((len(self.languages[f]), 2))
            for a, b, k in self.duels[f]:
                m = margins[i, k]
                votes[a if m > 0 else b, 0] += 1
                votes[a, 1] += m
                votes[b, 1] -= m
            best = max(range(len(votes)), key=lambda j: (votes[j, 0], votes[j, 1], -j))
            if len(votes) > 1:
                sure *= float(tm.sigmoid(3 * votes[best, 1] / (len(votes) - 1)))
            out.append(self.languages[f][best])
            score[i] = sure
        return out, score


def fit(examples: list[tuple[str, str]], steps: int = 40) -> Model:
    """examples: (language, text)."""
    if not examples:
        return Model()
    known = sorted({lang for lang, _ in examples})
    families = sorted({FAMILY_OF.get(lang, lang) for lang in known})
    languages = [[lang for lang in known if FAMILY_OF.get(lang, lang) == f] for f in families]
    x = tm.Examples([t for _, t in examples], tm.LETTERS, True)
    of = np.array([lang for lang, _ in examples])
    family = np.array([FAMILY_OF.get(lang, lang) for lang in of])
    columns: list[tuple[np.ndarray, float]] = []

    def learn(y: np.ndarray, use: np.ndarray | None = None) -> None:
        w, b = tm.fit_linear(x, y, tm.hinge_slope, use=use, steps=steps)
        columns.append((w.astype(np.float32), b))

    duels: list[list[tuple[int, int, int]]] = []
    if len(families) > 1:
        for f in families:
            learn(np.where(family == f, 1, -1))
    for some in languages:
        duels.append([])
        for a in range(len(some)):
            for b in range(a + 1, len(some)):
                duels[-1].append((a, b, len(columns)))
                use = (of == some[a]) | (of == some[b])
                learn(np.where(of == some[a], 1, -1), use)
    weights = np.stack([w for w, _ in columns], axis=1) if columns else np.zeros((tm.BUCKETS, 0), np.float32)
    return Model(families, languages, weights, np.array([b for _, b in columns]), duels)


def train(docs: DataFrame, *, held_out: tuple[int, int] = (3, 1), id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Model:
    """Fit on rows with a language whose id is outside the held-out fold."""
    labelled = docs.select(F.col(id_column).alias("id"), F.col(lang_column).alias("class")).filter(F.col("class").isNotNull())
    labelled = labelled.filter(tm.fold("id", held_out[0]) != held_out[1])
    rows = tm.sample(docs, labelled, PER_LANGUAGE, id_column, text_column)
    return fit([(lang, text) for _, lang, text in rows])


def annotate(docs: DataFrame, model: Model, *, held_out: tuple[int, int] = (3, 1), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    shared = ship(docs.sparkSession, model)
    source = docs.select(F.col(id_column).alias("doc_id"), (tm.fold(id_column, held_out[0]) == held_out[1]).alias("held_out"), F.col(text_column).alias("text"))

    def score(part: pa.RecordBatch) -> list[pa.Array]:
        langs, sure = shared().predict(part.column("text"))
        return [pa.array(langs, pa.string()), pa.array(sure)]

    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return tm.map_slices(source, schema, score, ["doc_id", "held_out"])
