"""Benchmark decontamination by suffix arrays over shards of the documents.

Each Arrow batch of documents is a shard.  Its words become ids of the test
vocabulary; stretches of words whose neighbouring pairs all occur in the test
set are the only places where a test passage can stand, so the shard's suffix
array is sparse: it sorts the suffixes that begin in such stretches.  Every
test suffix is then binary-searched in it, all at once.  The matches give, per
document, the words that stand in an occurring window, the items these belong
to, and the longest verbatim match with its place.

A window is ``window`` consecutive words of an item; an item of fewer words,
but not none, is one window.  Words are compared by 64-bit hashes, so a false
hit needs as many collisions in a row as the window has words: one for an item
of one word.

The test set is shipped in blocks of at most ``block_bytes`` of text.  One
block is one pass over the documents.  More blocks are a pass each, built and
written one after another, and their hits meet by (doc_id, text digest), which
no hot key can swell.

The longest verbatim match is the longest stretch of whole windows on one
diagonal of a document and an item, so of at least ``window`` words (or a whole
shorter item); the earliest of equals.  Its place is the number of words before
it; without a match these are 0 and -1.

Defined edge cases: a null text has no words and is clean; a null item text
has no windows; a null item_id counts as the id ''; items of one id are one
item; repeated rows are each returned; input columns other than the named
ones are ignored by ``annotate`` and kept by ``remove``; an empty test set
leaves every document clean.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .session import settle, ship

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER_ASCII = {c: c + 32 for c in range(0x41, 0x5B)}

MEMBER = np.zeros(256, bool)
MEMBER[0x30:0x3A] = MEMBER[0x61:0x7B] = MEMBER[0x80:] = True

VALUES = at.byte_values(2)

#: Tokens of one suffix array, and rows of (match, place) held at once.
SHARD_TOKENS = 1 << 20
MATCHES = 1 << 21

RESULT = (
    "doc_id {id}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, longest_start long"
)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER_ASCII))


@dataclass
class TestSet:
    """One block of items, ready for the search of a shard."""

    vocabulary: np.ndarray  # sorted word hashes
    ids: np.ndarray  # the id, from 1, of each
    pairs: np.ndarray  # sorted keys of neighbouring ids
    suffixes: np.ndarray  # ids of each test suffix, cut to the window
    widths: np.ndarray  # words to match of each suffix
    places: np.ndarray  # position of each suffix among all words of the items
    item: np.ndarray  # passage number of each suffix
    names: list[list[str]]  # the item_ids of each passage
    least: int  # words of the shortest window


def index_items(items: list[tuple[object, str | None]], window: int) -> TestSet | None:
    passages: dict[tuple[str, ...], set[str]] = {}
    for name, text in items:
        if words := tuple(words_of(text)):
            passages.setdefault(words, set()).add("" if name is None else str(name))
    if not passages:
        return None
    known = sorted({w for p in passages for w in p})
    number = {w: i + 1 for i, w in enumerate(known)}
    data, offsets = at.buffer(pa.array([w.encode("utf-8", "surrogatepass") for w in known], pa.binary()))
    hashes = at.Hasher(data, VALUES).spans(offsets[:-1], offsets[1:])
    order = np.argsort(hashes)
    pairs, suffixes, widths, places, item, base = set(), [], [], [], [], 0
    for k, words in enumerate(passages):
        ids = [number[w] for w in words]
        pairs.update(a * (len(known) + 1) + b for a, b in zip(ids, ids[1:], strict=False))
        width = min(window, len(ids))
        for i in range(len(ids) - width + 1):
            suffixes.append(ids[i : i + width] + [0] * (window - width))
            widths.append(width)
            places.append(base + i)
            item.append(k)
        base += len(ids) + 1
    return TestSet(
        hashes[order], (order + 1).astype(np.int32), np.array(sorted(pairs), np.int64), np.array(suffixes, np.int32),
        np.array(widths, np.int64), np.array(places, np.int64), np.array(item, np.int64), [sorted(x) for x in passages.values()], min(widths),
    )


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Places of the suffixes in the order of their first ``depth`` tokens, by prefix doubling."""
    n, rank, k = len(tokens), tokens.astype(np.int64), 1
    while True:
        ahead = np.zeros(n, np.int64)
        if k < min(depth, n):
            ahead[: n - k] = rank[k:]
        key = rank * (int(rank.max(initial=0)) + 1) + ahead
        order = np.argsort(key, kind="stable")
        if k >= depth:
            return order
        key = key[order]
        fresh = np.ones(n, np.int64)
        fresh[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        k *= 2


def search(tokens: np.ndarray, order: np.ndarray, tests: TestSet) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all test suffixes at once: the first and one past the last place in ``order``."""
    window = tests.suffixes.shape[1]
    padded = np.concatenate([tokens, np.zeros(window, tokens.dtype)])
    wanted = np.arange(window) < tests.widths[:, None]

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(tests.widths), np.int64), np.full(len(tests.widths), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            found = padded[order[middle][:, None] + np.arange(window)]
            differs = (found != tests.suffixes[open_]) & wanted[open_]
            first = differs.argmax(axis=1)
            rows = np.arange(len(open_))
            sign = np.where(differs[rows, first], np.sign(found[rows, first].astype(np.int64) - tests.suffixes[open_][rows, first]), 0)
            right = (sign <= 0) if after else (sign < 0)
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
        return low

    return bound(False), bound(True)


class Shard:
    """The stretches of a batch of documents that can hold a test passage."""

    def __init__(self, tests: TestSet | None, rows: int) -> None:
        self.tests, self.words = tests, np.zeros(rows, np.int64)
        self.hit, self.items = np.zeros(rows, np.int64), [set() for _ in range(rows)]
        self.longest, self.where = np.zeros(rows, np.int64), np.full(rows, -1, np.int64)
        self.spans: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, column: pa.Array, base: int) -> None:
        data, offsets = at.buffer(column)
        data = at.LOWER[data]
        spans = at.Spans(data, offsets, MEMBER)
        counts = spans.counts()
        self.words[base : base + len(counts)] = counts
        tests = self.tests
        if tests is None or not len(spans):
            return
        hashes = at.Hasher(data, VALUES).spans(spans.start, spans.end)
        slot = np.minimum(np.searchsorted(tests.vocabulary, hashes), len(tests.vocabulary) - 1)
        ids = np.where(tests.vocabulary[slot] == hashes, tests.ids[slot], 0)
        linked = np.zeros(len(ids), bool)  # with the word before
        if len(tests.pairs):
            near = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0) & (spans.row[:-1] == spans.row[1:]))
            key = ids[near].astype(np.int64) * (len(tests.vocabulary) + 1) + ids[near + 1]
            slot = np.minimum(np.searchsorted(tests.pairs, key), len(tests.pairs) - 1)
            linked[near[tests.pairs[slot] == key] + 1] = True
        first = np.flatnonzero(~linked)
        length = np.diff(np.append(first, len(ids)))
        good = (length >= tests.least) & (ids[first] > 0)
        first, length = first[good], length[good]
        if not len(first):
            return
        step = np.arange(int(length.sum() + len(length)))  # a 0 after each stretch
        of = np.repeat(np.arange(len(first)), length + 1)
        within = step - np.repeat(np.cumsum(length + 1) - (length + 1), length + 1)
        place = np.minimum(first[of] + within, len(ids) - 1)
        tokens = np.where(within < length[of], ids[place], 0).astype(np.int32)
        word = place - (np.cumsum(counts) - counts)[spans.row[place]]
        self.parts.append((tokens, spans.row[first][of] + base, word))
        self.held += len(tokens)
        if self.held >= SHARD_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.parts:
            return
        tokens, row, word = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        tests, n = self.tests, len(tokens)
        order = suffix_array(tokens, tests.suffixes.shape[1])
        low, high = search(tokens, order, tests)
        count = high - low
        cover = np.zeros(n + 1, np.int64)
        found = np.flatnonzero(count)
        share = np.cumsum(count[found]) // MATCHES  # groups of a bounded number of matches
        diagonals: list[np.ndarray] = []
        for k in np.unique(share):
            some = found[share == k]
            query = np.repeat(some, count[some])
            nth = np.arange(len(query)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            place = order[low[query] + nth]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + tests.widths[query], -1)
            passage = np.unique(row[place] * len(tests.names) + tests.item[query])
            for r, p in zip((passage // len(tests.names)).tolist(), (passage % len(tests.names)).tolist(), strict=True):
                self.items[r].add(p)
            diagonals.append(np.stack([place - tests.places[query], place, tests.widths[query]]))
        if not diagonals:
            return
        hit = np.cumsum(cover[:-1]) > 0
        np.add.at(self.hit, row[hit], 1)
        edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True):
            self.spans[row[a]].append((int(word[a]), int(word[b]) + 1))
        diagonal, place, width = np.concatenate(diagonals, axis=1)
        by = np.lexsort((place, diagonal))
        diagonal, place, width = diagonal[by], place[by], width[by]
        begin = np.ones(len(place), bool)
        begin[1:] = (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)
        at_ = np.flatnonzero(begin)
        length = np.diff(np.append(at_, len(place))) - 1 + width[at_]
        where = place[at_]
        for i in np.lexsort((word[where], -length)).tolist():  # the longest first, the earliest of equals
            r = int(row[where[i]])
            if length[i] > self.longest[r]:
                self.longest[r], self.where[r] = length[i], word[where[i]]

    def names(self, row: int) -> list[str]:
        return sorted({n for p in self.items[row] for n in self.tests.names[p]}) if self.items[row] else []


def examine(batch: pa.RecordBatch, column: str, tests: TestSet | None) -> Shard:
    shard, base = Shard(tests, batch.num_rows), 0
    for part in at.slices(batch, column):
        shard.add(part.column(column), base)
        base += part.num_rows
    shard.flush()
    return shard


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(names).encode("utf-8", "surrogatepass")).hexdigest()


def _blocks(benchmark: DataFrame, block_bytes: int, id_column: str, text_column: str) -> Iterator[list[tuple[object, str | None]]]:
    """Rows of the test set, never more than a block of them on the driver."""
    rows, held = [], 0
    for row in benchmark.select(id_column, text_column).toLocalIterator():
        rows.append((row[0], row[1]))
        held += len(row[1] or "") + 16
        if held >= block_bytes:
            yield rows
            rows, held = [], 0
    if rows:
        yield rows


def _id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def annotate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 8 << 20, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """One row per document: its words, hits, items and longest verbatim match."""
    blocks = _blocks(benchmark, block_bytes, item_column, text_column)
    first, second = next(blocks, []), next(blocks, None)
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    schema = RESULT.format(id=_id_type(docs, id_column))
    if second is not None:
        return _annotate_in_blocks(source, (index_items(rows, window) for rows in chain([first, second], blocks)), schema)
    tests = ship(docs.sparkSession, index_items(first, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = digest([])
        for batch in batches:
            s = examine(batch, "text", tests())
            names = {r: s.names(r) for r in np.flatnonzero(s.hit).tolist()}
            columns = [
                batch.column("doc_id"), pa.array(s.words), pa.array(s.hit), pa.array([len(names.get(r, ())) for r in range(batch.num_rows)], pa.int64()),
                pa.array([digest(names[r]) if r in names else empty for r in range(batch.num_rows)], pa.string()),
                pa.array(s.hit > 0), pa.array(s.longest), pa.array(s.where),
            ]
            yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in schema.split(", ")])

    return source.mapInArrow(run, schema)


def _annotate_in_blocks(source: DataFrame, blocks: Iterator[TestSet | None], schema: str) -> DataFrame:
    """A pass per block, one block held at a time; spans and items of a text meet by (doc_id, digest)."""
    named = source.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    id_type = schema.split(" ", 2)[1].rstrip(",")

    def scan(block: TestSet | None) -> DataFrame:
        tests = ship(source.sparkSession, block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = examine(batch, "text", tests())
                keep = np.flatnonzero(s.hit)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(keep)), batch.column("digest").take(pa.array(keep)),
                        pa.array([[x for span in s.spans[r] for x in span] for r in keep], pa.list_(pa.int64())),
                        pa.array([s.names(r) for r in keep], pa.list_(pa.string())), pa.array(s.longest[keep]), pa.array(s.where[keep]),
                    ],
                    ["doc_id", "digest", "spans", "items", "longest", "start"],
                )

        return settle(named.mapInArrow(run, f"doc_id {id_type}, digest string, spans array<long>, items array<string>, longest long, start long"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = examine(batch, "text", None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(s.words)], ["doc_id", "digest", "n_words"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, names = [], []
            for spans in batch.column("spans").to_pylist():
                total, reach = 0, -1
                for a, b in sorted((x[i], x[i + 1]) for x in spans or [] for i in range(0, len(x), 2)):
                    total += max(0, b - max(a, reach))
                    reach = max(reach, b)
                hits.append(total)
            for items in batch.column("items").to_pylist():
                names.append(sorted({n for x in items or [] for n in x}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), pa.array([len(x) for x in names], pa.int64()),
                    pa.array([digest(x) for x in names], pa.string()), pa.array([h > 0 for h in hits], pa.bool_()), batch.column("longest"), batch.column("start"),
                ],
                [x.split(" ")[0] for x in schema.split(", ")],
            )

    parts = None
    for block in blocks:
        parts = scan(block) if parts is None else parts.unionByName(scan(block))
    best = F.max_by(F.struct("longest", "start"), F.struct("longest", -F.col("start")))
    met = parts.groupBy("doc_id", "digest").agg(F.collect_set("spans").alias("spans"), F.collect_set("items").alias("items"), best.alias("best"))
    met = met.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "spans", "items", "best")
    rows = named.mapInArrow(count, f"doc_id {id_type}, digest string, n_words long")
    rows = rows.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    rows = rows.select("doc_id", "n_words", "spans", "items", F.coalesce("best.longest", F.lit(0)).alias("longest"), F.coalesce("best.start", F.lit(-1)).alias("start"))
    return rows.mapInArrow(join, schema)


def remove(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, block_bytes: int = 8 << 20, text_column: str = "text", item_column: str = "item_id") -> DataFrame:
    """The documents, all columns, that hold no window of the test set.

    A document is clean if it is clean of every block, so blocks filter one
    after another and no join is needed.
    """
    for rows in _blocks(benchmark, block_bytes, item_column, text_column):
        tests = ship(docs.sparkSession, index_items(rows, window))

        def run(batches: Iterator[pa.RecordBatch], tests=tests) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(examine(batch, text_column, tests()).hit == 0))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
