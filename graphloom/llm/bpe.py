"""Byte-level BPE encoding and decoding with segment trees.

A text is split by the pattern; each piece is a row of byte symbols.  Leaf i of
the piece's segment tree holds the rank of the pair that begins at byte i (its
symbol and its next live neighbour's), or none; an inner node the leftmost
minimum of its leaves, kept as ``rank * width + position``.  The root names the
next merge; a merge touches three leaves (the pair's two and the live neighbour
before), each a logarithmic point update.  Short pieces run in lockstep, one
numpy tree per row; long ones one at a time.

Results of short pieces are kept in a bounded cache.  Defined edge cases: a
null text is empty and has no tokens; bytes that are not UTF-8 are read as
U+FFFD; repeated rows are each returned; other input columns are ignored by
``annotate``.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrowtext as at

#: Longest piece, in bytes, that runs in lockstep; cached pieces at most.
SHORT = 64
CACHED = 300_000

NONE = np.iinfo(np.int64).max
RESULT = "doc_id {id}, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_ranks(spark: SparkSession, path: str) -> bytes:
    """The rank file's content, read by the driver; it is small (under 2 MB)."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


#: The pattern that the array splitter below implements, and its contractions.
WORDS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
LETTER, NUMBER, OTHER, SPACE = range(4)


def code_point_classes() -> np.ndarray:
    """The class of each code point, as the tiktoken library's own patterns see it.

    Libraries follow different versions of Unicode; asking this one makes the
    pieces the same.  Its encoder drops what a pattern doesn't match, so with
    single bytes for tokens it returns the members of a class.
    """
    import tiktoken

    points = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    table = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for kind, member in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        encoder = tiktoken.Encoding("class", pat_str=member, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(encoder.encode_ordinary(points)).decode("utf-8")
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = kind
    return table


class Splitter:
    """Pieces of texts by WORDS_PATTERN, found on whole arrays of code points.

    A run of one class is a piece; a space before a run of another class than
    white space joins it; white space before such a run gives up its last
    character; an apostrophe alone, without a space before it, takes a
    contraction's letters.
    """

    def __init__(self, classes: np.ndarray) -> None:
        self.table = classes

    def __call__(self, texts: list[str]) -> list[list[str]]:
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if not n:
            return [[] for _ in texts]
        kind = np.append(self.table[points], 255)
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[0] = edge[ends] = True
        begin = edge.copy()
        begin[1:] |= kind[1:] != kind[:-1]
        start = begin.copy()
        first = np.flatnonzero(begin[:-1])
        after = np.append(first[1:], n)
        space = kind[first] == SPACE
        tail = after[space & ~edge[after]] - 1  # last of white space that a run follows
        start[tail] = True
        start[tail[points[tail] == 0x20] + 1] = False
        quote = first[(points[first] == 0x27) & (after - first == 1) & start[first] & ~edge[after]]
        padded = np.append(points, np.zeros(3, np.uint32))
        for q in quote[kind[quote + 1] == LETTER].tolist():
            two = "".join(map(chr, padded[q + 1 : q + 3].tolist()))
            short = next((c for c in CONTRACTIONS if two.startswith(c) and not edge[q + 2 : q + 1 + len(c)].any()), None)
            if short:
                start[q + 1] = False
                start[q + 1 + len(short)] = True
        at_ = np.flatnonzero(start[:-1])
        to = np.searchsorted(at_, ends).tolist()
        cuts = at_.tolist()
        pieces = [joined[a:b] for a, b in zip(cuts, [*cuts[1:], n], strict=True)]
        return [pieces[a:b] for a, b in zip([0, *to], to, strict=False)]


class PairTable:
    """Open-addressing hash table from pair keys to merged ids, probed by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(at.BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            found = held == keys[open_]
            out[open_[found]] = self.values[slot[open_[found]]]
            open_ = open_[~found & (held != -1)]
        return out


class Bpe:
    """Encoder and decoder over the content of a rank file."""

    def __init__(self, ranks: bytes, pattern: str, classes: np.ndarray) -> None:
        pairs = [line.split() for line in ranks.splitlines() if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        find = regex.compile(pattern).findall
        self.split = Splitter(classes) if pattern == WORDS_PATTERN else lambda texts: [find(t) for t in texts]
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.wide = max(self.rank.values()) + 1
        by_id = [b""] * self.wide
        for token, i in self.rank.items():
            by_id[i] = token
        self.token_length = np.fromiter(map(len, by_id), np.int64, self.wide)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(by_id), np.uint8)
        merges = {}
        for token, merged in self.rank.items():
            for i in range(1, len(token)):
                a, b = self.rank.get(token[:i]), self.rank.get(token[i:])
                if a is not None and b is not None:
                    merges[a * self.wide + b] = merged
        self.merges = merges
        self.table = PairTable(np.fromiter(merges, np.int64, len(merges)), np.fromiter(merges.values(), np.int64, len(merges)))
        self.cache: dict[str, bytes] = {}

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where there is none; a right of -1 is no symbol."""
        out = self.table.get(left * self.wide + right)
        out[(right < 0) | (left < 0)] = NONE
        return out

    def lockstep(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most ``width`` bytes, a power of two, as little-endian words."""
        n, rows = len(pieces), np.arange(len(pieces))
        text = np.zeros((n, width), np.uint8)
        length = np.fromiter(map(len, pieces), np.int64, n)
        text[np.arange(width) < length[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        symbol = np.full((n, width + 1), -1, np.int64)  # column width: beyond the end
        symbol[:, :width] = np.where(np.arange(width) < length[:, None], self.byte[text], -1)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        after[:, -1] = width
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), NONE)
        first = self._pair_ranks(symbol[:, :-1].ravel(), symbol[:, 1:].ravel()).reshape(n, width)
        tree[:, width:] = np.where(first == NONE, NONE, first * width + np.arange(width))
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])

        def put(live: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            node = place + width
            tree[live, node] = value
            while (node := node >> 1)[0]:
                tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])

        def rescore(live: np.ndarray, place: np.ndarray) -> None:
            found = self._pair_ranks(symbol[live, place], symbol[live, after[live, place]])
            put(live, place, np.where(found == NONE, NONE, found * width + place))

        while True:
            live = rows[tree[:, 1] != NONE]
            if not len(live):
                break
            best = tree[live, 1]
            place, merged = best % width, best // width
            gone = after[live, place]
            then = after[live, gone]
            symbol[live, place], symbol[live, gone] = merged, -1
            after[live, place], before[live, then] = then, place
            put(live, gone, np.full(len(live), NONE))
            rescore(live, place)
            some = before[live, place] >= 0
            if some.any():
                rescore(live[some], before[live[some], place[some]])
        kept = symbol[:, :width] >= 0
        packed, ends = symbol[:, :width][kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def one(self, piece: bytes) -> bytes:
        """Ids of one long piece."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        symbol = [*self.byte[np.frombuffer(piece, np.uint8)].tolist(), -1]
        after, before = [*range(1, n + 1), n], list(range(-1, n))
        none, merges, wide = (1 << 62), self.merges, self.wide
        tree = [none] * (2 * width)
        for i in range(n - 1):
            found = merges.get(symbol[i] * wide + symbol[i + 1])
            if found is not None:
                tree[width + i] = found * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(place: int, value: int) -> None:
            node = place + width
            tree[node] = value
            while node > 1:
                value = tree[node ^ 1] if tree[node ^ 1] < value else value
                node >>= 1
                if tree[node] == value:
                    break
                tree[node] = value

        def rescore(place: int) -> None:
            right = symbol[after[place]]
            found = merges.get(symbol[place] * wide + right) if right >= 0 else None
            put(place, none if found is None else found * width + place)

        while (best := tree[1]) != none:
            place = best % width
            gone = after[place]
            then = after[gone]
            symbol[place], symbol[gone] = best // width, -1
            after[place], before[then] = then, place
            put(gone, none)
            rescore(place)
            if before[place] >= 0:
                rescore(before[place])
        return np.array([s for s in symbol if s >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of new pieces; the short ones go to the cache."""
        long_: dict[str, bytes] = {}
        waiting: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode("utf-8", "surrogatepass")
            if (whole := self.rank.get(raw)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                long_[piece] = self.one(raw)
            else:
                waiting.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((piece, raw))
        for width, some in waiting.items():
            for i in range(0, len(some), 1 << 13):
                part = some[i : i + (1 << 13)]
                self.cache.update(zip((p for p, _ in part), self.lockstep([r for _, r in part], width), strict=True))
        return long_

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit words."""
        pieces = self.split(texts)
        new = set().union(*pieces).difference(self.cache)
        if len(self.cache) + len(new) > CACHED:
            self.cache.clear()
            new = set().union(*pieces)
        long_ = self.learn(new)
        get = (lambda p: self.cache.get(p) or long_[p]) if long_ else self.cache.__getitem__
        return [b"".join(map(get, some)) for some in pieces]

    def decode(self, ids: bytes) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        lengths = self.token_length[ids]
        ends = np.cumsum(lengths)
        shift = np.repeat(self.token_start[ids] - (ends - lengths), lengths)
        return self.token_bytes[shift + np.arange(len(shift))].tobytes()


def annotate(docs: DataFrame, ranks: bytes, pattern: str, *, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """One row per document: token count, digest of the ids and of the decoded bytes.

    With ``ids``, the ids themselves too, as ``token_ids array<int>``.
    """
    content = docs.sparkSession.sparkContext.broadcast((ranks, code_point_classes()))  # 2 MB
    schema = RESULT.format(id=docs.schema[id_column].dataType.simpleString()) + (", token_ids array<int>" if ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(content.value[0], pattern, content.value[1])
        for batch in batches:
            for part in at.slices(batch, "text"):
                codes = bpe.encode([t.decode("utf-8", "replace") for t in at.as_bytes(part.column("text")).to_pylist()])
                columns = [
                    part.column("doc_id"), pa.array([len(c) // 4 for c in codes], pa.int64()), pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
                    pa.array([hashlib.sha256(bpe.decode(c)).hexdigest() for c in codes], pa.string()),
                ]
                if ids:
                    columns.append(pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in codes], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, [x.split(" ")[0] for x in schema.split(", ")])

    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, schema)
