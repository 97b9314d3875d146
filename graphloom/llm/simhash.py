"""SimHash near-duplicates by covering locality-sensitive hashing.

Words are runs of non-blank characters of the text with A-Z lower-cased; every
four consecutive words, joined by spaces, are a shingle, repeats included; a
shorter text is one shingle, a text without words has fingerprint zero.  Bit k
of the 64-bit fingerprint is set if more than half of the shingles' XXH64
(seed 42) have it set.

Links are pairs of fingerprints at ``radius`` or fewer differing bits.  The
covering family has ``2**(radius + 1) - 1`` tables: every bit position gets a
nonzero label of radius + 1 bits, and table v keeps the positions whose label
has odd parity with v.  The labels of the differing bits of a pair span
at most ``radius`` dimensions, so some v is orthogonal to all of them and the
pair agrees on everything that table v keeps: no link can be missed.  Buckets
hold distinct fingerprints only, so copies never multiply.  A bucket of a few
yields its exact links, once in all tables; a larger one a spanning forest of
them, found by breadth-first search that drops what it has reached.  One of
more than ``MOST`` is split: the bits it leaves free are cut into radius + 1
segments, every link agrees on one of them, so its rows are dealt again by
bucket and segment; as often as needed, until so few bits are free that no
bucket can hold more.  So no bucket is one task, and none costs more than
``MOST`` squared.  Components of at most ``LOCAL`` links are found on the driver,
which gets the links and broadcasts their nodes; of more, by alternating
large-star and small-star rounds on Spark, where nodes of very many edges meet
these by broadcast.  Of at most ``LOCAL`` documents all tables but the first go
by the driver, so that they aren't dealt out over many small files; a table that
turns out larger is stored.

Defined edge cases: null text is empty; texts without words link with each
other like any other equal fingerprints; a null doc_id never names a component
unless the component has no other id; repeated rows are each returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at
from .session import fresh, settle

SHINGLE, RADIUS, SEED = 4, 4, 42

#: Fingerprints of a bucket whose links are listed pair by pair.
FEW = 32
#: Fingerprints of a bucket beyond which it is split.
MOST = 1 << 14
#: Rows held at once when buckets are read.
HELD = 1 << 17
#: Rows up to which a table goes by the driver, and links up to which components are found there: 2 MB of them, and twice as many nodes at most.
LOCAL = 1 << 17
#: Edges of a node from which it may count as a hub.
HUB = 1 << 16
#: Rows from which a fingerprint may count as hot.
HOT = 200


def shingle_hashes(data: bytes, size: int) -> list[int]:
    words = data.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - size + 1)
    ends = ends[size - 1 :] if len(words) >= size else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)]


def fingerprints(texts: list[bytes], size: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for i, text in enumerate(texts):
        if hashes := shingle_hashes(text, size):
            total = np.zeros(64, np.int64)
            for k in range(0, len(hashes), 1 << 16):
                part = np.array(hashes[k : k + (1 << 16)], np.uint64)
                total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = powers[2 * total > len(hashes)].sum(dtype=np.uint64)
    return out


def fingerprint(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, "text"):
                marks = fingerprints(at.as_bytes(part.column("text")).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "mark"])

    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return source.mapInArrow(run, f"doc_id {docs.schema[id_column].dataType.simpleString()}, mark long")


def masks(radius: int) -> list[int]:
    """The covering family: 64-bit masks, as signed longs."""
    dims = radius + 1
    labels = [i % (1 << dims) if i % (1 << dims) else (i // (1 << dims)) * 5 % ((1 << dims) - 1) + 1 for i in range(64)]
    out = []
    for v in range(1, 1 << dims):
        m = sum(1 << i for i, label in enumerate(labels) if bin(label & v).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def bucket_links(table: np.ndarray, key: np.ndarray, mark: np.ndarray, radius: int, family: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole buckets, rows sorted by (table, key)."""
    fresh = np.ones(len(mark), bool)
    fresh[1:] = (table[1:] != table[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(mark)))
    own = np.repeat(size, size)
    rest = np.repeat(first + size, size) - np.arange(len(mark))  # rows from here to the bucket's end
    left, right = [], []
    for shift in range(1, min(FEW, int(size.max(initial=1)))):
        a = np.flatnonzero((own <= FEW) & (rest > shift))
        differ = mark[a] ^ mark[a + shift]
        a, differ = a[ok := np.bitwise_count(differ) <= radius], differ[ok]
        again = np.zeros(len(a), bool)  # an earlier table has the pair
        for t in range(len(family) - 1):
            again |= (t < table[a]) & ((differ & family[t]) == 0)
        a = a[~again]
        left.append(mark[a])
        right.append(mark[a + shift])
    for f, n in zip(first[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        open_ = mark[f : f + n]
        while len(open_) > 1:
            front, open_ = [open_[0]], open_[1:]
            while front and len(open_):
                x = front.pop()
                near = np.bitwise_count(open_ ^ x) <= radius
                if near.any():
                    got, open_ = open_[near], open_[~near]
                    left.append(np.full(len(got), x, np.uint64))
                    right.append(got)
                    front.extend(got)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def segments(mask: int, radius: int) -> list[int]:
    """Masks that add one of radius + 1 segments of the bits that a mask leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | sum(1 << b for b in free[k :: radius + 1]) for k in range(radius + 1)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(marks: DataFrame, radius: int, most: int = MOST) -> DataFrame:
    """Distinct links (u < v) that connect every pair of distinct marks within the radius."""
    return _links(marks, radius, most).distinct()


def _links(marks: DataFrame, radius: int, most: int = MOST, few: int = 0) -> DataFrame:
    """The links as they were kept (``_kept``), some of them repeatedly."""
    family = [m % (1 << 64) for m in masks(radius)]
    rows, out, earlier = marks.select("mark", F.lit(0).alias("t")), None, family
    level = [family]  # the masks that each mask of the level before is split into
    while True:
        dealt = F.explode(F.transform(F.get(F.array(*[F.array(*[F.lit(_signed(m)) for m in some]) for some in level]), F.col("t")), lambda m, i: F.struct(i.alias("i"), F.col("mark").bitwiseAND(m).alias("k"))))
        rows = rows.select("mark", "t", dealt.alias("b")).select((F.col("t") * len(level[0]) + F.col("b.i")).alias("t"), F.col("b.k").alias("k"), "mark")
        masks_here = [m for some in level for m in some]
        last = 64 - min(m.bit_count() for m in masks_here) <= MOST.bit_length() - 1
        found = _kept(_examined(rows.repartition("t", "k").sortWithinPartitions("t", "k"), radius, earlier, None if last else most), few)
        pairs = found.filter("v is not null").select("u", "v")
        out = pairs if out is None else out.unionAll(pairs)
        rows = found.filter("v is null").select(F.col("u").alias("mark"), "t")
        if last or not rows.limit(1).count():
            return out
        level, earlier = [segments(m, radius) for m in masks_here], []


def _examined(rows: DataFrame, radius: int, family: list[int], most: int | None) -> DataFrame:
    """(u, v, t): links of the buckets, and the marks (v null) of those of more than ``most``, with their table.

    rows: (t, k, mark), sorted within partitions, each bucket in one.  A bucket
    that grows too large is passed on as it comes, so it is never held.
    """
    unsigned = np.array(family, np.uint64)

    def batch_of(u: np.ndarray, v: np.ndarray | None, t: np.ndarray | None) -> pa.RecordBatch:
        n = len(u)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.nulls(n, pa.int64()) if v is None else pa.array(v.view(np.int64)), pa.nulls(n, pa.int32()) if t is None else pa.array(t.astype(np.int32))], ["u", "v", "t"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        passing: tuple[int, int] | None = None  # the bucket that is being passed on

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal passing
            if not held:
                return
            t, k, m = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            cut = len(t)
            if not last:  # the last bucket may go on
                cut = int(np.flatnonzero((t != t[-1]) | (k != k[-1])).max(initial=-1)) + 1
                if most is not None and len(t) - cut > most:
                    passing = (int(t[-1]), int(k[-1]))
                    yield batch_of(m[cut:], None, t[cut:])
                else:
                    held.append((t[cut:], k[cut:], m[cut:]))
                t, k, m = t[:cut], k[:cut], m[:cut]
            if cut and most is not None:
                edge = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])]))
                size = np.diff(np.append(edge, cut))
                large = np.repeat(size > most, size)
                if large.any():
                    yield batch_of(m[large], None, t[large])
                    t, k, m = t[~large], k[~large], m[~large]
            if len(t):
                u, v = (x.view(np.int64) for x in bucket_links(t, k, m, radius, unsigned))
                yield batch_of(np.minimum(u, v), np.maximum(u, v), None)

        for batch in batches:
            t, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            m = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if passing is not None:
                other = np.flatnonzero((t != passing[0]) | (k != passing[1]))
                n = int(other[0]) if len(other) else len(t)
                if n:
                    yield batch_of(m[:n], None, t[:n])
                t, k, m = t[n:], k[n:], m[n:]
                if not len(t):
                    continue
                passing = None
            held.append((t, k, m))
            if sum(len(x[0]) for x in held) >= HELD + 2 * len(held[0][0]) * (len(held) > 1 and len(held[0][0]) >= HELD):
                yield from flush(False)
        yield from flush(True)

    return rows.mapInArrow(run, "u long, v long, t int")


def components(edges: DataFrame, most: int = 60, hub: int = HUB) -> DataFrame:
    """(node, root) for each node of the edges; root is the least node reachable.

    Each round is a large star, then a small star; both keep a minimum per node
    (pre-aggregated before the shuffle) and join it back.  A node of more than
    ``hub`` edges, and of more than one 65536th of all, would be one task of
    that join: such nodes, fewer than 131072, are broadcast.  Ends when a round
    changes nothing.
    """

    def back(one: DataFrame, least: DataFrame, total: int) -> DataFrame:
        if total <= hub:  # no node can be a hub
            return one.join(least, one.n == least.c)
        bound = max(hub, total >> 16)
        hubs = F.broadcast(least.filter(F.col("degree") > bound))
        rest = one.join(hubs.select("c"), one.n == F.col("c"), "left_anti")
        return one.join(hubs, one.n == hubs.c).unionByName(rest.join(least.filter(F.col("degree") <= bound), F.col("n") == F.col("c")))

    def star(e: DataFrame, small: bool, total: int) -> DataFrame:
        if small:  # each node and its lesser neighbours go to the least of these
            one = e.select(F.greatest("u", "v").alias("n"), F.least("u", "v").alias("o"))
        else:
            one = e.select(F.col("u").alias("n"), F.col("v").alias("o")).unionAll(e.select("v", "u"))
        least = one.groupBy("n").agg(F.min("o").alias("m"), F.count("*").alias("degree")).select(F.col("n").alias("c"), F.least("n", "m").alias("m"), "degree")
        met = back(one, least, 2 * total)
        if small:
            out = met.select(F.col("o").alias("x"), "m").unionAll(least.select("c", "m"))
        else:
            out = met.filter("o > n").select(F.col("o").alias("x"), "m")
        return out.filter("x != m").select(F.col("m").alias("u"), F.col("x").alias("v")).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit((1 << 40) - 1)))).first())

    edges = settle(edges)
    before = state(edges)
    for _ in range(most if before[0] else 0):
        edges = settle(star(star(edges, False, before[0]), True, before[0]))
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(edges.select(F.col("u"), F.col("u")).distinct())


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and of each the least node reachable."""
    nodes, at_node = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at_node[: len(u)], at_node[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        a, b = np.minimum(a, b)[apart := a != b], np.maximum(a, b)[apart]
        np.minimum.at(root, b, a)
        while not np.array_equal(above := root[root], root):
            root = above
    return nodes, nodes[root]


def _kept(df: DataFrame, few: int) -> DataFrame:
    """The rows, made once: by way of the driver up to ``few`` of them, else in a checkpoint."""
    if few and (rows := df.limit(few + 1).toArrow()).num_rows <= few:
        return df.sparkSession.createDataFrame(rows, df.schema)
    return settle(df)


def classes(marks: DataFrame, *, radius: int = RADIUS, few: int = 0) -> DataFrame:
    """marks: (doc_id, mark).  Returns (mark, root, component_id, rows) for each distinct mark.

    ``few``: rows up to which tables go by the driver (``_few``).  Links do in
    any case if they are at most ``LOCAL``, repeated ones counted.
    """
    distinct = _kept(marks.groupBy("mark").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), few)
    found = _links(distinct.select("mark"), radius, few=few)
    if small := found.count() <= LOCAL:
        pairs = found.toArrow()
        nodes, root = least_reachable(*(pairs.column(c).to_numpy() for c in ("u", "v")))
        parts = F.broadcast(marks.sparkSession.createDataFrame(pa.table({"node": nodes, "root": root})))
    else:
        parts = settle(components(found.distinct()))
    roots = parts.join(distinct, parts.node == distinct.mark).groupBy("root").agg(F.min("least").alias("component")).withColumnRenamed("root", "r")
    parts = parts.join(F.broadcast(roots) if small else roots, F.col("root") == F.col("r")).select("node", "root", "component")
    met = distinct.join(F.broadcast(parts) if small else parts, F.col("mark") == F.col("node"), "left")
    return met.select("mark", F.coalesce("root", "mark").alias("root"), F.coalesce("component", "least").alias("component_id"), "rows")


def annotate(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and component_id."""
    marks = settle(fingerprint(docs, id_column=id_column, text_column=text_column, size=size))
    return _labelled(marks, radius, _few(marks)).select("doc_id", F.lower(F.lpad(F.hex("mark"), 16, "0")).alias("fingerprint"), "component_id")


def _few(marks: DataFrame) -> int:
    """``LOCAL`` if there are no more rows, else none."""
    return LOCAL if marks.count() <= LOCAL else 0


def _labelled(marks: DataFrame, radius: int, few: int) -> DataFrame:
    """marks with their component.

    Up to ``few`` marks are broadcast.  Of more, a mark of many rows would be one
    task of a join, so marks of more than ``HOT`` rows, and of more than one
    65536th of all rows, are broadcast: there are fewer than 65536 of these.  The
    others meet by a shuffle.
    """
    found = _kept(classes(marks, radius=radius, few=few).select(F.col("mark").alias("known"), "root", "component_id", "rows"), few)
    if few:
        return marks.join(F.broadcast(found), F.col("mark") == F.col("known"), "left").drop("known", "rows")
    total = found.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    hot = F.col("rows") > max(HOT, total >> 16)
    common = F.broadcast(found.filter(hot))
    met = marks.join(common, F.col("mark") == F.col("known"))
    rest = marks.join(F.broadcast(found.filter(hot).select("known")), F.col("mark") == F.col("known"), "left_anti")
    rest = rest.join(found.filter(~hot), F.col("mark") == F.col("known"), "left")
    return met.unionByName(rest).drop("known", "rows")


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, radius: int = RADIUS, broadcast_rows: int = 1 << 20) -> DataFrame:
    """One document of each component, the one of the least id, all columns.

    Where ids are unique, only ids move: the documents to drop are anti-joined,
    by broadcast if there are at most ``broadcast_rows`` of them, else by a
    shuffle.  Where an id repeats, rows meet by component, and of the rows of the
    least id the least by content stays.
    """
    marks = settle(fingerprint(docs, id_column=id_column, text_column=text_column, size=size))
    if marks.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return _keep_by_mark(docs, marks, id_column, text_column, size, radius)
    gone = _labelled(marks, radius, few := _few(marks)).filter(~F.col("doc_id").eqNullSafe(F.col("component_id")))
    gone = _kept(gone.select(F.col("doc_id").alias(name := fresh(docs.columns, "_gone"))), few)
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return docs.join(side, F.col(id_column).eqNullSafe(F.col(name)), "left_anti")


def _keep_by_mark(docs: DataFrame, marks: DataFrame, id_column: str, text_column: str, size: int, radius: int) -> DataFrame:
    names = docs.columns
    own = fresh(names, "_mark")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in at.slices(batch, text_column):
                found = fingerprints(at.as_bytes(part.column(text_column)).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found.view(np.int64))], [*names, own])

    rows = docs.mapInArrow(mark, T.StructType([*docs.schema.fields, T.StructField(own, T.LongType())]))
    found = classes(marks, radius=radius, few=_few(marks))
    found = found.select(F.struct("root", "component_id").alias(known := fresh(names, "_class")), F.col("mark").alias(key := fresh(names, "_key")))
    rows = rows.join(found, F.col(own) == F.col(key))
    rows = rows.filter(F.col(id_column).eqNullSafe(F.col(f"{known}.component_id")))
    return rows.groupBy(F.col(f"{known}.root")).agg(F.min(F.struct(*names)).alias("row")).select("row.*")
