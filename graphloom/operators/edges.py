"""Edges by name: exploding, resolving to entities, degrees, the reverse index.

A dotted-boundary match is an equi-join on suffix keys: a call meets an entity
if the entity's whole name is one of the call's suffixes, or the call is one of
the name's suffixes.  Nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..schema import EDGE_KINDS
from ..storage import settle, stored

#: The order that decides every "first": the reference points of ties.
ORDER = ["file_path", "start_line", "id"]
#: Rows of a side that may be broadcast; they are names and places, some hundred bytes each.
BROADCAST = 100_000
#: Edges of one target from which it may count as hot.
HOT = 1 << 16


def edges(entities: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(src_id, src_file, kind, pos, target): one row per edge, in array order."""
    out = None
    for kind in kinds or EDGE_KINDS:
        rows = entities.select(F.col("id").alias("src_id"), F.col("file_path").alias("src_file"), F.lit(kind).alias("kind"), F.posexplode(kind).alias("pos", "target"))
        out = rows if out is None else out.unionByName(rows)
    return out


def near(df: DataFrame) -> DataFrame:
    """Kept, and broadcast in a join if it has at most ``BROADCAST`` rows."""
    df = settle(df)
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def matched(left: DataFrame, left_name: str, right: DataFrame, right_name: str) -> DataFrame:
    """All pairs of rows whose names match at a dotted boundary, once each.

    Columns of the two sides must be distinct.  Equal names meet in the first
    part only; the second asks for a proper suffix, so no distinct is needed
    unless a name has itself as a shorter suffix, which cannot be.
    """
    call = left.withColumn("_suffix", F.explode(names.suffixes(left_name)))
    first = call.join(right, F.col("_suffix") == F.lower(right_name)).drop("_suffix")
    name = right.withColumn("_suffix", F.explode(F.slice(names.suffixes(right_name), F.lit(2), F.size(names.suffixes(right_name)))))
    second = left.join(name, F.lower(left_name) == F.col("_suffix")).drop("_suffix")
    return first.unionByName(second)


def probed(few: DataFrame, few_name: str, many: DataFrame, many_name: str) -> DataFrame:
    """The same pairs in one join: where the one side is small, the other is read once and not shuffled."""
    keyed = near(few.select("*", F.posexplode(names.suffixes(few_name)).alias("_n", "_key")))
    rows = many.select("*", F.posexplode(names.suffixes(many_name)).alias("_m", "_suffix"))
    return rows.join(keyed, (F.col("_suffix") == F.col("_key")) & ((F.col("_n") == 0) | (F.col("_m") == 0))).drop("_n", "_m", "_key", "_suffix")


def best(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def met_by_key(rows: DataFrame, table: DataFrame, key: str, count: str, hot: int = HOT) -> DataFrame:
    """rows left-joined with a table of one row per key, which says how many rows a key has.

    The keys of most rows, ``BROADCAST`` at most, are broadcast, so their rows
    don't move, and no other key fills a task of the shuffle; there the table,
    not the rows, is held.
    """
    total = table.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    if total <= hot:
        return rows.join(table.drop(count), key, "left")
    bound, keys = 0, 0
    for n, k in sorted(table.groupBy(count).agg(F.count("*").alias("_k")).collect(), reverse=True):
        keys += k
        if keys > BROADCAST:
            bound = n
            break
    common = F.broadcast(table.filter(F.col(count) > bound).drop(count))
    if not bound:
        return rows.join(common, key, "left")
    rest = rows.join(common.select(key), key, "left_anti").join(table.filter(F.col(count) <= bound).drop(count).hint("shuffle_hash"), key, "left")
    return rows.join(common, key).unionByName(rest)


def resolve_calls(entities: DataFrame, kinds: list[str] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Each edge with its target entity, or null.

    Candidates match at a dotted boundary; where none does, those matching the
    call's last segment.  Of several, one of the caller's file, else the first.
    Distinct targets, and distinct last segments of those that stay unresolved,
    are looked up once; the first overall and the first per file are chosen
    before any edge is met, so no edge meets all candidates.  ``sources``: the
    entities whose edges are asked for, if not all.
    """
    all_ = edges(entities if sources is None else sources, kinds or ["calls"]).withColumn("k", F.lower("target"))
    wanted = settle(all_.groupBy("k").agg(F.count("*").alias("n")))
    known = entities.select(F.col("id").alias("dst_id"), F.col("name").alias("dst_name"), F.col("file_path").alias("dst_file"), F.col("start_line").alias("dst_line"))

    def found(keys: DataFrame) -> DataFrame:
        return stored(probed(keys, "k", known, "dst_name"))

    direct = found(wanted.select("k"))
    solved = direct.select("k").distinct()
    missing = settle(wanted.join(solved, "k", "left_anti").select("k", names.last_segment("k").alias("segment")))
    again = found(missing.select(F.col("segment").alias("k")).distinct().join(solved, "k", "left_anti"))
    both = direct.unionByName(again)
    entity = F.struct("dst_id", "dst_name", "dst_file", "dst_line")
    overall = best(both, ["k"], ["dst_file", "dst_line", "dst_id"]).select(F.col("k").alias("q"), entity.alias("any"))
    local = best(both, ["k", "dst_file"], ["dst_line", "dst_id"]).select(F.col("k").alias("q"), F.col("dst_file").alias("src_file"), entity.alias("own"))
    asked = wanted.join(missing, "k", "left").select("k", "n", F.coalesce("segment", "k").alias("q"), F.when(F.col("segment").isNull(), 1).otherwise(2).alias("way"))
    asked = stored(asked.join(overall, "q", "left"))
    rows = met_by_key(all_, asked, "k", "n").join(near(_own(all_, asked, local)), ["q", "src_file"], "left")
    chosen = F.coalesce("own", "any")
    return rows.select("src_id", "kind", "pos", "target", "src_file", *(chosen[c].alias(c) for c in ("dst_id", "dst_name", "dst_file", "dst_line")), F.when(chosen.isNotNull(), F.col("way")).alias("strategy"))


def _own(all_: DataFrame, asked: DataFrame, local: DataFrame) -> DataFrame:
    """Of the first matches per file those that an edge of the file asks for and that aren't the first overall."""
    own = stored(local.join(asked.select("q", F.col("any")["dst_id"].alias("_first")).distinct(), "q").filter(F.col("own")["dst_id"] != F.col("_first")).drop("_first"))
    keys = asked.select("k", "q").join(own.select("q").distinct(), "q", "left_semi")
    pairs = all_.select("k", "src_file").join(near(keys), "k").select("q", "src_file").distinct()
    return own.join(pairs, ["q", "src_file"], "left_semi")


def degrees(entities: DataFrame) -> DataFrame:
    """Entities with outgoing_degree and incoming_count over all edge kinds.

    A reference means the first entity of exactly that name without case; one
    longer than two characters that names none means the first that matches at
    a dotted boundary.
    """
    refs = edges(entities).groupBy(F.lower("target").alias("ref")).agg(F.count("*").alias("n"))
    known = entities.select(F.col("id").alias("dst_id"), F.lower("name").alias("dst_name"), F.col("file_path").alias("dst_file"), F.col("start_line").alias("dst_line"))
    exact = best(known, ["dst_name"], ["dst_file", "dst_line", "dst_id"])
    hit = settle(refs.join(exact, F.col("ref") == F.col("dst_name"), "left"))
    rest = hit.filter(F.col("dst_id").isNull() & (F.length("ref") > 2)).select("ref", "n")
    near = best(probed(rest, "ref", known, "dst_name"), ["ref"], ["dst_file", "dst_line", "dst_id"])
    incoming = hit.filter(F.col("dst_id").isNotNull()).select("dst_id", "n").unionByName(near.select("dst_id", "n")).groupBy("dst_id").agg(F.sum("n").alias("incoming_count"))
    out = F.size("calls") + F.size("is_a") + F.size("contains")
    return entities.join(incoming, F.col("id") == F.col("dst_id"), "left").drop("dst_id").withColumn("incoming_count", F.coalesce("incoming_count", F.lit(0))).withColumn("outgoing_degree", out.cast("long"))


#: Columns of an entity in the reverse index.
SOURCE = {"id": "s_id", "name": "s_name", "file_path": "s_file", "entity_type": "s_type", "start_line": "s_start", "end_line": "s_end"}


def reference_index(entities: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The reverse index: a row per suffix key of each distinct edge, with the entity it comes from.

    ``exact`` says that the key is the edge's whole target.
    """
    out = None
    for kind in kinds or ["calls", "is_a"]:
        rows = entities.select(*(F.col(c).alias(a) for c, a in SOURCE.items()), F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.transform(kind, F.lower))).alias("target"))
        rows = rows.select("*", F.posexplode(names.suffixes("target")).alias("_m", "key")).withColumn("exact", F.col("_m") == 0).drop("_m", "target")
        out = rows if out is None else out.unionByName(rows)
    return out


def referring(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Index rows whose target matches ``at`` of wanted, which has one row per name."""
    keyed = near(wanted.select("at", F.posexplode(names.suffixes("at")).alias("_n", "key")))
    return index.join(keyed, "key").filter((F.col("_n") == 0) | F.col("exact")).drop("_n", "key", "exact")


def references_to(entities: DataFrame, wanted: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """The same rows without an index, from one look at the entities; a repeated edge may come twice.

    Names that match have one last segment, so edges of other ones go before
    any suffix is made: nothing but matches is stored or moved.
    """
    segments, out = near(wanted.select(names.last_segment("at").alias("_last")).distinct()), None
    for kind in kinds or ["calls", "is_a"]:
        rows = entities.select(*(F.col(c).alias(a) for c, a in SOURCE.items()), F.lit(kind).alias("kind"), F.explode(kind).alias("target"))
        rows = rows.join(segments, names.last_segment("target") == F.col("_last"), "left_semi")
        out = rows if out is None else out.unionByName(rows)
    return probed(wanted.select("at"), "at", out, "target").drop("target")
