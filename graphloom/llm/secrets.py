"""Secret scan with multipart linking, as column expressions only.

Base findings (``assign``, ``access``, ``hex``) are always reported.  Weak
parts (a short access id or an account assignment, a mixed token, an endpoint)
are reported only when complementary parts that share no character with them
stand in their scope, less than ``SCOPE`` code points away: a weak id next to a
secret, a weak secret next to an id or an endpoint, an endpoint next to both.

The interval join is a sweep within the text.  The nearest part of a kind that
ends before a part is a running maximum over all ends and starts in order; the
nearest that begins behind it is the same, mirrored; and whether a base finding
overlaps it is a running maximum of ends by start.  The maxima run in blocks of
``BLOCK``, so any number of parts of any length is joined exactly, and nothing
is shuffled.

Defined edge cases: null text is empty; repeated rows are each returned; weak
parts that overlap a base finding are left out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import let, matches, running_max

SCOPE, LEAST = 200, 6

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
HEX_LONG = r"[0-9a-f]{24}"
WEAK_ID = r"AKIA[A-Z0-9]+|(?i:access_?key_?id|client_?id|user_?name|account|login)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=@-]+"
WEAK_SECRET = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}+={0,2}"
ENDPOINT = r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\x00-\x20\"'<>]+"

#: Kinds in the order that breaks ties, with their part.
KINDS = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
NAMES = list(KINDS)
#: Kinds that are always reported come first.
BASE = 3
PARTS = ["id", "secret", "endpoint"]
SPAN = "array<struct<start:int,rank:int,end:int,part:string>>"


def _kind(text: Column, name: str, pattern: str, guard: Column, good: Callable[[Column], Column]) -> Column:
    def made(m: Column) -> Column:
        return F.transform(F.filter(m, lambda x: good(x["found"])), lambda x: F.struct(x["start"].alias("start"), F.lit(NAMES.index(name)).alias("rank"), x["end"].alias("end"), F.lit(KINDS[name]).alias("part")))

    return F.when(guard, made(matches(text, pattern)).cast(SPAN)).otherwise(F.array().cast(SPAN))


def findings(text: Column) -> Column:
    """All reported spans, sorted: array of (start, rank, end, part)."""
    text = F.coalesce(text, F.lit(""))
    digit = F.regexp_like(text, F.lit("[0-9]"))
    parts = F.concat(
        _kind(text, "assign", ASSIGN, F.regexp_like(text, F.lit("[:=]")), lambda x: F.length(F.regexp_extract(x, ASSIGN, 2)) >= 6),
        _kind(text, "access", ACCESS, F.contains(text, F.lit("AKIA")), lambda x: F.length(x) >= 20),
        _kind(text, "hex", HEX, F.regexp_like(text, F.lit(HEX_LONG)), lambda x: F.length(x) >= 24),
        _kind(text, "weak_id", WEAK_ID, F.contains(text, F.lit("AKIA")) | F.regexp_like(text, F.lit("[:=]")), lambda x: (F.length(x) >= LEAST) & ~(x.startswith("AKIA") & (F.length(x) >= 20))),
        _kind(text, "weak_secret", WEAK_SECRET, digit, lambda x: F.regexp_like(x, F.lit("[0-9]")) & F.regexp_like(x, F.lit("[a-z]")) & F.regexp_like(x, F.lit("[A-Z]"))),
        _kind(text, "endpoint", ENDPOINT, F.contains(text, F.lit("://")), lambda x: F.length(x) >= LEAST),
    )
    return let(F.array_sort(parts), lambda p: F.when(F.exists(p, lambda x: x["rank"] >= BASE), _linked(p)).otherwise(p))


def _sweep(parts: Column, at: Callable[[Column], Column], ask: Callable[[Column], Column], values: list[Callable[[Column], Column]], *, last: bool) -> Column:
    """For each part, the greatest of each of ``values`` among the parts whose ``at`` is below its ``ask`` (or equal to it, if ``last``).

    Parts and questions stand in one order; a value is an int, or -1 where a part doesn't count.
    """
    here, there = (0, 1) if last else (1, 0)  # which comes first where both are equal
    none = [F.lit(-1).alias(f"v{k}") for k in range(len(values))]
    given = F.transform(parts, lambda p: F.struct(at(p).alias("at"), F.lit(here).alias("turn"), F.lit(-1).alias("nth"), *(v(p).alias(f"v{k}") for k, v in enumerate(values))))
    asked = F.transform(parts, lambda p, i: F.struct(ask(p).alias("at"), F.lit(there).alias("turn"), i.alias("nth"), *none))

    def answers(events: Column) -> Column:
        best = [running_max(_field(events, f"v{k}")).alias(f"b{k}") for k in range(len(values))]

        def zipped(s: Column) -> Column:
            return F.transform(s["nth"], lambda n, i: F.struct(n.alias("nth"), *(F.get(s[f"b{k}"], i).alias(f"b{k}") for k in range(len(values)))))

        return F.array_sort(F.filter(let(F.struct(_field(events, "nth").alias("nth"), *best), zipped), lambda r: r["nth"] >= 0))

    return let(F.array_sort(F.concat(given, asked)), answers)


def _field(rows: Column, name: str) -> Column:
    return F.transform(rows, lambda r: r[name])


def _linked(parts: Column) -> Column:
    """Base findings, and weak parts with their complement in scope."""

    def of(name: str, value: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda p: F.when(p["part"] == name, value(p)).otherwise(-1)

    def joined(far: Column) -> Column:  # the largest end mirrors the text, so that nearest behind is a maximum, too
        before = _sweep(parts, lambda p: p["end"], lambda p: p["start"], [of(n, lambda p: p["end"]) for n in PARTS], last=True)
        behind = _sweep(parts, lambda p: far - p["start"], lambda p: far - p["end"], [of(n, lambda p: far - p["start"]) for n in PARTS], last=True)
        covers = _sweep(parts, lambda p: p["start"], lambda p: p["end"], [lambda p: F.when(p["rank"] < BASE, p["end"]).otherwise(-1)], last=False)
        near = F.struct(before.alias("before"), behind.alias("behind"), covers.alias("covers"))
        return let(near, lambda n: F.filter(parts, lambda p, i: stays(p, far, F.get(n["before"], i), F.get(n["behind"], i), F.get(n["covers"], i))))

    def stays(p: Column, far: Column, before: Column, behind: Column, covers: Column) -> Column:
        def has(name: str) -> Column:
            left, right = before[f"b{PARTS.index(name)}"], behind[f"b{PARTS.index(name)}"]
            return ((left >= 0) & (left > p["start"] - SCOPE)) | ((right >= 0) & (far - right < p["end"] + SCOPE))

        linked = F.when(p["rank"] == 3, has("secret")).when(p["rank"] == 4, has("id") | has("endpoint")).otherwise(has("id") & has("secret"))
        return (p["rank"] < BASE) | ((covers["b0"] <= p["start"]) & linked)

    return let(F.array_max(_field(parts, "end")), joined)


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def annotate(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of base findings, the digest of their places, and all spans, per row."""

    def report(s: Column) -> Column:
        def count(rank: int) -> Column:
            return F.size(F.filter(s, lambda x: x["rank"] == rank)).cast("long")

        base = F.filter(s, lambda x: x["rank"] < BASE)
        return F.struct(
            count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"),
            _joined(s).alias("spans"), F.size(F.filter(s, lambda x: x["rank"] >= BASE)).cast("long").alias("n_linked"),
        )

    return docs.select(F.col(id_column).alias("doc_id"), let(findings(F.col(text_column)), report).alias("r")).select("doc_id", "r.*")
