"""Main text of web pages: page structure, then a suffix array per host.

A page is read into blocks in page order, each with a role: ``M`` within an
article or main element, ``F`` for furniture (navigation, footers, adverts,
forms, notices, comments, ...; scripts, styles, markup comments and the head
give no blocks), ``U`` where the structure doesn't tell.  A class or id may only
hint at furniture: an article or main element in such a block is main text
again, unless the hint, there or on the article itself, is of comments or
related articles; then it is furniture.  Classes like has-sidebar are no hint.

The ``M`` blocks of a page are its candidates, or its ``U`` blocks if it has no
``M``.  The candidates of all pages of a host form one token stream, in which
what repeats on distinct pages is found:

* ``U`` blocks by words: the suffix array, sorted to ``RUN`` words, shows every
  run of at least that many that stands on two or more distinct pages.  Such a
  run, if it covers the whole block or that many of its words, is boilerplate
  and only what is between stays.
* ``M`` blocks whole, each as one token: a block that stands on at least half of
  a host's pages, and on ``FEW`` or more, is furniture that the structure didn't
  name, such as a notice within every article.  But if these are more than half
  of an article's words, the page is a copy of others and stays whole: an
  article that pages share is still the article.

``n_repeated`` counts the words that go so.

Hosts of more than ``SHARD`` pages or ``SHARD_BYTES`` of html are cut by a hash
of the page into shards of about that size, so no host is one task.  What
repeats is still decided over the whole host: each shard gives the 64-bit hashes
of its runs and blocks, with the number of its pages that have them; these meet
by host and hash, and each shard gets back those that repeat.  So neither the
size of a shard nor the order of rows changes a result.

Defined edge cases: null html gives empty text; a null url is a host of its
own; an unclosed element ends with its parent, an unclosed comment with the
page; a tag that never ends is text; repeated rows are each returned and count
as one page by their id; other input columns are ignored.  Reading a page takes
time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from . import textmodel as tm
from .decontaminate import suffix_array

RUN, FEW = 5, 5
#: Pages and bytes of html of a shard, about.
SHARD, SHARD_BYTES = 250, 8 << 20
#: Cut hosts that may be broadcast; beyond that only those of more than ``LARGE`` shards are.
HOSTS, LARGE = 1 << 16, 64
#: Tasks at most among which the runs of one host are dealt.
BUCKETS = 1 << 10

#: Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title", "head", "math", "object", "canvas", "audio", "video"}
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "label", "header"}
CONTAINER = {"article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary",
    "table", "tbody", "tfoot", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: A word that a modifier class only speaks about, as in has-sidebar or no-sidebar.
BARE = r"(?<![a-z])(?<!(?<![a-z])has[-_])(?<!(?<![a-z])with[-_])(?<!(?<![a-z])no[-_])(?<!(?<![a-z])without[-_])"
HINT = re.compile(
    rf"{BARE}(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|footer|menu|modal|nav\w*|newsletter|notices?|popup|promo\w*|related|share|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?![a-z])", re.I
)
#: Hints of articles that aren't the page's own: classes that begin so, but for a state as in comments-open.
OTHERS = re.compile(r"(?<![a-z0-9_-])(?:comments?|related)(?![a-z])(?![-_](?:open|closed|enabled|disabled|on|off)(?![a-z]))", re.I)
ATTRIBUTE = re.compile(r"([^\s=\"'/]++)\s*+(?:=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s\"']*+)))?+")
NAME_END, STOP = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in RAW}


class Tags:
    """The tags of a page, in time in proportion to its length.

    A tag that never ends is no tag.  What makes one fail is kept, so that the
    next doesn't look for it again: where the next character of a kind stands,
    and the quotation marks from which no tag's end was reached.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.ahead = {NAME_END: (0, -1), STOP: (0, -1)}
        self.dead: set[int] = set()
        self.endless: set[str] = set()

    def _next(self, what: re.Pattern, at: int) -> int:
        """The next place of a kind of character, or the page's end."""
        low, high = self.ahead[what]
        if not low <= at <= high:
            m = what.search(self.page, at)
            high = m.start() if m else len(self.page)
            self.ahead[what] = (at, high)
        return high

    def _end(self, at: int) -> int:
        """The place of the > that ends a tag's attributes, or -1."""
        page, q, seen = self.page, self._next(STOP, at), []
        while q < len(page) and q not in self.dead:
            if page[q] == ">":
                return q
            seen.append(q)
            closing = page.find(page[q], q + 1)
            if closing < 0:
                break
            m = STOP.search(page, closing + 1)
            q = m.start() if m else len(page)
        self.dead.update(seen)
        return -1

    def find(self, place: int) -> tuple[int, int, bool, str, str] | None:
        """The next tag, or markup comment (no name): start, end, whether it closes, name and attributes."""
        page, i = self.page, self.page.find("<", place)
        while i >= 0:
            c = page[i + 1 : i + 2]
            if page.startswith("<!--", i):
                short = next((x for x in ("<!-->", "<!--->") if page.startswith(x, i)), None)
                j = page.find("-->", i + 4)
                return i, i + len(short) if short else j + 3 if j >= 0 else len(page), False, "", ""
            if page.startswith("<![CDATA[", i):
                j = page.find("]]>", i)
                return i, j + 3 if j >= 0 else len(page), False, "", ""
            if i < self.last:
                if c in ("!", "?"):
                    return i, page.find(">", i) + 1, False, "", ""
                first = i + 2 if c == "/" else i + 1
                if page[first : first + 1].isascii() and page[first : first + 1].isalpha():
                    name_end = self._next(NAME_END, first)
                    end = self._end(name_end) if name_end < len(page) else -1
                    if end >= 0:
                        return i, end + 1, c == "/", page[first:name_end].lower(), page[name_end:end]
            i = page.find("<", i + 1)
        return None

    def after(self, name: str, place: int) -> int | None:
        """The place after the closing tag of an element that holds no markup."""
        if name not in self.endless:
            m = RAW_END[name].search(self.page, place)
            end = self.page.find(">", m.end()) if m else -1
            if end >= 0:
                return end + 1
            self.endless.add(name)
        return None


def hints(attributes: str) -> str:
    """What the class, id or role of an element tells: "others" or "hint" of furniture, or nothing."""
    if "=" not in attributes:
        return ""
    values: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        if (name := m[1].lower()) in ("class", "id", "role"):
            values.setdefault(name, m[2] or m[3] or m[4] or "")
    if any(OTHERS.search(v) for v in values.values()):
        return "others"
    return "hint" if any(HINT.search(v) for v in values.values()) else ""


def unescape(text: str) -> str:
    """Character references decoded; one of more digits than a number may have stands for no character."""
    try:
        return html.unescape(text)
    except ValueError:
        return html.unescape(re.sub(r"&#[0-9]{8,};?+", "\ufffd", re.sub(r"&#0++(?=[0-9])", "&#", text)))


def blocks(page: str) -> list[tuple[str, str]]:
    """(role, text) of each block that has text, in page order."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    inside = 0  # open article and main elements
    skip, depth = "", 0  # furniture element and its open namesakes
    why, within = "", 0  # what made it furniture, and article and main elements open within it
    under: list[tuple[str, int, str, int, int]] = []  # skip, depth, why, within and inside of blocks that an article or main has reopened
    tags, place = Tags(page), 0

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            if text:
                out.append(("F" if skip else "M" if inside else "U", text))
            held.clear()

    def furniture(name: str, attributes: str) -> str:
        """Why an element that opens is furniture: itself, a hint, a hint of others' articles; or not."""
        if name in CONTAINER:
            return "others" if hints(attributes) == "others" else ""
        if name in FURNITURE and not (name == "header" and inside):
            return "itself"
        return hints(attributes) if name not in ("html", "body") else ""

    def counted(name: str, close: bool) -> None:
        """Namesakes of a reopened block; it may end before the article in it."""
        nonlocal inside
        if under and name == under[-1][0]:
            s, d, w, n, before = under.pop()
            d += -1 if close else 1
            if d > 0:
                under.append((s, d, w, n, before))
            else:
                inside = before

    def closed() -> None:
        """An article or main ends; text in a reopened block is furniture again."""
        nonlocal inside, skip, depth, why, within
        inside = max(0, inside - 1)
        if under and inside <= under[-1][4]:
            skip, depth, why, within, inside = under.pop()

    while (tag := tags.find(place)) is not None:
        start, end, close, name, attributes = tag
        if start > place:
            held.append(page[place:start])
        place = end
        if not name:
            continue
        if name in RAW and not close and not attributes.endswith("/"):
            end = tags.after(name, place)
            if name == "head" and end is None:
                continue
            place = len(page) if end is None else end
            continue
        if name not in BLOCK and name not in FURNITURE:
            if name in ("br", "td", "th"):
                held.append(" ")
            if not close and not skip and name not in VOID and (reason := hints(attributes)):
                flush()
                skip, depth, why, within = name, 1, reason, 0
            elif skip == name:
                depth += -1 if close else 1
                if depth == 0:
                    flush()
                    skip = ""
            elif under and not skip and name == under[-1][0]:
                flush()
                counted(name, close)
            continue
        flush()
        if skip:
            if name == skip:
                depth += -1 if close else (0 if name in ("p", "li") else 1)
                if not close and name in ("p", "li"):
                    depth = 0
            elif skip == "p":
                depth = 0  # a paragraph ends at any block
            elif name in CONTAINER and not close:
                if (why == "hint" or (why == "others" and name == "main")) and hints(attributes) != "others":
                    under.append((skip, depth, why, within, inside))
                    skip = ""
                    inside += 1
                    continue
                within += 1
            elif name in CONTAINER and within:
                within -= 1
            elif close and (name in CONTAINER or name == "body"):
                depth = 0  # anything ends at its parent's end
            if depth > 0:
                continue
            ended, skip, within = skip, "", 0
        else:
            ended = ""
        if close:
            if name in CONTAINER and name != ended:
                closed()
            elif name != ended:
                counted(name, close)
        elif reason := furniture(name, attributes):
            skip, depth, why, within = name, 1, reason, 0
        else:
            counted(name, close)
            inside += name in CONTAINER
    held.append(page[place:])
    flush()
    return out


def host_of(column: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.col(column), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def run_hashes(word: np.ndarray, row: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of the ``run`` words from each word on, and whether they all stand in its row."""
    n = len(word)
    ahead, h = np.concatenate([word, np.zeros(run, np.uint64)]), np.zeros(n, np.uint64)
    for k in range(run):
        h = h * np.uint64(at.BASE) + ahead[k : k + n]
    whole = np.zeros(n, bool)
    if n >= run:
        whole[: n - run + 1] = row[run - 1 :] == row[: n - run + 1]
    return at.mix(h).view(np.int64), whole


def words_of(texts: list[bytes]) -> tuple[at.Spans, np.ndarray]:
    """Words of the texts and their hashes."""
    data, offsets = at.buffer(pa.array(texts, pa.large_binary()))
    spans = at.Spans(data, offsets, ~at.WHITE)
    return spans, at.Hasher(data, tm.VALUES).spans(spans.start, spans.end) if len(spans) else np.zeros(0, np.uint64)


def repeated(pages: list[object], rows: list[int], texts: list[bytes], run: int, known: np.ndarray | None = None) -> tuple[at.Spans, np.ndarray]:
    """Words of the texts, and which stand in a run of ``run`` words found on distinct pages.

    pages, rows: of each text.  known: hashes of the repeated runs, in order; without, these texts are all there are.
    """
    spans, hashes = words_of(texts)
    if not len(spans):
        return spans, np.zeros(0, bool)
    row = np.array(rows)[spans.row]
    found = _covered(hashes, row, run, known) if known is not None else _covered_of_all(hashes, row, pages, spans, run)
    edge = np.ones(len(found), bool)  # a stretch of a block; it counts if it is long or the whole block
    edge[1:] = (found[1:] != found[:-1]) | (spans.row[1:] != spans.row[:-1])
    at_ = np.flatnonzero(edge)
    length = np.diff(np.append(at_, len(found)))
    counts = np.where((length >= run) | (length == spans.counts()[spans.row[at_]]), found[at_], False)
    return spans, np.repeat(counts, length)


def _covered(hashes: np.ndarray, row: np.ndarray, run: int, known: np.ndarray) -> np.ndarray:
    """Words within a run whose hash is known."""
    hit = np.zeros(0, np.int64)
    if len(known):
        h, whole = run_hashes(hashes, row, run)
        hit = np.flatnonzero(whole & (known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h))
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + run, -1)
    return np.cumsum(cover)[:-1] > 0


def _covered_of_all(hashes: np.ndarray, row: np.ndarray, pages: list[object], spans: at.Spans, run: int) -> np.ndarray:
    """Words within a run that the suffix array shows on distinct pages."""
    _, word = np.unique(hashes, return_inverse=True)
    number = {p: i for i, p in enumerate(dict.fromkeys(pages))}
    page = np.array([number[p] for p in pages])[spans.row]
    edge = np.concatenate([[True], row[1:] != row[:-1]])
    at_ = np.arange(len(word)) + np.cumsum(edge)  # a 0 before each row: no run crosses it
    stream = np.zeros(int(at_[-1]) + 1 + run, np.int64)
    stream[at_] = word + 1
    of = np.full(len(stream), -1)
    of[at_] = page
    order = suffix_array(stream, run)
    same = np.ones(len(order) - 1, bool)
    whole = np.ones(len(order), bool)
    padded = np.concatenate([stream, np.zeros(run, np.int64)])
    for k in range(run):
        token = padded[order + k]
        same &= token[1:] == token[:-1]
        whole &= token > 0
    group = np.concatenate([[0], np.cumsum(~same)])
    low = np.full(group[-1] + 1, len(stream))
    high = np.full(group[-1] + 1, -1)
    np.minimum.at(low, group, of[order])
    np.maximum.at(high, group, of[order])
    hit = order[whole & (low < high)[group]]
    cover = np.zeros(len(stream) + run + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + run, -1)
    return (np.cumsum(cover)[: len(stream)] > 0)[at_]


def block_hashes(texts: list[str]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in texts]


def common(hashes: np.ndarray, counts: np.ndarray, pages: int) -> np.ndarray:
    """The hashes that stand on at least half of the pages, and on ``FEW`` or more.  counts: pages per hash, to be summed."""
    value, at_ = np.unique(hashes, return_inverse=True)
    total = np.bincount(at_, weights=counts, minlength=len(value))
    return value[(total >= FEW) & (2 * total >= pages)]


def page_counts(keys: list[int], hashes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct hash and the number of distinct pages that have it."""
    pairs = {(h, k) for k, some in zip(keys, hashes, strict=True) for h in some}
    return np.unique(np.array([h for h, _ in pairs], np.int64), return_counts=True)


def main_texts(keys: list[int], whole: list[bool], texts: list[list[str]], run: int, known: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[str, int, int]]:
    """Text, blocks and repeated words of each page of a shard.

    keys: of the pages.  whole: the candidates are M blocks.  known: hashes of
    the host's repeated runs and common blocks, in order; without, these pages
    are all there are.
    """
    loose = [i for i, w in enumerate(whole) if not w]
    flat = [t.encode("utf-8", "surrogatepass") for i in loose for t in texts[i]]
    spans, hit = repeated([keys[i] for i in loose for _ in texts[i]], [i for i in loose for _ in texts[i]], flat, run, known[0] if known else None)
    gone = np.bincount(spans.row, weights=hit, minlength=len(flat)).astype(np.int64)
    first = np.searchsorted(spans.row, np.arange(len(flat) + 1))
    own = [block_hashes(some) if w else [] for w, some in zip(whole, texts, strict=True)]
    often = set((known[1] if known else common(*page_counts(keys, own), len(set(keys)))).tolist())
    out, base = [], 0
    for w, some, hashes in zip(whole, texts, own, strict=True):
        kept, removed = [], 0
        if w:
            sizes = [len(t.split()) for t in some] if often else [0] * len(some)
            removed = sum(n for n, h in zip(sizes, hashes, strict=True) if h in often)
            copy = 2 * removed > sum(sizes)
            removed = 0 if copy else removed
            kept = [t for t, h in zip(some, hashes, strict=True) if copy or h not in often]
        else:
            for t in some:
                if gone[base]:
                    free = ~hit[first[base] : first[base + 1]]
                    t = " ".join(x for x, f in zip(t.split(), free.tolist(), strict=False) if f)
                if t:
                    kept.append(t)
                removed += int(gone[base])
                base += 1
        out.append(("\n".join(kept), len(kept), removed))
    return out


def shard_runs(keys: list[int], texts: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, page key) of each distinct run of each page."""
    spans, hashes = words_of([t.encode("utf-8", "surrogatepass") for some in texts for t in some])
    row = np.array([i for i, some in enumerate(texts) for _ in some], np.int64)[spans.row]
    h, whole = run_hashes(hashes, row, run)
    key = np.array(keys, np.int64)[row[whole]]
    order = np.lexsort((key, h[whole]))
    h, key = h[whole][order], key[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (key[1:] != key[:-1])
    return h[fresh], key[fresh]


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _numbers(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.int64) for x in column.to_pylist()]


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, str]) -> Iterator[tuple[tuple | None, pa.RecordBatch | None]]:
    """(key, rows) of each stretch of rows of one key, in order; (None, None) at the end."""
    for batch in batches:
        first, second = batch.column(keys[0]).dictionary_encode(), batch.column(keys[1]).to_numpy()
        code = first.indices.to_numpy()
        edge = (np.flatnonzero((code[1:] != code[:-1]) | (second[1:] != second[:-1])) + 1).tolist()
        for a, b in zip([0, *edge], [*edge, batch.num_rows], strict=True):
            if a < b:
                yield (first.dictionary[int(code[a])].as_py(), int(second[a])), batch.slice(a, b - a)
    yield None, None


class ShardMarks:
    """Hashes of one shard: runs of its loose pages, whole blocks of the others, and its pages."""

    def __init__(self, cuts: int) -> None:
        self.buckets = min(BUCKETS, 1 + cuts // 8)
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.blocks: set[tuple[int, int]] = set()
        self.pages: set[int] = set()

    def add(self, rows: pa.RecordBatch, run: int) -> None:
        keys, whole, texts = (rows.column(c).to_pylist() for c in ("page_key", "whole", "blocks"))
        self.pages.update(keys)
        loose = [i for i, w in enumerate(whole) if not w]
        self.runs.append(shard_runs([keys[i] for i in loose], [texts[i] for i in loose], run))
        self.blocks.update((h, keys[i]) for i, w in enumerate(whole) if w for h in block_hashes(texts[i]))

    def cells(self, host: str, cut: int) -> pa.RecordBatch:
        """A row per bucket: runs, those on several pages first, and blocks with their pages."""
        h, key = (_joined([r[k] for r in self.runs]) for k in (0, 1))
        order = np.argsort(h, kind="stable")
        h, key = h[order], key[order]
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
        again = np.minimum.reduceat(key, start) != np.maximum.reduceat(key, start) if len(start) else np.zeros(0, bool)
        h = h[start]
        order = np.argsort(~again, kind="stable")
        h, again = h[order], again[order]
        block, count = np.unique(np.array([b for b, _ in self.blocks], np.int64), return_counts=True)

        def dealt(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bucket = (x.view(np.uint64) % np.uint64(self.buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            return by, np.searchsorted(bucket[by], np.arange(self.buckets + 1))

        (by, at_), (block_by, block_at) = dealt(h), dealt(block)
        rows = []
        for b in range(self.buckets):
            mine, blocks = by[at_[b] : at_[b + 1]], block_by[block_at[b] : block_at[b + 1]]
            rows.append((host, b, cut, len(self.pages), int(again[mine].sum()), h[mine].tobytes(), block[blocks].tobytes(), count[blocks].astype(np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), CELL_TYPES, strict=True)], CELL_NAMES)


CELL_NAMES = ["host", "bucket", "cut", "pages", "again", "runs", "blocks", "counts"]
CELL_TYPES = [pa.string(), *[pa.int64()] * 4, *[pa.binary()] * 3]


def repeated_marks(shards: DataFrame, run: int) -> DataFrame:
    """(host, cut, runs, blocks): hashes of what repeats over the host, for each shard that has them.

    shards: the pages, each shard together.  A page is in one shard only, so
    what two shards have stands on two pages, and pages add up.  Hosts of one
    shard are left out.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, marks = None, None
        for key, rows in _groups(batches, ("host", "cut")):
            if key != here:
                if marks:
                    yield marks.cells(*here)
                here, marks = key, None
            if rows is not None and (cuts := rows.column("cuts")[0].as_py()):
                marks = marks or ShardMarks(cuts)
                for i in range(0, rows.num_rows, 256):
                    marks.add(rows.slice(i, 256), run)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, parts = None, []
        for key, rows in _groups(batches, ("host", "bucket")):
            if key != here:
                if parts:
                    yield shared(here[0], pa.Table.from_batches(parts))
                here, parts = key, []
            if rows is not None:
                parts.append(rows)

    def shared(host: str, cells: pa.Table) -> pa.RecordBatch:
        cut, again = cells.column("cut").to_pylist(), cells.column("again").to_numpy()
        runs, blocks = _numbers(cells.column("runs")), _numbers(cells.column("blocks"))
        size = np.array([len(r) for r in runs])
        h = _joined(runs)
        twice = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size) < np.repeat(again, size)
        order = np.argsort(h, kind="stable")
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[order][1:] != h[order][:-1]]))
        n = np.diff(np.append(start, len(h)))
        keep = np.zeros(len(h), bool)
        keep[order] = np.repeat((n > 1) | (np.maximum.reduceat(twice[order], start) if len(start) else False), n)
        often = common(_joined(blocks), _joined(_numbers(cells.column("counts"))), int(cells.column("pages").to_numpy().sum()))
        out = [(c, r[k], b[np.isin(b, often)]) for c, r, k, b in zip(cut, runs, np.split(keep, np.cumsum(size)[:-1]), blocks, strict=True)]
        out = [(host, c, r.tobytes(), b.tobytes()) for c, r, b in out if len(r) or len(b)]
        types = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], ["host", "cut", "runs", "blocks"])

    found = shards.mapInArrow(emit, "host string, bucket long, cut long, pages long, again long, runs binary, blocks binary, counts binary")
    return found.repartition("host", "bucket").sortWithinPartitions("host", "bucket").mapInArrow(meet, "host string, cut long, runs binary, blocks binary")


def _cut(parsed: DataFrame, sizes: DataFrame) -> DataFrame:
    """parsed with the shards of its host (cuts, 0 if one) and its own (cut).

    The table of cut hosts goes by the driver, so pages are sized once, and is
    broadcast if it has at most ``HOSTS`` rows; else its largest hosts are, and
    the others, of at most ``LARGE`` shards each, meet their parsed blocks by a
    shuffle.
    """
    hot = sizes.filter(F.col("n") > 1).select(F.col("host").alias("hot"), "n")
    if (few := hot.limit(HOSTS + 1).toArrow()).num_rows <= HOSTS:
        met = parsed.join(F.broadcast(parsed.sparkSession.createDataFrame(few, hot.schema)), F.col("host") == F.col("hot"), "left")
    else:
        largest = F.broadcast(hot.filter(F.col("n") > LARGE))
        rest = parsed.join(largest.select("hot"), F.col("host") == F.col("hot"), "left_anti")
        met = parsed.join(largest, F.col("host") == F.col("hot")).unionByName(rest.join(hot.filter(F.col("n") <= LARGE), F.col("host") == F.col("hot"), "left"))
    cut = F.coalesce(F.pmod(F.xxhash64("page_key"), F.col("n")), F.lit(0))  # by the page's id alone, so all its rows are in one shard
    return met.withColumn("cut", cut).withColumn("cuts", F.coalesce("n", F.lit(0))).drop("hot", "n")


def extract(pages: DataFrame, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", run: int = RUN, shard: int = SHARD) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_repeated of every page."""
    id_type, url_type = (pages.schema[c].dataType.simpleString() for c in (id_column, url_column))
    source = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.coalesce(host_of(url_column), F.lit("")).alias("host"), F.xxhash64(id_column).alias("page_key"), F.col(html_column).alias("text"))
    cuts = F.greatest(F.ceil(F.count("*") / shard), F.ceil(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / SHARD_BYTES))

    def read(part: pa.RecordBatch) -> list[pa.Array]:
        whole, texts = [], []
        for t in at.as_bytes(part.column("text")).to_pylist():
            found = blocks(t.decode("utf-8", "replace"))
            whole.append(any(r == "M" for r, _ in found))
            texts.append([t for r, t in found if r == ("M" if whole[-1] else "U")])
        return [pa.array(whole, pa.bool_()), pa.array(texts, pa.list_(pa.string()))]

    kept = ["page_id", "url", "host", "page_key"]
    parsed = tm.map_slices(source, f"page_id {id_type}, url {url_type}, host string, page_key long, whole boolean, blocks array<string>", read, kept)
    shards = _cut(parsed, source.groupBy("host").agg(cuts.alias("n"))).repartition("host", "cut").sortWithinPartitions("host", "cut")

    def finish(rows: pa.Table, found: pa.Table) -> pa.Table:
        known = tuple(np.unique(_joined(_numbers(found.column(c)))) for c in ("runs", "blocks")) if rows.num_rows and rows.column("cuts")[0].as_py() else None
        done = main_texts(*(rows.column(c).to_pylist() for c in ("page_key", "whole", "blocks")), run, known)
        counts = [pa.array([x[k] for x in done], pa.int64()) for k in (1, 2)]
        texts = pa.array([t for t, _, _ in done], pa.string())
        return pa.table([rows.column("page_id"), rows.column("url"), texts, pa.array([len(t) for t, _, _ in done], pa.int64()), *counts], ["page_id", "url", "text", "n_chars", "n_blocks", "n_repeated"])

    marks = repeated_marks(shards, run)
    return shards.groupBy("host", "cut").cogroup(marks.groupBy("host", "cut")).applyInArrow(finish, f"page_id {id_type}, url {url_type}, text string, n_chars long, n_blocks long, n_repeated long")
