"""Operator 5: benchmark decontamination with a generalised suffix automaton.

Benchmark items become sequences of word numbers and one automaton of all their substrings.
A document's words are streamed through it; the automaton's state gives the longest suffix of
the words read so far that some item contains. A window of 13 words ends wherever that length
reaches 13, and a short item ends wherever the state's suffix chain holds the whole of it.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, short_batches, table

#: Words of a window; an item with fewer words, but not none, is one window.
WINDOW = 13
#: A document is contaminated if its hit words are at least this share: 1 of 20.
SHARE = 20
#: Benchmark words of one automaton; more are split into several, each broadcast by itself.
BLOCK_WORDS = 1_000_000
#: Words of all items together; at some 50 bytes each, what a worker holds is bounded.
MOST_WORDS = 4_000_000

_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lowered) and non-ASCII characters, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class SuffixAutomaton:
    """All substrings of the items, while it is built. A state's first step is kept in two arrays;
    further steps of branching states in dicts. ``marks[s]`` are numbers of items with a whole
    window of 13 words at state ``s``, ``short[s]`` are (length, item number) of short items."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.code, self.to, self.link, self.length = (array("i", [x]) for x in (-1, -1, -1, 0))
        self.more: dict[int, dict[int, int]] = {}
        self.marks: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}

    def _step(self, s: int, c: int) -> int:
        if self.code[s] == c:
            return self.to[s]
        return self.more[s].get(c, -1) if s in self.more else -1

    def _set(self, s: int, c: int, t: int) -> None:
        if self.code[s] in (-1, c):
            self.code[s], self.to[s] = c, t
        else:
            self.more.setdefault(s, {})[c] = t

    def _state(self, length: int, link: int) -> int:
        for held, x in ((self.code, -1), (self.to, -1), (self.link, link), (self.length, length)):
            held.append(x)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """A copy of ``q`` for the shorter strings that reach it from ``p`` by ``c``."""
        copy = self._state(self.length[p] + 1, self.link[q])
        self.code[copy], self.to[copy] = self.code[q], self.to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        while p >= 0 and self._step(p, c) == q:
            self._set(p, c, copy)
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self._step(last, c)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p >= 0 and self._step(p, c) < 0:
            self._set(p, c, new)
            p = self.link[p]
        if p >= 0:
            q = self._step(p, c)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def build(self, items: list[tuple[object, list[bytes]]]) -> Automaton:
        coded = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        for ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        for item, ids in enumerate(coded):
            size = min(self.window, len(ids))
            s = n = 0
            for c in ids:  # the state of the last `size` words, at most
                s, n = self._step(s, c), n + 1
                while self.length[self.link[s]] >= size:
                    s = self.link[s]
                if n >= size:
                    if size == self.window:
                        self.marks.setdefault(s, set()).add(item)
                    else:
                        self.short.setdefault(s, []).append((size, item))
        return self._packed([i for i, _ in items])

    def _packed(self, names: list) -> Automaton:
        n = len(self.code)
        first, codes, to = array("i", [0]), array("i"), array("i")
        for s in range(n):
            steps = {self.code[s]: self.to[s]} if self.code[s] >= 0 else {}
            for c, t in sorted((steps | self.more.get(s, {})).items()):
                codes.append(c)
                to.append(t)
            first.append(len(codes))
        near = array("i", [-1]) * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            near[s] = s if s in self.short else near[self.link[s]]
        short = {s: sorted(set(x), reverse=True) for s, x in self.short.items()}
        return Automaton(self.window, self.vocab, first, codes, to, self.link, self.length, near, self.marks, short, names)


@dataclass
class Automaton:
    """A finished automaton: steps of state ``s`` are ``codes`` and ``to`` from ``first[s]`` to
    ``first[s + 1]``, by code; ``near[s]`` is the first state on the suffix chain at which a short
    item ends, or -1. About 50 bytes a benchmark word."""

    window: int
    vocab: dict[bytes, int]
    first: array
    codes: array
    to: array
    link: array
    length: array
    near: array
    marks: dict[int, set[int]]
    short: dict[int, list[tuple[int, int]]]
    names: list

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Hit spans [start, end) of the document's words, merged, in order; items that occur."""
        spans: list[list[int]] = []
        whole: set[int] = set()  # states of whole windows; their items are united once
        found: set[int] = set()
        code, first, codes, to, link, length, near, window = self.vocab.get, self.first, self.codes, self.to, self.link, self.length, self.near, self.window
        s = n = 0
        for i, w in enumerate(ws, 1):
            c = code(w)
            if c is None:
                s = n = 0
                continue
            while s:
                low, high = first[s], first[s + 1]
                if high - low > 1:
                    low = bisect_left(codes, c, low, high)
                if low < high and codes[low] == c:
                    s, n = to[low], n + 1
                    break
                s = link[s]
                n = length[s]
            else:  # every word of the vocabulary is a step from the root, whose steps are in order
                s, n = to[c], 1
            while n > window and length[link[s]] >= window:
                s = link[s]
                n = length[s]
            width = 0
            if n >= window:
                width = window
                at = s
                while length[link[at]] >= window:
                    at = link[at]
                if at in self.marks:
                    whole.add(at)
            at = near[s]
            while at >= 0:
                for size, item in self.short[at]:
                    if size <= n:
                        width = max(width, size)
                        found.add(item)
                at = near[link[at]]
            if width:
                if spans and spans[-1][1] >= i - width:
                    spans[-1] = [min(spans[-1][0], i - width), i]
                    while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                        start, _ = spans.pop(-2)
                        spans[-1][0] = min(spans[-1][0], start)
                else:
                    spans.append([i - width, i])
        for at in whole:
            found |= self.marks[at]
        return [(a, b) for a, b in spans], {self.names[x] for x in found}


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, most_words: int = MOST_WORDS) -> list[Automaton]:
    """Automata over the benchmark's items, ``block_words`` words each at most (an item is not
    divided). Null ids and texts without words have no window. A benchmark is a fixed test set that
    does not grow with the corpus; one of over ``most_words`` words is an error, since all blocks
    are held by every worker: divide it and clean the corpus by one part after the other."""
    out, items, size, total = [], [], 0, 0
    for row in benchmark.select("item_id", "text").where(F.col("item_id").isNotNull()).toLocalIterator():
        ws = words(row["text"])
        total += len(ws)
        if total > most_words:
            raise ValueError(f"the benchmark has more than {most_words} words")
        if items and size + len(ws) > block_words:
            out.append(SuffixAutomaton(window).build(items))
            items, size = [], 0
        if ws:
            items.append((row["item_id"], ws))
            size += len(ws)
    return [*out, SuffixAutomaton(window).build(items)] if items else out


def _merged(parts: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(x for part in parts for x in part):
        if out and out[-1][1] >= a:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


class _Scanner:
    def __init__(self, shared: list):
        self.shared = shared

    def __call__(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        if len(self.shared) == 1:
            return self.shared[0].value.scan(ws)
        got = [b.value.scan(ws) for b in self.shared]
        return _merged([g[0] for g in got]), set().union(*(g[1] for g in got))


def _shared(docs: DataFrame, benchmark: DataFrame) -> _Scanner:
    return _Scanner([docs.sparkSession.sparkContext.broadcast(a) for a in automata(benchmark)])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document.

    Nulls: a null text has no words; a null doc_id stays null; a null item or one without words
    is no window. Repeated rows give repeated results, repeated items count by their ids. Very
    long texts are streamed in time linear in their words. Empty tables: no documents, no rows;
    no benchmark, no hits. Other columns are not read.
    """
    scan = _shared(docs, benchmark)

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")}
        for text in batch.column("text").to_pylist():
            ws = words(text)
            spans, items = scan(ws)
            hit = sum(b - a for a, b in spans)
            out["n_words"].append(len(ws))
            out["n_hit"].append(hit)
            out["n_items"].append(len(items))
            out["items_sha256"].append(hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest())
            out["contaminated"].append(contaminated(hit, len(ws)))
        return out | {"doc_id": batch.column("doc_id")}

    return map_arrow(
        docs.select("doc_id", "text"),
        run,
        "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    )


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and what stands between words of one span."""
    data = text.encode("utf-8", "surrogatepass")
    flat = data.translate(_WORD_BYTES)
    starts, ends, at = [], [], 0
    for w in flat.split():
        at = flat.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : starts[a]])
        last = ends[b - 1]
    out.append(data[last:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without benchmark passages, columns as in ``docs``.

    A document whose hit words reach the coverage limit (1 in 20) is removed; from any other,
    spans of 13 or more words that a benchmark holds (or a whole short item) are cut out of
    ``text`` and ``n_chars``, if there is such a column, is set anew. Clean documents are not
    touched. Nulls as in :func:`report`.
    """
    scan = _shared(docs, benchmark)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts, keep, changed = batch.column("text").to_pylist(), [], {}
            for i, text in enumerate(texts):
                ws = words(text)
                spans, _ = scan(ws)
                keep.append(not contaminated(sum(b - a for a, b in spans), len(ws)))
                if spans and keep[-1]:
                    changed[i] = _without(text, spans)
            if changed:
                cols = {n: batch.column(n) for n in batch.schema.names}
                new = [changed.get(i, t) for i, t in enumerate(texts)]
                cols["text"] = pa.array(new, batch.schema.field("text").type)
                if "n_chars" in cols:
                    was = cols["n_chars"].to_pylist()
                    cols["n_chars"] = pa.array([len(new[i]) if i in changed else x for i, x in enumerate(was)], batch.schema.field("n_chars").type)
                batch = pa.RecordBatch.from_arrays(list(cols.values()), schema=batch.schema)
            yield batch.filter(pa.array(keep, pa.bool_()))

    short_batches(docs.sparkSession)
    return docs.mapInArrow(run, schema)


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document; see :func:`report`."""
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN ks WHERE len(w) >= k)),
hits AS (SELECT g.doc_id, g.k, g.i, w.item_id FROM grams g JOIN win w ON g.g = w.g AND g.k = w.k),
n_hits AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(list, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w)) AS contaminated
FROM d LEFT JOIN n_hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
