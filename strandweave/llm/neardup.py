"""Operator 1: near-duplicate documents by bottom-k sketches of one hash function.

1. A document's set of distinct 5-word shingles is hashed with one 64-bit function; its sketch is
   the K smallest hashes. Documents of equal sets form a class and go on as one.
2. Inverted lists of retained values: two sets with a Jaccard index of 0.75 or more share well
   over 0.4 of their sketches, so they share a value among the rarest 0.6 of each sketch (plus
   one), the prefix that is listed. Rare values first means that a passage which thousands of
   documents quote is listed only for documents made up of such passages.
3. Every list is compared with its most central member, the one whose values are listed most, which
   joins most groups of copies. What links join becomes components (alternating stars).
4. Lists that still lie in several components are merged by their most central member, and cut into
   bands of set sizes, as linked sizes differ by a factor of 0.75 at most. In each band the members
   outside of the group's largest component are a query set against all its members, in blocks:
   a task holds two blocks at a time, whatever the group's size, and a block of queries gives at
   most one row per component that it joins.
5. In a block, pairs of fitting sizes and different components must pass the estimate from the
   union of their sketches (up to where both are complete), then the exact index on full sets.

Steps 3 and 4 compare every pair that shares a listed value, so what can be missed is a linked pair
whose sketches share under 0.5 (candidates) or whose union's sketch has under 0.53 in common: 4.6 and
4.0 standard deviations below the mean for a pair right at 0.75 with K = 64. Sets of up to K shingles
are their own sketches and never missed; with ``k=None`` sets are kept whole and none is missed at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from ..session import small_or_not
from .common import map_arrow, short_batches, table, written

WORDS = 5
K = 64
#: Similarity in percent.
PERCENT = 75
#: Share of a sketch that two linked documents have in common at least.
COMMON = 0.5
#: Share of the union's sketch below which a pair is not verified.
ESTIMATE = 0.53
#: Members and shingles (8 bytes each) of a block; a task holds two blocks. One set may be larger.
BLOCK_ROWS = 256
BLOCK_SHINGLES = 1_000_000
#: Documents, and BLOCK_SHINGLES shingles, for each file of a table between two steps.
FILE_DOCS = 5000
#: Pairs of two blocks that are intersected one by one rather than by a matrix product.
FEW_PAIRS = 500

_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, cache: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct int64 hashes of the 5-word shingles; A-Z lowered, words between ASCII
    white space. Fewer words, but not none, are one shingle; null and empty texts have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    if len(words) < WORDS:
        return _mixed(np.array([xxhash.xxh64_intdigest(b"\0".join(words), len(words))], np.uint64)).view(np.int64)
    cache = {} if cache is None else cache
    codes = []
    for w in words:
        c = cache.get(w)
        if c is None:
            c = cache[w] = xxhash.xxh64_intdigest(w)
        codes.append(c)
    h = np.array(codes, np.uint64)
    n = len(h) - WORDS + 1
    out = h[:n] * _C[0]
    for j in range(1, WORDS):
        out = out + h[j : n + j] * _C[j]
    return np.unique(_mixed(out).view(np.int64))


def sketches(docs: DataFrame, k: int | None = K) -> DataFrame:
    """doc_id, n (set size), set_key (128-bit digest of the set), sketch (its ``k`` least hashes, all
    with None), and text_key if ``docs`` has it."""
    more = [c for c in ("text_key",) if c in docs.columns]

    def run(batch: pa.RecordBatch) -> dict:
        cache: dict[bytes, int] = {}
        n, keys, parts = [], [], []
        for text in batch.column("text"):
            s = shingle_set(text.as_py(), cache)
            if len(cache) > 100_000:
                cache.clear()
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            parts.append(s[:k])
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))
        return {"doc_id": batch.column("doc_id"), "n": n, "set_key": keys, "sketch": flat} | {c: batch.column(c) for c in more}

    schema = "doc_id bigint, n bigint, set_key binary, sketch array<bigint>"
    return map_arrow(docs.select("doc_id", "text", *more), run, ", ".join([schema, *(f"{c} binary" for c in more)]))


def _files(sketched: DataFrame) -> int:
    """Files that a table between two steps, and the result, have at most, so that few documents are
    not dealt over as many files as a shuffle has partitions. For each file on a ``file:`` path the
    executor's JVM starts processes (chmod, without Hadoop's native library)."""
    docs, shingles = sketched.agg(F.count(F.lit(1)), F.sum("n")).first()
    return max(1, -(-docs // FILE_DOCS), -(-(shingles or 0) // BLOCK_SHINGLES))


def _classes(sketched: DataFrame, files: int) -> DataFrame:
    """cid, rep (least doc_id), n, set_key, sketch: one row per distinct non-empty set."""
    return written(
        sketched.where("n > 0")
        .groupBy("set_key")
        .agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        .coalesce(files)
        .select(F.monotonically_increasing_id().alias("cid"), "rep", "n", "set_key", "sketch")
    )


def _lists(classes: DataFrame, k: int | None, files: int) -> DataFrame:
    """cid, n, central, vs: the rarest sketch values of each class that other classes
    retain too; classes without any are left out. ``central`` is how often a class's values occur
    in all: the original of many copies has most."""
    values = classes.select("cid", "n", F.explode("sketch").alias("v"))
    # written, so that the join is of two plain shuffles, in which a value of very many sketches can be split
    shared = small_or_not(written(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1").coalesce(files)))
    lists = (
        values.join(shared, "v")
        .groupBy("cid")
        .agg(F.first("n").alias("n"), F.sum("df").alias("central"), F.sort_array(F.collect_list(F.struct("df", "v"))).alias("l"))
    )
    size = (F.col("n") if k is None else F.least(F.col("n"), F.lit(k))).cast("int")
    prefix = size - F.ceil(size * COMMON).cast("int") + 1
    kept = F.slice("l", F.lit(1), F.greatest(prefix - (size - F.size("l")), F.lit(0)))
    return written(lists.select("cid", "n", "central", F.transform(kept, lambda x: x.v).alias("vs")).where("size(vs) > 0").coalesce(files))


def _sets(lists: DataFrame, classes: DataFrame, docs: DataFrame, files: int) -> DataFrame:
    """cid, set (sorted int64 hashes) of the classes in ``lists``, from one scan of the documents."""
    need = classes.select("cid", F.col("rep").alias("doc_id"), "set_key").join(small_or_not(lists.select("cid")), "cid")
    need = small_or_not(written(need.coalesce(files)))

    def own(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"cid": [], "set": []}
        cache: dict[bytes, int] = {}
        for cid, key, text in zip(*(batch.column(c) for c in ("cid", "set_key", "text")), strict=True):
            made = shingle_set(text.as_py(), cache).tobytes()
            if len(cache) > 100_000:
                cache.clear()
            if xxhash.xxh3_128_digest(made) == key.as_py():  # ids may repeat with other texts
                out["cid"].append(cid.as_py())
                out["set"].append(made)
        return out

    wanted = docs.select("doc_id", "text").join(need, "doc_id")
    return written(map_arrow(wanted, own, "cid bigint, set binary").dropDuplicates(["cid"]).coalesce(files))


# ---------------------------------------------------------------- blocks


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    flat_b, rows_b = np.concatenate(b), np.repeat(np.arange(len(b)), [len(x) for x in b])
    if len(a) <= 4:
        for i, x in enumerate(a):
            if len(x):
                at = np.minimum(np.searchsorted(x, flat_b), len(x) - 1)
                out[i] = np.bincount(rows_b[x[at] == flat_b], minlength=len(b))
        return out
    flat_a, rows_a = np.concatenate(a), np.repeat(np.arange(len(a)), [len(x) for x in a])
    both = np.intersect1d(flat_a, flat_b)
    at_a, at_b = np.searchsorted(both, flat_a), np.searchsorted(both, flat_b)
    for first in range(0, len(both), 4096):
        part = both[first : first + 4096]

        def shown(flat: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
            col = at - first
            ok = (col >= 0) & (col < len(part))
            ok[ok] = part[col[ok]] == flat[ok]
            m = np.zeros((n, len(part)), np.float32)
            m[rows[ok], col[ok]] = 1
            return m

        out += (shown(flat_a, rows_a, at_a, len(a)) @ shown(flat_b, rows_b, at_b, len(b)).T).astype(np.int64)
    return out


def _estimates(a: list[np.ndarray], b: list[np.ndarray], k: int | None) -> np.ndarray:
    """Which pairs the union of their sketches lets pass, up to the value where both are complete;
    exact where both sets are no larger than a sketch."""
    sa, sb = [x[:k] for x in a], [x[:k] for x in b]
    whole = np.iinfo(np.int64).max
    ends_a, ends_b = (np.array([whole if k is None or len(x) <= k else x[k - 1] for x in y]) for y in (a, b))
    in_a = np.stack([np.searchsorted(s, np.minimum(e, ends_b), "right") for s, e in zip(sa, ends_a, strict=True)])
    in_b = np.stack([np.searchsorted(s, np.minimum(e, ends_a), "right") for s, e in zip(sb, ends_b, strict=True)], axis=1)
    common = _overlaps(sa, sb)
    union = in_a + in_b - common
    exact = (ends_a == whole)[:, None] & (ends_b == whole)[None, :]
    return np.where(exact, common * 100 >= union * PERCENT, common >= union * ESTIMATE)


def _linked(both, na, nb):
    return 100 * both >= PERCENT * (na + nb - both)


def _block_links(queries: list[tuple], members: list[tuple], k: int | None) -> Iterator[tuple[int, int]]:
    """Links (cid, cid) of queries with members, both (cid, comp, set): for each query one with
    every other component that it is linked with, less those that join nothing more."""
    qs, ms = [x[2] for x in queries], [x[2] for x in members]
    q_comp, m_comp = (np.array([x[1] for x in side]) for side in (queries, members))
    nq, nm = (np.array([len(x) for x in side]) for side in (qs, ms))
    small, large = np.minimum(nq[:, None], nm[None, :]), np.maximum(nq[:, None], nm[None, :])
    open_ = (q_comp[:, None] != m_comp[None, :]) & (small * 100 >= large * PERCENT)
    rows, cols = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
    if not len(rows):
        return
    ok = open_[np.ix_(rows, cols)] & _estimates([qs[i] for i in rows], [ms[j] for j in cols], k)
    pairs = [(rows[i], cols[j]) for i, j in zip(*np.nonzero(ok), strict=True)] if ok.sum() <= FEW_PAIRS else None
    if pairs is None:
        keep_r, keep_c = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
        rows, cols, ok = rows[keep_r], cols[keep_c], ok[np.ix_(keep_r, keep_c)]
        ok &= _linked(_overlaps([qs[i] for i in rows], [ms[j] for j in cols]), nq[rows][:, None], nm[cols][None, :])
        pairs = ((rows[i], cols[j]) for i, j in zip(*np.nonzero(ok), strict=True))
    else:
        pairs = ((i, j) for i, j in pairs if _linked(len(np.intersect1d(qs[i], ms[j], assume_unique=True)), nq[i], nm[j]))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    for i, j in pairs:
        x, y = find(int(q_comp[i])), find(int(m_comp[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            yield queries[i][0], members[j][0]


def _compared(members: DataFrame, queries: DataFrame, sets: DataFrame, k: int | None, files: int) -> DataFrame:
    """(u, v): links of the queries with the members of the same group and band. Both have g, f
    (group, band), cid, comp, n. Every group is dealt out in blocks of members times blocks of
    queries by hash of cid, so that a hot group is many units of bounded size."""

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        count = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
        return rows.groupBy("g", "f").agg(count.cast("int").alias(name))

    dealt = small_or_not(written(blocks(members, "mb").join(blocks(queries, "qb"), ["g", "f"]).coalesce(files)))
    own = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["g", "f", "qi", "mi", "role"]
    q = queries.join(dealt, ["g", "f"]).select("*", own("qb").alias("qi"), each("mb").alias("mi"), F.lit(0).alias("role"))
    m = members.join(dealt, ["g", "f"]).select("*", each("qb").alias("qi"), own("mb").alias("mi"), F.lit(1).alias("role"))
    rows = q.select(*keys, "cid", "comp").unionByName(m.select(*keys, "cid", "comp")).join(sets, "cid")
    schema = "u bigint, v bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, ([], [])

        def links() -> pa.RecordBatch:
            found = list(_block_links(*held, k)) if held[0] and held[1] else []
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            names = [batch.column(c).to_pylist() for c in (*keys, "cid", "comp")]
            for g, f, qi, mi, role, cid, comp, made in zip(*names, batch.column("set"), strict=True):
                if unit != (g, f, qi, mi):
                    if unit is not None:
                        yield links()
                    unit, held = (g, f, qi, mi), ([], [])
                held[role].append((cid, comp, np.frombuffer(made.as_buffer(), np.int64)))
            pa.default_memory_pool().release_unused()
        if unit is not None:
            yield links()

    short_batches(rows.sparkSession)
    return rows.repartition("g", "f", "qi", "mi").sortWithinPartitions(*keys).select(*keys, "cid", "comp", "set").mapInArrow(run, schema)


def _with_heads(lists: DataFrame, sets: DataFrame, k: int | None, files: int) -> DataFrame:
    """Links of every list's members with its most central one."""
    members = lists.select("cid", "n", "central", F.explode("vs").alias("v"))
    heads = members.groupBy("v").agg(F.max(F.struct("central", "cid", "n")).alias("h"), F.count(F.lit(1)).alias("m")).where("m > 1")
    heads = small_or_not(written(heads.select("v", F.col("h.cid").alias("g"), F.col("h.n").alias("gn")).coalesce(files)))
    fits = F.least("n", "gn") * 100 >= F.greatest("n", "gn") * PERCENT
    met = members.join(heads, "v").where((F.col("cid") != F.col("g")) & fits)
    met = written(met.select("g", F.lit(0).alias("f"), "cid", F.col("cid").alias("comp"), "n", "gn").distinct().coalesce(files))
    queries = met.select("g", "f", F.col("g").alias("cid"), F.col("g").alias("comp"), F.col("gn").alias("n")).distinct()
    return _compared(met.drop("gn"), queries, sets, k, files)


def _with_all(lists: DataFrame, labels: DataFrame, sets: DataFrame, k: int | None, files: int) -> DataFrame:
    """Links across components between members of one list, by group and band (step 4)."""
    known = lists.join(small_or_not(labels.withColumnRenamed("a", "cid")), "cid", "left")
    members = known.select("cid", "n", "central", F.coalesce("b", "cid").alias("comp"), F.explode("vs").alias("v"))
    ends = members.groupBy("v").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.struct("central", "cid")).alias("h"))
    heads = small_or_not(written(ends.where("low <> high").select("v", F.col("h.cid").alias("g")).coalesce(files)))
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT))).cast("int")
    met = written(members.join(heads, "v").select("g", band.alias("f"), "cid", "comp", "n").distinct().coalesce(files))
    largest = met.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("g").agg(F.max(F.struct("c", "comp")).alias("x"))
    largest = small_or_not(written(largest.select("g", F.col("x.comp").alias("main")).coalesce(files)))
    # rounding may put a pair at the very limit two bands apart: one more is looked at on each side
    bands = F.explode(F.sequence(F.col("f") - 2, F.col("f") + 2))
    queries = met.join(largest, "g").where("comp <> main").select("g", bands.alias("f"), "cid", "comp", "n")
    return _compared(met, queries, sets, k, files)


def class_labels(classes: DataFrame, docs: DataFrame, k: int | None, files: int) -> DataFrame:
    """(a, b): component of every class that has one of other classes too."""
    lists = _lists(classes, k, files)
    sets = _sets(lists, classes, docs, files)
    labels = components(_with_heads(lists, sets, k, files), files)
    # distinct, so that the blocks are compared in as many tasks as there are partitions
    links = written(_with_all(lists, labels, sets, k, files).distinct().coalesce(files))
    if links.isEmpty():
        return labels
    return components(links.unionByName(labels.select(F.col("a").alias("u"), F.col("b").alias("v"))), files)


def near_duplicates(docs: DataFrame, k: int | None = K) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Linked are documents with 100 * intersection >= 75 * union of their shingle sets; components
    are what links reach. ``k`` is the size of a sketch; None keeps whole sets, which misses no link
    but lists and moves every shingle. Nulls: a null text has no shingles and is linked with nothing; a row
    with a null doc_id is returned with a null component_id and kept. Repeated rows (of one id)
    are all returned alike; of several texts under one id each has the component of its text.
    Very long texts are read whole. An empty table gives no rows. Other columns are not read.
    """
    out = _grouped(docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text"), k)[0].select("doc_id", "n_shingles", "component_id", "kept")
    lost = sketches(docs.where(F.col("doc_id").isNull()).select("doc_id", "text")).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(lost)


def _grouped(known: DataFrame, k: int | None = K) -> tuple[DataFrame, int]:
    """doc_id, n_shingles, component_id, kept of rows with an id, and ``group``: one binary per
    component, null without shingles. Two components may have one component_id if one id has
    several texts. text_key is handed on. And the bound on a table's files (:func:`_files`)."""
    more = [c for c in ("text_key",) if c in known.columns]
    sketched = written(sketches(known, k))
    files = _files(sketched)
    classes = _classes(sketched, files)
    labels = small_or_not(class_labels(classes, known, k, files).withColumnRenamed("a", "cid"))
    named = classes.select("cid", "rep", "set_key").join(labels, "cid", "left").withColumn("comp", F.coalesce("b", "cid"))
    named = written(named.select("set_key", "rep", "comp").coalesce(files))
    least = small_or_not(written(named.groupBy("comp").agg(F.min("rep").alias("component_id")).coalesce(files)))
    reach = written(named.join(least, "comp").select("set_key", "component_id", F.col("comp").cast("string").cast("binary").alias("group")).coalesce(files))
    out = sketched.select("doc_id", F.col("n").alias("n_shingles"), "set_key", *more).join(reach, "set_key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), "group", *more)
    return out.coalesce(files), files


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, all columns as they are: the one of the least doc_id, and of
    several texts under that id in one group the one of the least md5. Texts of one id in
    different groups are judged each by its group. Rows with a null doc_id stay, copies too; of
    repeated rows with one doc_id and text, one stays."""
    # no column of the table may have the name of the key
    key = next(n for n in ("text_key" + "_" * i for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    text_key = F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.lit(b""))
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(key, text_key)
    groups, files = _grouped(named.select("doc_id", "text", F.col(key).alias("text_key")))
    groups = written(groups.select("doc_id", "text_key", "kept", "group"))
    own = F.coalesce("group", F.concat(F.lit(b"-"), F.col("doc_id").cast("string").cast("binary"), F.lit(b" "), F.col("text_key")))
    kept = groups.where("kept").groupBy(own.alias("g")).agg(F.min(F.struct("doc_id", "text_key")).alias("x"))
    kept = kept.select("x.*").distinct().withColumn("one", F.lit(True))
    rows = groups.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).join(kept, ["doc_id", "text_key"], "left")
    # most documents stay and occur once: the others are named, so that most texts need no shuffle
    other = written(rows.where("one is null or n > 1").select("doc_id", F.col("text_key").alias(key), "one").coalesce(files))
    once = named.join(small_or_not(other.drop("one")), ["doc_id", key], "left_anti")
    more = named.join(small_or_not(other.where("one").drop("one")), ["doc_id", key], "left_semi").dropDuplicates(["doc_id", key])
    return once.unionByName(more).select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def op1_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents; see :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
keys AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
rep AS (SELECT k, min(doc_id) AS rep FROM keys GROUP BY k),
rs AS (SELECT s.doc_id, s.g FROM s JOIN rep ON s.doc_id = rep.rep),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM rs a JOIN rs b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, c) AS (SELECT rep, rep FROM rep UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v),
c AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, w.doc_id) AS component_id, (w.doc_id = coalesce(c.c, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN keys USING (doc_id) LEFT JOIN rep USING (k) LEFT JOIN c ON c.v = rep.rep
"""
