"""Containment distances between sequences, contained clusters and clustering quality."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..session import small_or_not, written

#: Pairs within unitigs that one block of sequences comes first in, at about most, and the pairs that a sequence in a
#: list counts as besides; blocks that small groups of keys are dealt out to.
BLOCK_PAIRS, SET_UP, MOST_BLOCKS = 1 << 26, 7, 2000
#: Draws of sequences per block, to set its bounds; ids in a row of lists and ids that leave Python at once; pairs summed at once.
DRAWS, PACKED, SENT, SUMMED = 16, 1 << 10, 1 << 20, 1 << 18
WHOLE = ("tinyint", "smallint", "int", "bigint")


def _lists(members: DataFrame, keys: list[str], seq: str, unitig: str, length: str) -> DataFrame:
    """keys, w, c, without: a unitig's length, the sorted *set* of its sequences, and whether rows
    without a sequence have it too. Written, since it is read three times."""
    held = members.where(F.col(unitig).isNotNull())
    for k in keys:
        held = held.where(F.col(k).isNotNull())
    s = F.col(seq)
    own = held.groupBy(*keys, F.col(unitig).alias("u")).agg(F.max(length).alias("w"), F.sort_array(F.collect_set(s)).alias("c"), F.max(s.isNull()).alias("without"))
    return written(own.drop("u"))


def _cuts(totals: DataFrame, keys: list[str]) -> dict[tuple, list]:
    """By keys (small groups may lack), the first sequence of each block but the first; blocks come first in
    about as many pairs each. They are set by a few draws of sequences, weighted by their pairs; where a block
    ends changes no result."""
    grain = BLOCK_PAIRS / DRAWS
    draws = F.floor(F.col("p") / grain + F.pmod(F.xxhash64("s"), F.lit(1 << 20)) / (1 << 20))
    cuts, full = defaultdict(list), defaultdict(int)
    for *key, s, n in totals.select(*keys, "s", draws.alias("n")).where("n > 0").orderBy(*keys, "s").collect():
        k = tuple(key)
        if full[k] and full[k] + n > DRAWS:
            cuts[k].append(s)
            full[k] = 0
        full[k] += n
    return {k: cuts[k] for k in full}


def _in_blocks(lists: DataFrame, keys: list[str], cuts: dict[tuple, list], tasks: int, low: int, kind: T.DataType | None) -> DataFrame:
    """keys, task, w, m, size, near (, first): many lists in a row, and each once per block of sequences in it, from
    the block's first on: its length ``w``, how many sequences are the block's, how many there are, and all of them
    one after the other; as distances from the first less ``low``, if of a ``kind``."""
    field, whole = lists.schema["c"].dataType.elementType, isinstance(lists.schema["w"].dataType, T.LongType)
    near = [T.StructField("near", T.ArrayType(kind or field)), *([T.StructField("first", T.ArrayType(T.LongType()))] if kind else [])]
    schema = T.StructType([*(lists.schema[k] for k in keys), T.StructField("task", T.IntegerType()), T.StructField("w", T.ArrayType(T.LongType() if whole else T.DoubleType())), *(T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("m", "size")), *near])
    packed, sent = PACKED, SENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(schema)
        for batch in batches:
            lengths, flat = batch.column("c").value_lengths().to_numpy(), batch.column("c").flatten()
            ends, row, ids = np.cumsum(lengths), np.repeat(np.arange(len(lengths)), lengths), flat.to_numpy(zero_copy_only=False)
            sides, block = {k: np.array(v, dtype=ids.dtype) for k, v in cuts.items() if v}, np.zeros(len(ids), np.int64)
            named = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * len(lengths)
            for key, start, end in zip(named, ends - lengths, ends, strict=True):
                if key in sides:
                    block[start:end] = sides[key].searchsorted(ids[start:end], "right")
            codes: dict[tuple, int] = {}
            of = np.array([codes.setdefault(k, len(codes)) for k in named], np.int64)
            at = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (block[1:] != block[:-1]))[: len(ids)])
            m, size = np.diff(np.append(at, len(ids))), ends[row[at]] - at
            task = (batch.column("task").to_numpy()[row[at]] + block[at]) % tasks
            order = np.lexsort((task, of[row[at]]))
            at, m, size, task = at[order], m[order], size[order], task[order]
            stops, of = np.cumsum(size), of[row[at]]
            new = lambda x: x[1:] != x[:-1]
            heads = np.flatnonzero(np.append(True, new(task) | new(of) | new(stops // packed))[: len(at)])
            for x in np.split(heads, np.flatnonzero(new(stops[heads] // sent)) + 1) if len(at) else ():
                begin, stop = x[0], heads[np.searchsorted(heads, x[-1]) + 1] if x[-1] < heads[-1] else len(at)
                here, n = slice(begin, stop), size[begin:stop]
                bounds = np.append(x, stop) - begin
                summed = np.append(0, np.cumsum(n))
                take = np.repeat(at[here] - summed[:-1], n) + np.arange(summed[-1])
                if kind:
                    first = ids[at[here]].astype(np.int64)
                    away = pa.array(ids[take].astype(np.int64) - np.repeat(first, n) - low).cast(target.field("near").type.value_type)
                else:
                    away = flat.take(pa.array(take))
                w = batch.column("w").take(pa.array(row[at[here]]))
                inner = {"w": w, "m": pa.array(m[here]), "size": pa.array(n)} | ({"first": pa.array(first)} if kind else {})
                columns = {k: batch.column(k).take(pa.array(row[at[x]])) for k in keys} | {"task": pa.array(task[x])}
                columns |= {k: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), v.cast(target.field(k).type.value_type)) for k, v in inner.items()}
                columns["near"] = pa.ListArray.from_arrays(pa.array(summed[bounds], pa.int32()), away)
                yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in target], schema=target)

    task = F.pmod(F.xxhash64(*keys), F.lit(tasks)).cast("int") if keys else F.lit(0)
    return lists.select(*keys, task.alias("task"), "w", "c").mapInArrow(run, schema)


class _Held:
    """Lists of one group in one block; ids as numbers of distinct ids."""

    def __init__(self) -> None:
        self.w, self.known, self.m, self.size, self.codes, self.names, self.fresh, self.n = [], [], [], [], [], [], [], 0

    def add(self, w: pa.Array, m: pa.Array, size: pa.Array, ids: pa.Array) -> None:
        self.known.append(w.is_valid().to_numpy(zero_copy_only=False))
        for own, column in ((self.w, w.fill_null(0)), (self.m, m), (self.size, size)):
            own.append(column.to_numpy().copy())  # a view would keep its batch
        self.fresh.append(ids)
        self.n += len(ids)
        if self.n >= SENT:
            self.number()

    def number(self) -> None:
        found = pa.concat_arrays(self.fresh).dictionary_encode()
        self.codes.append(found.indices.to_numpy().astype(np.uint16 if len(found.dictionary) <= 1 << 16 else np.int32))
        self.names.append(found.dictionary)
        self.fresh, self.n = [], 0

    def sums(self, summed: int) -> Iterator[tuple[pa.Array, pa.Array, pa.Array]]:
        """a, b, ab in pieces, ordered by a and b."""
        self.number()
        names = pc.unique(pa.concat_arrays(self.names))
        names = names.take(pc.sort_indices(names))
        codes, at = np.empty(sum(map(len, self.codes)), np.uint16 if len(names) <= 1 << 16 else np.int32), 0
        for known in self.names:
            found = self.codes.pop(0)
            codes[at : at + len(found)] = pc.index_in(known, value_set=names).to_numpy()[found]
            at += len(found)
        del found
        w, known, m, size = map(np.concatenate, (self.w, self.known, self.m, self.size))
        self.w, self.known, self.m, self.size = [], [], [], []
        place = np.repeat((np.cumsum(size, dtype=np.int64) - size - np.cumsum(m, dtype=np.int64) + m), m) + np.arange(m.sum(dtype=np.int64))
        order = codes[place].argsort(kind="stable")
        place, of = place[order], np.repeat(np.arange(len(m), dtype=np.int32), m)[order]
        del order
        a, left = codes[place], (np.cumsum(size, dtype=np.int64)[of] - place).astype(np.int32)
        ends = np.cumsum(left, dtype=np.int64)

        def added(start: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = left[start:end]
            own = np.cumsum(n, dtype=np.int64)
            pair = np.repeat(a[start:end].astype(np.int64) << 32, n) | codes[np.repeat(place[start:end] - (own - n), n) + np.arange(own[-1])]
            return merged(pair, np.repeat(w[of[start:end]], n), np.repeat(known[of[start:end]], n))

        def merged(pair: np.ndarray, value: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = pair.argsort()
            pair = pair[order]
            heads = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
            return pair[heads], np.add.reduceat(value[order], heads), np.logical_or.reduceat(sure[order], heads)

        lasts = np.flatnonzero(np.append(a[1:] != a[:-1], True))  # of a sequence
        lasts = lasts[np.append(np.diff(ends[lasts] // summed) != 0, True)]
        for start, end in zip(np.append(0, lasts[:-1] + 1), lasts + 1, strict=True):
            long = ends[end - 1] - ends[start] > 2 * summed
            cut = [start, *(start + 1 + np.flatnonzero(np.diff(ends[start:end] // summed)) if long else ()), end]
            pair, value, sure = added(cut[0], cut[1])
            for x, y in zip(cut[1:-1], cut[2:], strict=True):
                pair, value, sure = merged(*map(np.concatenate, zip((pair, value, sure), added(x, y), strict=True)))
            yield names.take(pa.array(pair >> 32)), names.take(pa.array(pair & 0xFFFFFFFF)), pa.array(value, mask=~sure)


def _shared(lists: DataFrame, totals: DataFrame, keys: list[str], span: float | None) -> DataFrame:
    """keys, a, b, ab with a <= b: the length of the unitigs that both have. What is shuffled is a list once
    for each block of sequences that it has any of, many in a row; all sums of one block are made in one task,
    which holds the block's lists and sums some sequences' pairs at once. Ids of whole numbers (``span`` is the
    greatest of a list) go as distances."""
    kind, low = (T.ShortType(), 1 << 15) if span is not None and span < 1 << 16 else (T.IntegerType(), 1 << 31) if span is not None and span < 1 << 32 else (None, 0)
    field = lists.schema["c"].dataType.elementType
    lists = lists.withColumn("w", F.col("w").cast("bigint" if lists.schema["w"].dataType.simpleString() in WHOLE else "double"))
    cuts = _cuts(totals, keys)
    tasks, summed = max(1, sum(map(len, cuts.values())) + min(MOST_BLOCKS, len(cuts))), SUMMED
    rows = _in_blocks(lists, keys, cuts, tasks, low, kind).repartitionById(tasks, F.col("task"))
    schema = T.StructType([*(lists.schema[k] for k in keys), T.StructField("a", field), T.StructField("b", field), T.StructField("ab", lists.schema["w"].dataType)])

    def grouped(batches: Iterator[pa.RecordBatch]) -> dict[tuple, _Held]:
        held = defaultdict(_Held)
        for batch in batches:
            named = zip(*(batch.column(k).to_pylist() for k in keys), strict=True) if keys else [()] * len(batch)
            for i, key in enumerate(named):
                w, m, size, near = (batch.column(x)[i].values for x in ("w", "m", "size", "near"))
                if kind:
                    near = pa.array(near.to_numpy().astype(np.int64) + np.repeat(batch.column("first")[i].values.to_numpy() + low, size.to_numpy()))
                held[key].add(w, m, size, near)
        return held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, held = to_arrow_schema(schema), grouped(batches)
        while held:
            key, own = held.popitem()
            for a, b, ab in own.sums(summed):
                columns = [*(pa.repeat(pa.scalar(v, target.field(k).type), len(a)) for k, v in zip(keys, key, strict=True)), a, b, ab]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    return rows.mapInArrow(run, schema)


def containment(members: DataFrame, keys: list[str], seq: str, unitig: str, length: str) -> DataFrame:
    """keys, a, b, dist, back: 1 - length(shared unitigs) / length(unitigs of a), over *sets* of
    unitigs, and the same from b to a. Rows exist for pairs that share a unitig, a = b included; any
    other pair has distance 1. Only pairs with a <= b are summed up, out of lists by unitig."""
    lists = _lists(members, keys, seq, unitig, length)
    n, whole = F.size("c").cast("bigint"), lists.schema["c"].dataType.elementType.simpleString() in WHOLE
    reach = F.element_at("c", -1).cast("double") - F.element_at("c", 1).cast("double") if whole else F.lit(None).cast("double")
    filled = lists.where(F.size("c") > 0)
    span, without = filled.agg(F.max(reach), F.max("without")).first()
    each = filled.select(*keys, "w", n.alias("n"), F.posexplode("c").alias("i", "s"))
    sums = written(each.groupBy(*keys, "s").agg(F.sum("w").alias("t"), F.sum(F.col("n") - F.col("i") + SET_UP).alias("p")))
    totals = small_or_not(sums)
    total = lambda side: totals.select(*keys, F.col("s").alias(side), F.col("t").alias(f"t{side}"))
    far = lambda side: F.lit(1.0) - F.col("ab").cast("double") / F.col(f"t{side}").cast("double")
    both = _shared(filled, sums, keys, span).join(total("a"), [*keys, "a"]).join(total("b"), [*keys, "b"]).select(*keys, "a", "b", far("a").alias("dist"), far("b").alias("back"))
    there, twin = F.struct("a", "b", "dist", "back"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("back").alias("dist"), F.col("dist").alias("back"))
    out = both.select(*keys, F.explode(F.when(F.col("a") == F.col("b"), F.array(there)).otherwise(F.array(there, twin))).alias("p")).select(*keys, "p.*")
    if without:  # rows without a sequence are a sequence that others are compared with, and itself has no distance
        none = filled.where("without").select(*keys, F.explode("c").alias("a"), "w").groupBy(*keys, "a").agg(F.sum("w").alias("ab")).join(total("a"), [*keys, "a"])
        out = out.unionByName(none.select(*keys, "a", F.lit(None).cast(out.schema["b"].dataType).alias("b"), far("a").alias("dist"), F.lit(None).cast("double").alias("back")))
    return out


def _with_back(distances: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, dist, back of stored pairs that have a twin."""
    if "back" in distances.columns:
        return distances.where(F.col("back").isNotNull())
    other = distances.select(*keys, F.col("a").alias("b"), F.col("b").alias("a"), F.col("dist").alias("back"))
    return distances.join(other, [*keys, "a", "b"])


def symmetric(distances: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, dist with the greater of both directions; every stored pair has its twin."""
    return _with_back(distances, keys).select(*keys, "a", "b", F.greatest("dist", "back").alias("dist"))


def contained_clusters(distances: DataFrame, clusters: DataFrame, cutoff: float, keys: list[str] = ()) -> DataFrame:
    """keys, inner, outer, share: pairs of clusters of which more than half of all member pairs have
    d(inner, outer) < d(outer, inner) and d(inner, outer) < cutoff. Pairs without a shared unitig
    have distance 1 and never count, so stored distances are enough."""
    size = clusters.groupBy(*keys, "cluster").agg(F.count(F.lit(1)).alias("n"))
    named = small_or_not(clusters.select(*keys, "seq", "cluster"))
    c = lambda side: named.select(*keys, F.col("seq").alias(side), F.col("cluster").alias(f"c{side}"))
    near = _with_back(distances, keys).where((F.col("dist") < F.col("back")) & (F.col("dist") < cutoff)).select(*keys, "a", "b")
    hits = near.join(c("a"), [*keys, "a"]).join(c("b"), [*keys, "b"]).where("ca <> cb")
    hits = hits.groupBy(*keys, F.col("ca").alias("inner"), F.col("cb").alias("outer")).agg(F.count(F.lit(1)).alias("k"))
    n = lambda name: size.select(*keys, F.col("cluster").alias(name), F.col("n").alias(f"n_{name}"))
    share = F.col("k") / (F.col("n_inner") * F.col("n_outer"))
    rows = hits.join(n("inner"), [*keys, "inner"]).join(n("outer"), [*keys, "outer"])
    return rows.select(*keys, "inner", "outer", share.alias("share")).where("share > 0.5")


def assembly_counts(members: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, cluster, n_assemblies (distinct files), weighted (sum over files of the greatest weight),
    trusted (any). ``members`` has cluster, filename, weight, trusted."""
    per_file = members.groupBy(*keys, "cluster", "filename").agg(F.max("weight").alias("w"), F.max("trusted").alias("t"))
    return per_file.groupBy(*keys, "cluster").agg(
        F.count(F.lit(1)).alias("n_assemblies"), F.sum("w").alias("weighted"), F.max("t").alias("trusted")
    )


def balance(members: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, ``balance``: per cluster the share of all files of the sample that occur in it exactly
    once, averaged with the clusters' sizes as weights. ``members`` has cluster and filename."""
    per_file = members.groupBy(*keys, "cluster", "filename").agg(F.count(F.lit(1)).alias("n"))
    files = members.groupBy(*keys).agg(F.count_distinct("filename").alias("k"))
    per = per_file.groupBy(*keys, "cluster").agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("once"), F.sum("n").alias("w"))
    rows = per.join(files, list(keys)) if keys else per.join(F.broadcast(files))  # one row
    return rows.groupBy(*keys).agg((F.sum(F.col("once") / F.col("k") * F.col("w")) / F.sum("w")).alias("balance"))


def tightness(clusters: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, ``tightness``: mean of 1 - sqrt(dist) of clusters that pass, by size; 0 without any.
    ``clusters`` has dist, size, passed."""
    value = F.sum(F.when(F.col("passed"), (1 - F.sqrt("dist")) * F.col("size"))) / F.sum(F.when(F.col("passed"), F.col("size")))
    return clusters.groupBy(*keys).agg(F.coalesce(value, F.lit(0.0)).alias("tightness"))


def ordered_number(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Numbers from 1 within ``keys`` in the given order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
