"""Queries of graph edits, trimming, resolving and clustering on graphs whose outcome SQL can say.

A customer is a cluster; its orders are unitigs or sequences of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import table
from . import assembly as A
from . import clustering as L
from .queries import query

_KEYS = ["sample_id", "cluster"]
_U = """u AS (SELECT o_custkey AS cluster, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number, count(*) OVER (PARTITION BY o_custkey) AS n, o_orderkey % 50 + 1 AS len, o_orderkey % 8 AS d FROM orders)"""


def _unitigs(spark, sf_dir) -> DataFrame:
    own = Window.partitionBy("cluster").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.lit("s").alias("sample_id"), F.col("o_custkey").cast("int").alias("cluster"), "o_orderkey")
    base = orders.withColumn("number", F.row_number().over(own)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("cluster")).cast("int"))
    return base.withColumn("seq", F.repeat(F.lit("A"), (F.col("o_orderkey") % 50 + 1).cast("int"))).withColumn("depth", F.col("o_orderkey") % 8)


def _rows(unitigs: DataFrame, steps: DataFrame) -> DataFrame:
    """Graph rows with the links that the paths ``steps`` (keys, seq_id, idx, unitig) run over."""
    after = F.lead("unitig").over(Window.partitionBy(*_KEYS, "seq_id").orderBy("idx"))
    links = steps.select(*_KEYS, F.col("unitig").alias("src"), after.alias("dst")).where("dst is not null").distinct()
    return A.graph_rows(unitigs, links, steps, _KEYS)


def _path(unitigs: DataFrame, path) -> DataFrame:
    """One path per cluster: ``path`` is an array column over n, the number of unitigs."""
    per = unitigs.select(*_KEYS, "n").distinct()
    return per.select(*_KEYS, F.lit(1).alias("seq_id"), F.posexplode(path(F.sequence(F.lit(1), F.col("n")))).alias("idx", "unitig"))


def _chains(spark, sf_dir) -> DataFrame:
    unitigs = _unitigs(spark, sf_dir)
    return _rows(unitigs, _path(unitigs, lambda p: p))


@query(f"WITH {_U} SELECT cluster::INT AS cluster, 1 AS number, sum(len)::BIGINT AS length FROM u GROUP BY 1")
def merged_chains(spark, sf_dir):
    unitigs, _, _ = A.unpacked(A.clean(_chains(spark, sf_dir), _KEYS), _KEYS)
    return unitigs.select("cluster", "number", F.length("seq").cast("bigint").alias("length"))


@query(f"WITH {_U} SELECT cluster::INT AS cluster, sum(len)::BIGINT AS length FROM u WHERE number > 1 GROUP BY 1")
def removed_unitigs(spark, sf_dir):
    unitigs, _, _ = A.unpacked(A.clean(_chains(spark, sf_dir), _KEYS, remove=[1]), _KEYS)
    return unitigs.select("cluster", F.length("seq").cast("bigint").alias("length"))


@query(
    f"""WITH {_U}, arm AS (SELECT *, d <= 5 AS low, min(number) OVER (PARTITION BY cluster) AS first, bool_and(d <= 5) OVER (PARTITION BY cluster) AS all_low FROM u WHERE number > 1 AND number < n),
    kept AS (SELECT cluster, len FROM arm WHERE NOT low OR (all_low AND number = first) UNION ALL SELECT cluster, len FROM u WHERE n >= 3 AND (number = 1 OR number = n))
    SELECT cluster::INT AS cluster, sum(len)::BIGINT AS length FROM kept GROUP BY 1"""
)
def low_depth_arms(spark, sf_dir):
    """Unitigs between the first and the last one are arms of a bubble; arms of a low depth go, the
    last ones first, but for one way through."""
    unitigs = _unitigs(spark, sf_dir).where("n >= 3")
    arms = unitigs.where("number > 1 and number < n").select(*_KEYS, F.col("number").alias("seq_id"), F.posexplode(F.array(F.lit(1), F.col("number"), F.col("n"))).alias("idx", "unitig"))
    made, _, _ = A.unpacked(A.clean(_rows(unitigs, arms), _KEYS, min_depth=5.0), _KEYS)
    return made.groupBy("cluster").agg(F.sum(F.length("seq")).cast("bigint").alias("length"))


def _path_lengths(rows: DataFrame) -> DataFrame:
    out = A.decompress(rows, _KEYS)
    return out.select("cluster", "seq_id", F.length("seq").cast("bigint").alias("length"))


@query(f"WITH {_U} SELECT cluster::INT AS cluster, 1 AS seq_id, sum(len)::BIGINT AS length FROM u GROUP BY 1")
def trimmed_circles(spark, sf_dir):
    """Paths that end with their first unitig again lose that overlap."""
    unitigs = _unitigs(spark, sf_dir)
    return _path_lengths(A.trim(_rows(unitigs, _path(unitigs, lambda p: F.concat(p, F.array(F.lit(1)))))))


@query(f"WITH {_U} SELECT cluster::INT AS cluster, 1 AS seq_id, sum(len)::BIGINT AS length FROM u GROUP BY 1")
def trimmed_hairpins(spark, sf_dir):
    """Paths that end with their last unitig on the other strand lose that hairpin."""
    unitigs = _unitigs(spark, sf_dir)
    return _path_lengths(A.trim(_rows(unitigs, _path(unitigs, lambda p: F.concat(p, F.array(-F.element_at(p, -1)))))))


@query(
    f"""WITH {_U}, l AS (SELECT cluster, list_sort(list(len)) AS a FROM u GROUP BY 1), m AS (SELECT cluster, a, (a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) // 2 AS median FROM l),
    w AS (SELECT cluster, median, list_sort(list_transform(a, lambda x: abs(x - median))) AS b FROM m), mm AS (SELECT cluster, median, (b[(len(b) + 1) // 2] + b[len(b) // 2 + 1]) // 2 AS mad FROM w)
    SELECT cluster::INT AS cluster, number::INT AS seq_id, len::BIGINT AS length FROM u JOIN mm USING (cluster) WHERE len BETWEEN greatest(round(median - 1.5 * mad), 0) AND round(median + 1.5 * mad)"""
)
def trimmed_outliers(spark, sf_dir):
    """Every order is a path of its own; those of outlying length go."""
    unitigs = _unitigs(spark, sf_dir)
    steps = unitigs.select(*_KEYS, F.col("number").alias("seq_id"), F.lit(0).alias("idx"), F.col("number").alias("unitig"))
    return _path_lengths(A.trim(_rows(unitigs, steps), mad=1.5))


_VOTE = """v AS (SELECT o_custkey AS cluster, o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 4 ELSE 5 END AS x, o_orderkey % 3 AS w FROM orders),
t AS (SELECT cluster, x, sum(w) AS w FROM v GROUP BY ALL), b AS (SELECT cluster, x, row_number() OVER (PARTITION BY cluster ORDER BY w DESC, x) AS r FROM t WHERE w > 0)"""


def _votes(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every order is a path 1, x, 2, x being its status; weights go by the order's number. Graphs,
    weights, and the keys of the clusters that have any weight."""
    x = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 4).otherwise(5)
    orders = table(spark, sf_dir, "orders").select(F.lit("s").alias("sample_id"), F.col("o_custkey").cast("int").alias("cluster"), F.col("o_orderkey").cast("int").alias("seq_id"), x.alias("x"))
    steps = orders.select(*_KEYS, "seq_id", F.posexplode(F.array(F.lit(1), F.col("x"), F.lit(2))).alias("idx", "unitig"))
    letters = F.create_map(F.lit(1), F.lit("AAAA"), F.lit(2), F.lit("AAAAAA"), F.lit(3), F.lit("CCC"), F.lit(4), F.lit("GGG"), F.lit(5), F.lit("TTT"))
    unitigs = steps.groupBy(*_KEYS, F.col("unitig").alias("number")).agg(F.count(F.lit(1)).alias("depth")).withColumn("seq", letters[F.col("number")])
    weights = orders.select(*_KEYS, "seq_id", (F.col("seq_id") % 3).alias("consensus_weight"))
    return _rows(unitigs, steps), weights.drop("cluster"), weights.where("consensus_weight > 0").select(*_KEYS).distinct()


@query(f"WITH {_VOTE} SELECT cluster::INT AS cluster, 'AAAA' || CASE x WHEN 3 THEN 'CCC' WHEN 4 THEN 'GGG' ELSE 'TTT' END || 'AAAAAA' AS seq FROM b WHERE r = 1")
def weighted_votes(spark, sf_dir):
    """The consensus of two anchors by weighted paths; clusters without any weight are left out (where
    all their paths are one, they have no bridge and keep their links, which are merged too)."""
    rows, weights, voted = _votes(spark, sf_dir)
    made, _, _ = A.unpacked(A.resolve(rows.join(voted, _KEYS, "left_semi"), weights), _KEYS)
    return made.where(F.length("seq") == 13).select("cluster", "seq")


@query(
    """WITH s AS (SELECT l_orderkey, string_agg(CASE WHEN l_returnflag = 'R' THEN reverse(translate(q, 'ACGT', 'TGCA')) ELSE q END, '' ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq
    FROM lineitem JOIN (SELECT p_partkey, repeat(substr('ACGT', p_size % 4 + 1, 1), p_size % 5 + 1) || 'AC' AS q FROM part) ON l_partkey = p_partkey GROUP BY 1) SELECT l_orderkey::INT AS seq_id, seq FROM s"""
)
def decompressed(spark, sf_dir):
    """Orders as paths through parts, spelled; a graph per customer."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = F.when(F.col("l_returnflag") == "R", -(F.col("l_partkey") + 1)).otherwise(F.col("l_partkey") + 1).cast("int")
    base = lines.select(F.lit("s").alias("sample_id"), F.col("o_custkey").cast("int").alias("cluster"), F.col("l_orderkey").cast("int").alias("seq_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("idx"), x.alias("unitig"))
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).cast("int").alias("number"), F.concat(F.repeat(F.substr(F.lit("ACGT"), F.col("p_size") % 4 + 1, F.lit(1)), F.col("p_size") % 5 + 1), F.lit("AC")).alias("seq"))
    unitigs = base.select(*_KEYS, F.abs("unitig").alias("number")).distinct().join(part, "number").withColumn("depth", F.lit(1.0))
    return A.decompress(_rows(unitigs, base), _KEYS).select("seq_id", "seq")


@query(
    """WITH c AS (SELECT s_nationkey // 3 AS sample, s_suppkey AS id, abs(floor(s_acctbal))::BIGINT + 1 AS len, s_suppkey // 2 AS pair FROM supplier), p AS (SELECT sample, pair, count(*) AS size, sum(len) // count(*) AS median, min(id) AS low FROM c GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY median DESC, size, low) AS number FROM p)
    SELECT 's' || sample AS sample_id, id AS seq_id, number::INT AS cluster, true AS passed, CASE WHEN size = 2 THEN 0.02 ELSE 0.0 END::DOUBLE AS distance FROM c JOIN r USING (sample, pair)"""
)
def clustered_pairs(spark, sf_dir):
    """Suppliers as contigs, near to their neighbour's number only: trees, cut, refinement, checks and
    numbers of the clusters of every sample. Two files hold all contigs, so there is no limit per file."""
    seqs = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.floor(F.col("s_nationkey") / 3)).alias("sample_id"), F.col("s_suppkey").alias("seq_id"), F.concat(F.lit("f"), F.col("s_suppkey") % 2).alias("filename"),
        (F.abs(F.floor("s_acctbal")).cast("bigint") + 1).alias("length"), F.lit(1).alias("cluster_weight"), F.lit(False).alias("trusted"),
    )
    b = F.col("seq_id") + 1 - 2 * (F.col("seq_id") % 2)
    near = seqs.select("sample_id", F.col("seq_id").alias("a"), b.alias("b"), F.lit(0.02).alias("dist"))
    near = near.join(seqs.select("sample_id", F.col("seq_id").alias("b")), ["sample_id", "b"], "left_semi")
    out = L.cluster(seqs, near, min_assemblies=1, max_contigs=1e9)
    return out.select("sample_id", "seq_id", "cluster", "passed", F.round("distance", 9).alias("distance"))


@query(
    """WITH c AS (SELECT 's' || (s_nationkey // 3) AS sample_id, s_suppkey AS id, s_name AS name, s_nationkey AS len FROM supplier), n AS (SELECT sample_id, count(*) AS n FROM c GROUP BY 1),
    m AS (SELECT a.sample_id, a.id, any_value(a.name) AS name, any_value(a.len) AS len, string_agg(CASE WHEN a.id = b.id THEN '0.00000000' WHEN b.id = a.id + 5 THEN '0.25000000' ELSE '1.00000000' END, chr(9) ORDER BY b.id) AS cells FROM c a JOIN c b USING (sample_id) GROUP BY 1, 2)
    SELECT sample_id, 0 AS place, n || '' AS value FROM n UNION ALL SELECT sample_id, id + 1, 'f ' || name || ' (' || len || ' bp)' || chr(9) || cells FROM m"""
)
def phylip(spark, sf_dir):
    from .reports import phylip as lines

    seqs = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), F.floor(F.col("s_nationkey") / 3)).alias("sample_id"), (F.col("s_suppkey") + 1).alias("seq_id"), F.lit("f").alias("filename"), F.col("s_name").alias("contig_header"), F.col("s_nationkey").alias("length")
    )
    near = seqs.select("sample_id", F.col("seq_id").alias("a"), (F.col("seq_id") + 5).alias("b"), F.lit(0.25).alias("dist"))
    return lines(near, seqs)
