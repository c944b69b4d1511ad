"""Queries over the driver's tables, one per operator, each next to its DuckDB SQL.

Documents stand in for contigs (their letters ACGT), conversations for reads, suppliers and
parts for sequences and unitigs, orders for paths, customers for cluster members. Every query
runs over its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seq as S
from ..functions import stats as T
from ..operators import components as C
from ..operators import distances as D
from ..operators import kmers as K
from ..operators import paths as P
from ..operators import reads as R
from ..session import small_or_not, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("seq_id"), F.col("source").alias("filename"), S.dna_letters(F.col("text")).alias("seq"))


_DNA = "(SELECT doc_id AS seq_id, source AS filename, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM documents)"


def _kmer_sql(k: int) -> str:
    return f"SELECT seq_id, unnest(range(0, length(seq) - {k - 1})) AS pos, unnest(list_transform(range(1, length(seq) - {k - 2}), lambda i: substr(seq, i, {k}))) AS kmer FROM {_DNA} WHERE length(seq) >= {k}"


@query(f"SELECT kmer, count(*) AS n, count(DISTINCT seq_id) AS n_seqs FROM ({_kmer_sql(7)}) GROUP BY kmer HAVING count(*) > 1")
def kmer_count(spark, sf_dir):
    return K.count_kmers(_dna(spark, sf_dir), "seq_id", "seq", 7, least=2)


@query(f"SELECT least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM ({_kmer_sql(5)}) GROUP BY 1")
def canonical_kmers(spark, sf_dir):
    return K.count_canonical(_dna(spark, sf_dir), "seq", 5)


@query(f"WITH k AS (SELECT DISTINCT kmer FROM ({_kmer_sql(5)})) SELECT a.kmer AS src, b.kmer AS dst FROM k a JOIN k b ON substr(a.kmer, 2, 4) = substr(b.kmer, 1, 4)")
def overlap_links(spark, sf_dir):
    return K.overlap_links(K.count_kmers(_dna(spark, sf_dir), "seq_id", "seq", 5), 5)


@query(f"SELECT seq_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc, length(seq) AS n FROM {_DNA}")
def reverse_complements(spark, sf_dir):
    return _dna(spark, sf_dir).select("seq_id", S.reverse_complement(F.col("seq")).alias("rc"), F.length("seq").cast("bigint").alias("n"))


@query(f"WITH c AS (SELECT kmer, count(*) AS n FROM ({_kmer_sql(9)}) GROUP BY kmer) SELECT n, count(*) AS kmers FROM c GROUP BY n")
def kmer_spectrum(spark, sf_dir):
    counts = K.count_kmers(_dna(spark, sf_dir), "seq_id", "seq", 9)
    return counts.groupBy("n").agg(F.count(F.lit(1)).alias("kmers"))


@query(
    """WITH r AS (SELECT lang, n_chars, sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars ROWS UNBOUNDED PRECEDING) AS run,
      sum(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING) AS down, sum(n_chars) OVER (PARTITION BY lang) AS tot FROM documents)
    SELECT lang, max(tot)::BIGINT AS bases, count(*) AS n, min(n_chars) FILTER (WHERE run >= tot // 2) AS n50, max(n_chars) FILTER (WHERE down * 2 >= tot) AS n50_desc FROM r GROUP BY lang"""
)
def n50(spark, sf_dir):
    return T.n50(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


_MEDIAN = """l AS (SELECT lang, list_sort(list(n_chars)) AS a FROM documents GROUP BY 1),
m AS (SELECT lang, a, (a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) // 2 AS median FROM l),
dv AS (SELECT lang, median, list_sort(list_transform(a, lambda x: abs(x - median))) AS b FROM m),
mm AS (SELECT lang, median, (b[(len(b) + 1) // 2] + b[len(b) // 2 + 1]) // 2 AS mad FROM dv)"""


@query(f"WITH {_MEDIAN} SELECT lang, median, mad FROM mm")
def median_mad(spark, sf_dir):
    return T.median_mad(table(spark, sf_dir, "documents"), ["lang"], "n_chars")


@query(f"WITH {_MEDIAN} SELECT doc_id, n_chars BETWEEN greatest(round(median - 5.0 * mad), 0) AND round(median + 5.0 * mad) AS kept FROM documents JOIN mm USING (lang)")
def length_outliers(spark, sf_dir):
    return T.length_outliers(table(spark, sf_dir, "documents"), ["lang"], "n_chars", 5.0).select("doc_id", "kept")


@query(
    """WITH k AS (SELECT l_partkey, l_quantity AS c FROM lineitem), m AS (SELECT *, avg(c) OVER (PARTITION BY l_partkey) AS mu FROM k)
    SELECT l_partkey, round(avg(least(c, greatest(mu + 6 * sqrt(mu), 2 * mu))), 6) AS depth FROM m GROUP BY 1"""
)
def clipped_mean(spark, sf_dir):
    out = T.clipped_mean(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_quantity", "depth")
    return out.select("l_partkey", F.round("depth", 6).alias("depth"))


@query("SELECT l_suppkey, round(sum(l_quantity * p_size) / sum(p_size), 6) AS depth FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def weighted_depth(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return T.weighted_mean(rows, ["l_suppkey"], "l_quantity", "p_size", "depth").select("l_suppkey", F.round("depth", 6).alias("depth"))


def _members(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


_DIST = """ps AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS u, p_size AS w FROM lineitem JOIN part ON l_partkey = p_partkey),
tot AS (SELECT a, sum(w) AS t FROM ps GROUP BY a), x AS (SELECT x.a, y.a AS b, sum(x.w) AS ab FROM ps x JOIN ps y USING (u) GROUP BY ALL),
d AS (SELECT x.a, x.b, 1.0::DOUBLE - ab::DOUBLE / t::DOUBLE AS dist FROM x JOIN tot USING (a))"""


def _containment(spark, sf_dir):
    return D.containment(_members(spark, sf_dir), [], "l_suppkey", "l_partkey", "p_size")


@query(f"WITH {_DIST} SELECT a, b, round(dist, 9) AS dist FROM d")
def containment(spark, sf_dir):
    return _containment(spark, sf_dir).select("a", "b", F.round("dist", 9).alias("dist"))


@query(f"WITH {_DIST} SELECT p.a, p.b, round(greatest(p.dist, q.dist), 9) AS dist FROM d p JOIN d q ON p.a = q.b AND p.b = q.a")
def symmetric_distance(spark, sf_dir):
    return D.symmetric(_containment(spark, sf_dir), []).select("a", "b", F.round("dist", 9).alias("dist"))


@query(
    f"""WITH {_DIST}, c AS (SELECT s_suppkey AS seq, s_nationkey AS cluster FROM supplier), n AS (SELECT cluster, count(*) AS n FROM c GROUP BY 1),
    h AS (SELECT x.cluster AS "inner", y.cluster AS "outer", count(*) AS k FROM d p JOIN d q ON p.a = q.b AND p.b = q.a JOIN c x ON x.seq = p.a JOIN c y ON y.seq = p.b
      WHERE x.cluster <> y.cluster AND p.dist < q.dist AND p.dist < 0.95 GROUP BY ALL)
    SELECT "inner", "outer", round(k / (x.n * y.n), 9) AS share FROM h JOIN n x ON x.cluster = "inner" JOIN n y ON y.cluster = "outer" WHERE k / (x.n * y.n) > 0.5"""
)
def containment_qc(spark, sf_dir):
    clusters = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_nationkey").alias("cluster"))
    return D.contained_clusters(_containment(spark, sf_dir), clusters, 0.95).withColumn("share", F.round("share", 9))


def _customers(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("n_regionkey").alias("cluster"), F.col("c_mktsegment").alias("filename"), F.col("n_nationkey").alias("weight"),
        (F.col("c_acctbal") > 9990).alias("trusted"), "c_acctbal",
    )


_CUST = "(SELECT n_regionkey AS cluster, c_mktsegment AS filename, n_nationkey AS weight, c_acctbal > 9990 AS trusted FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(
    f"""WITH f AS (SELECT cluster, filename, max(weight) AS w, bool_or(trusted) AS t FROM {_CUST} GROUP BY ALL)
    SELECT cluster, count(*) AS n_assemblies, sum(w)::BIGINT AS weighted, bool_or(t) AS trusted FROM f GROUP BY 1"""
)
def assembly_counts(spark, sf_dir):
    return D.assembly_counts(_customers(spark, sf_dir))


@query(
    """WITH cf AS (SELECT l_orderkey AS cl, l_suppkey AS f, count(*) AS n FROM lineitem GROUP BY ALL), nf AS (SELECT count(DISTINCT f) AS k FROM cf),
    s AS (SELECT cl, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / any_value(k)::DOUBLE AS sc, sum(n) AS w FROM cf CROSS JOIN nf GROUP BY cl) SELECT round(sum(sc * w) / sum(w), 9) AS balance FROM s"""
)
def balance_score(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cluster"), F.col("l_suppkey").alias("filename"))
    return D.balance(members).select(F.round("balance", 9).alias("balance"))


@query("SELECT round(coalesce(sum((1 - sqrt(l_discount)) * p_size) FILTER (WHERE l_returnflag = 'A') / sum(p_size) FILTER (WHERE l_returnflag = 'A'), 0), 6) AS tightness FROM lineitem JOIN part ON l_partkey = p_partkey")
def tightness(spark, sf_dir):
    rows = _members(spark, sf_dir).select(F.col("l_discount").alias("dist"), F.col("p_size").alias("size"), (F.col("l_returnflag") == "A").alias("passed"))
    return D.tightness(rows).select(F.round("tightness", 6).alias("tightness"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey <= 1 THEN 1 ELSE greatest(2, (n_nationkey + 2) // 4) END::BIGINT AS least FROM nation")
def min_assemblies(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", T.automatic_min_assemblies(F.col("n_nationkey")).alias("least"))


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name, p_retailprice DESC, p_partkey) AS number FROM part")
def renumber(spark, sf_dir):
    order = [F.desc("p_size"), F.col("p_name"), F.desc("p_retailprice"), F.col("p_partkey")]
    return D.ordered_number(table(spark, sf_dir, "part"), ["p_brand"], order, "number").select("p_partkey", F.col("number").cast("bigint").alias("number"))


@query(f"WITH {_MEDIAN} SELECT lang, row_number() OVER (ORDER BY median DESC, lang) AS number FROM mm")
def cluster_renumber(spark, sf_dir):
    medians = T.median_mad(table(spark, sf_dir, "documents"), ["lang"], "n_chars")
    return D.ordered_number(medians, [], [F.desc("median"), F.col("lang")], "number").select("lang", F.col("number").cast("bigint").alias("number"))


def _order_steps(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, coalesce(sum(p_size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM lineitem JOIN part ON l_partkey = p_partkey"""
)
def path_positions(spark, sf_dir):
    steps = _order_steps(spark, sf_dir).withColumn("i", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    return P.positions(steps, ["l_orderkey"], "i", "p_size").select("l_orderkey", "l_linenumber", "l_partkey", "pos")


@query("SELECT l_orderkey, string_agg(p_name, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def path_reconstruct(spark, sf_dir):
    return P.spell(_order_steps(spark, sf_dir), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("p_name"), " ")


@query(
    """WITH s AS (SELECT o_custkey AS cl, o_orderkey AS sq, l_linenumber AS u FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT cl, count(DISTINCT sq) AS n FROM s GROUP BY 1)
    SELECT cl AS o_custkey, u AS l_linenumber FROM s JOIN n USING (cl) GROUP BY cl, u, n HAVING count(*) = n AND count(DISTINCT sq) = n"""
)
def anchors(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return P.anchors(steps, ["o_custkey"], "o_orderkey", "l_linenumber")


@query(
    """WITH g AS (SELECT user_id, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM events)
    SELECT user_id, segment::BIGINT AS segment, count(*) AS n FROM g WHERE segment > 0 GROUP BY ALL"""
)
def anchor_segments(spark, sf_dir):
    events = P.segments(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup")
    return events.where("segment > 0").groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events"""
)
def previous_anchor(spark, sf_dir):
    return P.previous_anchor(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "event_id").select("event_id", "previous")


_PAIRS = """p AS (SELECT CASE WHEN l_returnflag = 'R' THEN -l_suppkey ELSE l_suppkey END AS "start",
  lead(CASE WHEN l_returnflag = 'R' THEN -l_suppkey ELSE l_suppkey END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS "end" FROM lineitem),
b AS (SELECT "start", "end", count(*) AS depth FROM p WHERE "end" IS NOT NULL GROUP BY ALL)"""


def _bridges(spark, sf_dir):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_suppkey")).otherwise(F.col("l_suppkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pairs = table(spark, sf_dir, "lineitem").select(signed.alias("start"), F.lead(signed).over(order).alias("end"))
    return P.bridge_groups(pairs.where("end is not null"))


@query(f'WITH {_PAIRS} SELECT "start", "end", depth FROM b')
def bridge_groups(spark, sf_dir):
    return _bridges(spark, sf_dir)


@query(
    f"""WITH {_PAIRS}, e AS (SELECT DISTINCT "start", "end", unnest([("start"), -("end")]) AS x FROM b), m AS (SELECT x FROM e GROUP BY x HAVING count(*) > 1)
    SELECT "start", "end", depth, EXISTS (SELECT 1 FROM e JOIN m USING (x) WHERE e."start" = b."start" AND e."end" = b."end") AS conflicting FROM b"""
)
def bridge_conflicts(spark, sf_dir):
    return P.bridge_conflicts(_bridges(spark, sf_dir))


_TREE = "e AS (SELECT c_custkey + 1000 AS a, c_nationkey AS b FROM customer UNION ALL SELECT n_nationkey, 100 + n_regionkey FROM nation)"


@query(
    f"""WITH RECURSIVE {_TREE}, ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(v, l) AS (SELECT DISTINCT a, a FROM ee UNION SELECT ee.b, r.l FROM r JOIN ee ON ee.a = r.v)
    SELECT l AS component, count(*) AS n FROM (SELECT v, min(l) AS l FROM r GROUP BY v) GROUP BY 1"""
)
def components(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1000).alias("u"), F.col("c_nationkey").cast("bigint").alias("v"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("u"), (F.col("n_regionkey") + 100).cast("bigint").alias("v"))
    edges = c.unionByName(n)
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    return C.component_of(nodes, edges).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


_LINKS = "l AS (SELECT DISTINCT l_suppkey AS src, CASE WHEN l_returnflag = 'R' THEN -l_linenumber ELSE l_linenumber END AS dst FROM lineitem)"


def _links(spark, sf_dir):
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_linenumber")).otherwise(F.col("l_linenumber")).cast("bigint")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), signed.alias("dst")).distinct()


@query(f"WITH {_LINKS} SELECT src, dst FROM l WHERE NOT EXISTS (SELECT 1 FROM l t WHERE t.src = -l.dst AND t.dst = -l.src)")
def link_twins(spark, sf_dir):
    return P.missing_twins(_links(spark, sf_dir), [])


@query(f"WITH {_LINKS} SELECT count(*) AS n_links, count(DISTINCT least((src, dst), (-dst, -src))) AS n_one_way FROM l")
def graph_totals(spark, sf_dir):
    return P.link_totals(_links(spark, sf_dir), [])


@query(
    """WITH u AS (SELECT o_orderkey AS number FROM orders WHERE o_totalprice >= 100000), l AS (SELECT DISTINCT l_orderkey AS src, -l_linenumber AS dst FROM lineitem)
    SELECT src, dst FROM l WHERE src IN (SELECT number FROM u) AND abs(dst) IN (SELECT number FROM u)"""
)
def drop_low_depth_links(spark, sf_dir):
    unitigs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("number"), F.col("o_totalprice").alias("depth"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (-F.col("l_linenumber")).cast("bigint").alias("dst")).distinct()
    return P.without_unitigs(unitigs, links, [], F.col("depth") >= 100000)[1]


@query(
    """WITH l AS (SELECT l_orderkey AS g, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS s, CASE WHEN l_linestatus = 'O' THEN 1 ELSE -1 END AS d FROM lineitem WHERE l_quantity > 40),
    f AS (SELECT g, max((s = 1 AND d = 1)::INT) AS loop, max((s = 1 AND d = -1)::INT) AS ep, max((s = -1 AND d = 1)::INT) AS sp FROM l GROUP BY g)
    SELECT o_orderkey AS g, CASE WHEN f.g IS NULL THEN 'linear-open-open' WHEN loop = 1 AND ep + sp = 0 THEN 'circular' WHEN loop = 0 AND ep + sp = 2 THEN 'linear-hairpin-hairpin'
      WHEN loop = 0 AND ep + sp = 1 THEN 'linear-open-hairpin' ELSE 'other' END AS topology FROM orders LEFT JOIN f ON f.g = o_orderkey"""
)
def topology(spark, sf_dir):
    unitigs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("g"))
    sign = F.when(F.col("l_returnflag") == "R", -1).otherwise(1)
    links = table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(
        F.col("l_orderkey").alias("g"), sign.alias("src"), F.when(F.col("l_linestatus") == "O", 1).otherwise(-1).alias("dst")
    )
    return P.topology(unitigs, links, ["g"])


@query(
    """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY md5('0:' || event_id), event_id) - 1 AS rn, count(*) OVER () AS n FROM events)
    SELECT i + 1 AS subset, event_id FROM r CROSS JOIN (SELECT unnest(range(4)) AS i) WHERE ((rn - CAST(round(i * n / 4.0) AS BIGINT) + n) % n) < n * 3 // 10"""
)
def subsample(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    return R.shuffled_subsets(events, "event_id", 4, F.floor(F.col("__n") * 3 / 10)).select(F.col("subset").cast("bigint").alias("subset"), "event_id")


@query(
    """WITH w AS (SELECT conv_id * 1000000 + turn AS read_id, unnest(range(0, len(a))) AS pos, unnest(a) AS kmer FROM (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations)),
    k AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS kmer FROM benchmark),
    t AS (SELECT read_id, count(*) AS n_kmers FROM w GROUP BY 1), h AS (SELECT read_id, count(*) AS hits, min(pos) AS lo, max(pos) AS hi FROM w WHERE kmer IN (SELECT kmer FROM k) GROUP BY 1),
    x AS (SELECT read_id, n_kmers, coalesce(hits, 0) AS hits, lo, hi, coalesce(hits, 0) >= greatest(n_kmers * 0.005, 1e-9) AS used FROM t LEFT JOIN h USING (read_id))
    SELECT read_id, n_kmers, hits::BIGINT AS hits, CASE WHEN used THEN hi - lo + 1 ELSE 0 END::BIGINT AS span_kmers, used, CASE WHEN used THEN hi - lo + 1 ELSE 0 END::BIGINT AS span_bases, NOT used AS rejected FROM x"""
)
def read_hits(spark, sf_dir):
    reads = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000000 + F.col("turn")).alias("read_id"), F.posexplode(F.split("text", " ")).alias("pos", "kmer"))
    known = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("kmer")).distinct()
    return R.read_hits(reads, known, 1)


@query(
    """WITH w AS (SELECT conv_id * 1000000 + turn AS read_id, unnest(range(0, len(a))) AS pos, unnest(a) AS kmer FROM (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations)),
    k AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS kmer FROM benchmark),
    t AS (SELECT read_id, count(*) AS n FROM w GROUP BY 1), h AS (SELECT read_id, count(*) AS hits, max(pos) - min(pos) + 1 AS span FROM w WHERE kmer IN (SELECT kmer FROM k) GROUP BY 1),
    x AS (SELECT *, coalesce(hits, 0) >= greatest(n * 0.005, 1e-9) AS used FROM t LEFT JOIN h USING (read_id))
    SELECT count(*) FILTER (WHERE used) AS reads, count(*) FILTER (WHERE NOT used) AS rejected_reads, coalesce(sum(hits) FILTER (WHERE used), 0)::BIGINT AS hits,
      coalesce(sum(span) FILTER (WHERE used), 0)::BIGINT AS span_kmers, coalesce(sum(span) FILTER (WHERE used), 0)::BIGINT AS span_bases FROM x"""
)
def read_totals(spark, sf_dir):
    return R.read_totals(read_hits(spark, sf_dir))


@query(
    """WITH k AS (SELECT l_suppkey AS tig, l_linenumber AS off, l_partkey AS kmer FROM lineitem), rep AS (SELECT kmer FROM k GROUP BY 1 HAVING count(*) > 45),
    rc AS (SELECT l_partkey AS kmer, sum(l_quantity) AS n FROM lineitem GROUP BY 1), bad AS (SELECT DISTINCT tig, off FROM k WHERE kmer IN (SELECT kmer FROM rep)),
    g AS (SELECT DISTINCT * FROM k ANTI JOIN bad USING (tig, off)), c AS (SELECT tig, off, coalesce(sum(n), 0) AS c FROM g LEFT JOIN rc USING (kmer) GROUP BY ALL),
    m AS (SELECT *, avg(c) OVER (PARTITION BY tig) AS mu FROM c) SELECT tig, round(2.5 * avg(least(c, greatest(mu + 6 * sqrt(mu), 2 * mu))), 6) AS read_depth FROM m GROUP BY 1"""
)
def tig_depths(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    tig = line.select(F.col("l_suppkey").alias("tig"), F.col("l_linenumber").alias("offset"), F.col("l_partkey").alias("kmer"))
    repeats = tig.groupBy("kmer").agg(F.count(F.lit(1)).alias("c")).where("c > 45").select("kmer")
    counts = line.groupBy(F.col("l_partkey").alias("kmer")).agg(F.sum("l_quantity").alias("n"))
    return R.tig_depths(tig, counts, repeats, 2.5).select("tig", F.round("read_depth", 6).alias("read_depth"))


_CONTIGS = "c AS (SELECT o_custkey AS g, o_orderkey AS idx, length(o_orderpriority) AS len, o_totalprice AS depth FROM orders), b AS (SELECT g, max_by(depth, (len, -idx)) AS d FROM c GROUP BY 1)"


def _contigs(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("idx"), F.length("o_orderpriority").alias("length"), F.col("o_totalprice").alias("depth"))


@query(f"WITH {_CONTIGS} SELECT g, idx, depth >= greatest(50000.0, d * 0.5) AS kept FROM c JOIN b USING (g)")
def depth_filter(spark, sf_dir):
    return R.depth_filter(_contigs(spark, sf_dir), ["g"], 50000.0, 0.5).select("g", "idx", "kept")


@query(f"WITH {_CONTIGS} SELECT g, idx, round(depth / d, 6) AS copies FROM c JOIN b USING (g)")
def copy_numbers(spark, sf_dir):
    return R.copy_numbers(_contigs(spark, sf_dir), ["g"]).select("g", "idx", F.round("copies", 6).alias("copies"))


@query(
    f"""WITH k AS ({_kmer_sql(10)}), a AS (SELECT seq_id, pos, kmer FROM k), m AS (
      SELECT a.seq_id AS sa, b.seq_id AS sb, a.pos AS xa, b.pos AS yb, true AS f FROM a JOIN a b ON a.kmer = b.kmer WHERE a.seq_id = b.seq_id
      UNION ALL SELECT a.seq_id, b.seq_id, a.pos, b.pos, false FROM a JOIN a b ON reverse(translate(a.kmer, 'ACGT', 'TGCA')) = b.kmer WHERE a.seq_id = b.seq_id)
    SELECT sa AS seq_id, round(xa / 20)::BIGINT AS x, round(yb / 20)::BIGINT AS y, CASE WHEN bool_or(f) THEN 'forward' ELSE 'reverse' END AS colour FROM m GROUP BY ALL"""
)
def dotplot_pixels(spark, sf_dir):
    from .dotplot import matches

    k = K.explode_kmers(_dna(spark, sf_dir), ["seq_id"], "seq", 10)
    return matches(k.select("seq_id", "kmer", F.round(F.col("pos") / 20).cast("bigint").alias("x")), ["seq_id"])


@query(f"SELECT DISTINCT kmer, list_reduce(list_transform(string_split(kmer, ''), lambda x: strpos('ACGT', x) - 1), lambda a, x: a * 4 + x)::BIGINT AS code FROM ({_kmer_sql(5)})")
def encoded_kmers(spark, sf_dir):
    return K.count_kmers(_dna(spark, sf_dir), "seq_id", "seq", 5).select("kmer", S.encode_2bit(F.col("kmer")).alias("code"))


@query(r"""SELECT event_id, CASE WHEN v = 'k' THEN 1000 * event_id WHEN v = 'm' THEN 1000000 * event_id ELSE event_id END::BIGINT AS bases FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'k' WHEN 1 THEN 'm' ELSE '' END AS v FROM events)""")
def genome_sizes(spark, sf_dir):
    unit = F.when(F.col("event_id") % 3 == 0, "k").when(F.col("event_id") % 3 == 1, "M").otherwise("")
    return table(spark, sf_dir, "events").select("event_id", S.parse_genome_size(F.concat(F.col("event_id").cast("string"), unit)).alias("bases"))


@query("SELECT c_custkey, c_custkey % 4 AS weight, c_custkey % 5 = 0 AS trusted, c_custkey % 7 = 0 AS ignored FROM customer")
def header_directives(spark, sf_dir):
    key = F.col("c_custkey")
    header = F.concat(
        F.lit("contig_"), key, F.when(key % 4 == 1, "").otherwise(F.concat(F.lit(" Tool_cluster_weight="), key % 4)),
        F.when(key % 5 == 0, " tool_TRUSTED").otherwise(""), F.when(key % 7 == 0, " Tool_ignore").otherwise(""),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", S.directive(header, "cluster_weight").cast("bigint").alias("weight"), S.is_trusted(header).alias("trusted"), S.is_ignored(header).alias("ignored"))


@query("SELECT s_suppkey, s_nationkey::DOUBLE AS depth FROM supplier")
def header_depths(spark, sf_dir):
    header = F.concat(F.lit("tig_"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 2 == 0, " depth=").otherwise(" coverage="), F.col("s_nationkey"), F.lit(" circular=true"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.depth_from_header(header).alias("depth"))


@query("SELECT o_orderkey, string_agg((l_suppkey + 1) || CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END, ',' ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS path FROM orders JOIN (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 'A' ELSE 'R' END AS l_returnflag FROM lineitem) ON o_orderkey = l_orderkey GROUP BY 1")
def reversed_paths(spark, sf_dir):
    number = F.col("l_suppkey") + 1
    signed = F.when(F.col("l_returnflag") == "R", -number).otherwise(number)
    steps = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", signed.alias("x"))))
    paths = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(steps, lambda s: s.x).alias("p"))
    return paths.select(F.col("l_orderkey").alias("o_orderkey"), S.signed_text(S.reverse_path(F.col("p"))).alias("path"))


# ---------------------------------------------------------------- without an SQL form


@query()
def upgma_clusters(spark, sf_dir):
    """UPGMA trees of suppliers by their parts, one tree per nation, cut at 0.9."""
    from .assembly import tree_clusters

    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sample_id"))
    rows = _members(spark, sf_dir).join(small_or_not(nation), "l_suppkey")
    return tree_clusters(D.containment(rows, ["sample_id"], "l_suppkey", "l_partkey", "p_size"), ["sample_id"], 0.9)


@query()
def unitig_graph(spark, sf_dir):
    """Unitigs of the benchmark texts' DNA letters, one sample, k = 11, repeats expanded."""
    from .assembly import compress, unpacked

    items = table(spark, sf_dir, "benchmark")
    seqs = items.select(F.lit("s").alias("sample_id"), F.col("item_id").cast("int").alias("seq_id"), S.dna_letters(F.col("text")).alias("seq"))
    unitigs, _, _ = unpacked(compress(seqs.where("length(seq) >= 11"), 11, repair=False), ["sample_id"])
    return unitigs.select("number", "seq", F.round("depth", 6).alias("depth"))


@query()
def resolved_paths(spark, sf_dir):
    """Bridged graphs of orders as paths through line numbers, one graph per customer."""
    from .assembly import graph_rows, resolve, unpacked

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    base = lines.select(F.lit("s").alias("sample_id"), F.col("o_custkey").alias("cluster"), F.col("l_orderkey").cast("int").alias("seq_id"), F.col("l_linenumber").alias("n"), "l_partkey").distinct()
    order = Window.partitionBy("cluster", "seq_id").orderBy("n", "l_partkey")
    steps = base.withColumn("idx", F.row_number().over(order)).select("sample_id", "cluster", "seq_id", "idx", F.col("n").alias("unitig"))
    follow = steps.withColumn("dst", F.lead("unitig").over(Window.partitionBy("cluster", "seq_id").orderBy("idx"))).where("dst is not null")
    links = follow.select("sample_id", "cluster", F.col("unitig").alias("src"), "dst").distinct()
    unitigs = steps.groupBy("sample_id", "cluster", F.col("unitig").alias("number")).agg(F.count(F.lit(1)).alias("depth")).withColumn("seq", F.repeat(F.lit("A"), F.col("number")))
    out, _, _ = unpacked(resolve(graph_rows(unitigs, links, steps, ["sample_id", "cluster"])), ["sample_id", "cluster"])
    return out.select("cluster", "number", F.length("seq").alias("length"), "depth", "type")
