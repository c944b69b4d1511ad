"""Queries of formats, clusterings and combined assemblies, each next to its DuckDB SQL.

Parts stand in for unitigs, orders for sequences and paths, customers for contigs. Every query runs
over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seq as S
from ..functions import stats as T
from ..operators import kmers as K
from ..operators import reads as R
from ..session import table
from ..sources import fasta, gfa, sidefiles
from . import clustering as L
from . import outputs as O
from .assembly import bridged, graph_rows, unpacked
from .queries import _DNA, _dna, query

# ---------------------------------------------------------------- graphs as text

_KIND = "CASE p_size % 4 WHEN 0 THEN 'anchor' WHEN 1 THEN 'bridge' WHEN 2 THEN 'consentig' ELSE 'other' END"
_STEP = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN -(l_partkey + 1) ELSE l_partkey + 1 END AS x FROM lineitem"
_LINKS = f"""s AS ({_STEP}), f AS (SELECT x AS src, lead(x) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM s), l AS (SELECT DISTINCT src, dst FROM f WHERE dst IS NOT NULL)"""
_SIGNED = "abs({0}) || CASE WHEN {0} > 0 THEN '+' ELSE '-' END"
_SIDE = "abs({0}) || chr(9) || CASE WHEN {0} > 0 THEN '+' ELSE '-' END"


def _graph(spark, sf_dir) -> gfa.Gfa:
    """Parts as segments, their order within orders as links, orders as paths."""
    part = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_size") % 4 == 0, "anchor").when(F.col("p_size") % 4 == 1, "bridge").when(F.col("p_size") % 4 == 2, "consentig").otherwise("other")
    unitigs = part.select((F.col("p_partkey") + 1).cast("int").alias("number"), F.repeat(F.lit("A"), F.col("p_size")).alias("seq"), (F.col("p_size") / 4).alias("depth"), kind.alias("type"))
    x = F.when(F.col("l_returnflag") == "R", -(F.col("l_partkey") + 1)).otherwise(F.col("l_partkey") + 1).cast("int")
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("i"), x.alias("x"), F.abs(x).alias("number"))
    links = steps.select(F.col("x").alias("src"), F.lead("x").over(Window.partitionBy("l_orderkey").orderBy("i")).alias("dst")).where("dst is not null").distinct()
    sized = steps.join(unitigs.select("number", F.length("seq").alias("n")), "number")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s.x)
    paths = sized.groupBy("l_orderkey").agg(ordered.alias("path"), F.sum("n").alias("length"))
    orders = table(spark, sf_dir, "orders").join(paths, F.col("o_orderkey") == F.col("l_orderkey"))
    named = orders.select(
        F.col("o_orderkey").cast("int").alias("seq_id"), "path", "length", F.concat("o_orderpriority", F.lit(".fa")).alias("filename"),
        F.concat(F.lit("c"), "o_custkey", F.lit(" "), "o_orderstatus").alias("header"), (F.col("o_custkey") % 3).cast("int").alias("cluster"),
    )
    return gfa.Gfa(spark.createDataFrame([(11,)], "k int"), unitigs, links, named)


_PATHS = f"""p AS (SELECT l_orderkey, string_agg({_SIGNED.format('x')}, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS path, sum(p_size) AS len FROM ({_STEP}) JOIN part ON p_partkey + 1 = abs(x) GROUP BY 1),
o AS (SELECT o_orderkey AS seq_id, path, len, o_orderpriority || '.fa' AS filename, 'c' || o_custkey || ' ' || o_orderstatus AS header, o_custkey % 3 AS cluster FROM orders JOIN p ON o_orderkey = l_orderkey)"""


@query(
    f"""WITH {_LINKS}, {_PATHS} SELECT 'H' || chr(9) || 'VN:Z:1.0' || chr(9) || 'KM:i:11' AS value UNION ALL
    SELECT 'S' || chr(9) || (p_partkey + 1) || chr(9) || repeat('A', p_size) || chr(9) || 'DP:f:' || (p_size // 4) || CASE p_size % 4 WHEN 0 THEN '.00' || chr(9) || 'CL:Z:forestgreen' WHEN 1 THEN '.25' || chr(9) || 'CL:Z:pink'
      WHEN 2 THEN '.50' || chr(9) || 'CL:Z:steelblue' ELSE '.75' END FROM part UNION ALL
    SELECT 'L' || chr(9) || {_SIDE.format('src')} || chr(9) || {_SIDE.format('dst')} || chr(9) || '0M' FROM l UNION ALL
    SELECT 'P' || chr(9) || seq_id || chr(9) || path || chr(9) || '*' || chr(9) || 'LN:i:' || len || chr(9) || 'FN:Z:' || filename || chr(9) || 'HD:Z:' || header || CASE WHEN cluster > 0 THEN chr(9) || 'CL:i:' || cluster ELSE '' END FROM o"""
)
def gfa_text(spark, sf_dir):
    return gfa.gfa_lines(_graph(spark, sf_dir), 11)


def _parsed(spark, sf_dir) -> gfa.Gfa:
    return gfa.parse_gfa(gfa.gfa_lines(_graph(spark, sf_dir), 11))


@query(f"SELECT (p_partkey + 1)::INT AS number, repeat('A', p_size) AS seq, p_size / 4 AS depth, {_KIND} AS type FROM part")
def gfa_segments(spark, sf_dir):
    return _parsed(spark, sf_dir).unitigs


@query(f"WITH {_LINKS} SELECT src::INT AS src, dst::INT AS dst FROM l")
def gfa_links(spark, sf_dir):
    return _parsed(spark, sf_dir).links


@query(f"WITH {_PATHS} SELECT seq_id::INT AS seq_id, path, len::BIGINT AS length, filename, header, cluster::INT AS cluster FROM o")
def gfa_paths(spark, sf_dir):
    return _parsed(spark, sf_dir).paths.withColumn("path", S.signed_text(F.col("path")))


@query(
    f"""SELECT l_orderkey::INT AS seq_id, (row_number() OVER w - 1)::INT AS idx, (-x)::INT AS unitig, coalesce(sum(p_size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM ({_STEP}) JOIN part ON p_partkey + 1 = abs(x) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC)"""
)
def gfa_reverse_positions(spark, sf_dir):
    return gfa.path_steps(_parsed(spark, sf_dir), strand=False)


@query(
    f"""WITH {_LINKS}, g AS (SELECT n, bool_or(src = dst AND src > 0) AS loop, bool_or(abs(src) <> abs(dst) AND abs(src) = n) AS more FROM (SELECT *, unnest([abs(src), abs(dst)]) AS n FROM l) GROUP BY n)
    SELECT p_partkey + 1 AS number, (p_partkey + 1) || ' length=' || p_size || ' depth=' || (p_size // 4) || CASE p_size % 4 WHEN 0 THEN '.0' WHEN 1 THEN '.2' WHEN 2 THEN '.5' ELSE '.8' END || CASE WHEN n IS NULL THEN ' topology=linear' WHEN loop AND NOT more THEN ' topology=circular' ELSE '' END AS header,
      CASE WHEN n IS NULL THEN 'linear' WHEN loop AND NOT more THEN 'circular' ELSE 'other' END AS topology FROM part LEFT JOIN g ON n = p_partkey + 1 WHERE p_size > 0"""
)
def gfa_fasta(spark, sf_dir):
    return gfa.segment_fasta(_parsed(spark, sf_dir)).select("number", "header", "topology")


# ---------------------------------------------------------------- contigs and headers


def _fasta(spark, sf_dir) -> DataFrame:
    header = F.concat(F.lit("c"), "seq_id", F.lit("\t "), F.lit("x"), F.when(F.col("seq_id") % 3 == 0, " Tool_cluster_weight=4").otherwise(""), F.when(F.col("seq_id") % 4 == 0, " Tool_ignore").otherwise(""))
    return _dna(spark, sf_dir).select(F.coalesce("filename", F.lit("none")).alias("filename"), F.col("seq_id").alias("record"), header.alias("header"), "seq")


@query(
    f"""SELECT row_number() OVER (ORDER BY coalesce(filename, 'none'), seq_id)::INT AS seq_id, coalesce(filename, 'none') AS filename, 'c' || seq_id || ' x' || CASE WHEN seq_id % 3 = 0 THEN ' Tool_cluster_weight=4' ELSE '' END || CASE WHEN seq_id % 4 = 0 THEN ' Tool_ignore' ELSE '' END AS contig_header,
    length(seq)::BIGINT AS length, CASE WHEN seq_id % 3 = 0 THEN 4 ELSE 1 END AS cluster_weight, seq_id % 4 = 0 AS ignored FROM {_DNA} WHERE length(seq) >= 51"""
)
def assembly_numbers(spark, sf_dir):
    return fasta.assembly_sequences(_fasta(spark, sf_dir), 51, max_contigs=1e9).select("seq_id", "filename", "contig_header", "length", "cluster_weight", "ignored")


@query(f"SELECT coalesce(filename, 'none') AS filename, count(*) AS contigs, sum(length(seq))::BIGINT AS bases FROM {_DNA} GROUP BY 1")
def fasta_totals(spark, sf_dir):
    return fasta.total_lengths(_fasta(spark, sf_dir))


@query(f"SELECT '>c' || seq_id || chr(9) || ' x' || CASE WHEN seq_id % 3 = 0 THEN ' Tool_cluster_weight=4' ELSE '' END || CASE WHEN seq_id % 4 = 0 THEN ' Tool_ignore' ELSE '' END || chr(10) || coalesce(seq, '') AS value FROM {_DNA} WHERE seq IS NOT NULL")
def fasta_text(spark, sf_dir):
    return fasta.fasta_lines(_fasta(spark, sf_dir).where("seq is not null"), ["filename", "record"])


def _contigs(spark, sf_dir) -> DataFrame:
    """Customers as contigs of samples (regions of 7 nations) in clusters (nations)."""
    key = F.col("c_custkey")
    header = F.concat(
        "c_name", F.lit(" circular="), F.when(key % 2 == 0, "True").otherwise("False"), F.when(key % 5 == 0, F.concat(F.lit(" Tool_cluster_weight="), key % 4)).otherwise(""),
        F.when(key % 7 == 0, " Tool_trusted").otherwise(""), F.when(key % 11 == 0, " Tool_consensus_weight=2").otherwise(""),
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("r"), F.floor(F.col("c_nationkey") / 7)).alias("sample_id"), F.col("c_nationkey").alias("cluster"), key.alias("seq_id"), F.col("c_mktsegment").alias("filename"),
        header.alias("contig_header"), F.abs(F.floor("c_acctbal")).cast("bigint").alias("length"), (F.col("c_nationkey") % 3 > 0).alias("passed"), (F.col("c_nationkey") / 50).alias("distance"),
        S.directive(header, "cluster_weight").alias("cluster_weight"), S.directive(header, "consensus_weight").alias("consensus_weight"), S.is_trusted(header).alias("trusted"),
    )


_CONTIGS = """c AS (SELECT 'r' || (c_nationkey // 7) AS sample_id, c_nationkey AS cluster, c_custkey AS seq_id, c_mktsegment AS filename, c_name AS name, abs(floor(c_acctbal))::BIGINT AS length, c_nationkey % 3 > 0 AS passed, c_nationkey / 50 AS distance,
  CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 ELSE 1 END AS cw, CASE WHEN c_custkey % 11 = 0 THEN 2 ELSE 1 END AS sw, c_custkey % 7 = 0 AS trusted, CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS circ FROM customer)"""


@query(
    f"""WITH {_CONTIGS} SELECT sample_id, seq_id || '__' || filename || '__' || name || '__' || length || '_bp' AS node_name, CASE WHEN passed THEN cluster || '' ELSE 'none' END AS passing_clusters, cluster || '' AS all_clusters, seq_id || '' AS sequence_id,
    filename AS file_name, name AS contig_name, length || '' AS length, CASE WHEN trusted THEN 'true' ELSE 'false' END AS trusted, cw || '' AS cluster_weight, sw || '' AS consensus_weight FROM c"""
)
def cluster_table(spark, sf_dir):
    return L.cluster_table(_contigs(spark, sf_dir))


@query(
    f"""WITH {_CONTIGS}, cf AS (SELECT sample_id, cluster, filename, count(*) AS n FROM c GROUP BY ALL), nf AS (SELECT sample_id, count(DISTINCT filename) AS k FROM c GROUP BY 1),
    s AS (SELECT sample_id, cluster, count(*) FILTER (WHERE n = 1) / any_value(k)::DOUBLE AS once, sum(n) AS w FROM cf JOIN nf USING (sample_id) GROUP BY ALL), b AS (SELECT sample_id, sum(once * w) / sum(w) AS balance FROM s GROUP BY 1),
    q AS (SELECT sample_id, cluster, any_value(passed) AS passed, any_value(distance) AS d, count(*) AS n FROM c GROUP BY ALL),
    t AS (SELECT sample_id, count(*) FILTER (WHERE passed) AS pc, count(*) FILTER (WHERE NOT passed) AS fc, coalesce(sum(n) FILTER (WHERE passed), 0) AS pn, coalesce(sum(n) FILTER (WHERE NOT passed), 0) AS fn,
      coalesce(sum((1 - sqrt(d)) * n) FILTER (WHERE passed) / sum(n) FILTER (WHERE passed), 0) AS tight FROM q GROUP BY 1)
    SELECT sample_id, pc::BIGINT AS pass_cluster_count, fc::BIGINT AS fail_cluster_count, pn::BIGINT AS pass_contig_count, fn::BIGINT AS fail_contig_count, round(pn / (pn + fn), 9) AS pass_contig_fraction, round(fn / (pn + fn), 9) AS fail_contig_fraction,
      round(balance, 9) AS cluster_balance_score, round(tight, 9) AS cluster_tightness_score, round((balance + tight) / 2, 9) AS overall_clustering_score FROM t JOIN b USING (sample_id)"""
)
def clustering_metrics(spark, sf_dir):
    rows = L.metrics(_contigs(spark, sf_dir))
    return rows.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


@query(
    f"""WITH {_CONTIGS}, l AS (SELECT sample_id, cluster, list(length ORDER BY seq_id) AS v, list_sort(list(length)) AS a, any_value(distance) AS d FROM c GROUP BY ALL), m AS (SELECT *, (a[(len(a) + 1) // 2] + a[len(a) // 2 + 1]) // 2 AS median FROM l),
    w AS (SELECT *, list_sort(list_transform(a, lambda x: abs(x - median))) AS b FROM m)
    SELECT sample_id, cluster, len(v)::BIGINT AS size, array_to_string(v, ',') AS lengths, median::BIGINT AS median, ((b[(len(b) + 1) // 2] + b[len(b) // 2 + 1]) // 2)::BIGINT AS mad, d AS distance FROM w"""
)
def untrimmed_metrics(spark, sf_dir):
    m, p = L.cluster_metrics(_contigs(spark, sf_dir)), "untrimmed_cluster_"
    return m.select("sample_id", "cluster", F.col(p + "size").cast("bigint").alias("size"), F.array_join(p + "lengths", ",").alias("lengths"), F.col(p + "median").alias("median"), F.col(p + "mad").alias("mad"), F.col(p + "distance").alias("distance"))


@query(
    f"""WITH {_CONTIGS}, e AS (SELECT *, list_filter([CASE WHEN trusted THEN 'trusted' END, CASE WHEN cw <> 1 THEN 'cluster weight = ' || cw END, CASE WHEN sw <> 1 THEN 'consensus weight = ' || sw END], lambda x: x IS NOT NULL) AS extra FROM c)
    SELECT seq_id, filename || ' ' || name || ' (' || length || ' bp)' || CASE WHEN len(extra) > 0 THEN ' [' || array_to_string(extra, ', ') || ']' ELSE '' END AS text FROM e"""
)
def contig_texts(spark, sf_dir):
    return _contigs(spark, sf_dir).select("seq_id", S.contig_text(F.col("filename"), F.col("contig_header"), F.col("length")).alias("text"))


@query(
    """SELECT c_custkey AS seq_id, c_name AS name, 'circular=' || CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END || CASE WHEN c_custkey % 2 = 0 THEN ' Tool_cluster_weight=3' ELSE '' END AS rest FROM customer WHERE c_custkey % 5 > 0 AND c_custkey % 7 > 0 AND c_custkey % 11 > 0
    UNION ALL SELECT c_custkey, c_name, 'circular=' || CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END || CASE WHEN c_custkey % 5 = 0 THEN ' Tool_cluster_weight=' || (c_custkey % 4) ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN ' Tool_trusted' ELSE '' END
      || CASE WHEN c_custkey % 11 = 0 THEN ' Tool_consensus_weight=2' ELSE '' END || CASE WHEN c_custkey % 2 = 0 AND NOT (c_custkey % 5 = 0 AND c_custkey % 4 = 3) THEN ' Tool_cluster_weight=3' ELSE '' END FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0"""
)
def header_weights(spark, sf_dir):
    header = S.with_attribute(F.col("contig_header"), "Tool_cluster_weight=3", "circular=True")
    return _contigs(spark, sf_dir).select("seq_id", S.first_token(header).alias("name"), S.rest_of_header(header).alias("rest"))


@query("SELECT o_orderkey, ((o_orderkey + 3) // 7)::BIGINT AS quotient, round(25.0 * log2(4 * (o_totalprice / 1000) / 25.0) / 2 / (o_totalprice / 1000) * 1000)::BIGINT AS reads FROM orders WHERE o_totalprice >= 25000")
def subset_sizes(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_totalprice >= 25000")
    return orders.select("o_orderkey", S.rounded_div(F.col("o_orderkey"), 7).alias("quotient"), T.subset_reads(F.col("o_totalprice"), F.lit(1000), F.lit(1000.0), 25.0).alias("reads"))


# ---------------------------------------------------------------- side files, reads, choices


@query("SELECT 'p' || p_partkey AS name, repeat('A', p_size) AS seq, CASE p_partkey % 3 WHEN 0 THEN p_size / 2 WHEN 1 THEN p_size::DOUBLE END AS depth FROM part")
def sidefile_depths(spark, sf_dir):
    half = F.concat(F.floor(F.col("p_size") / 2), F.when(F.col("p_size") % 2 == 0, ".0").otherwise(".5"))
    tag = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("\tdp:f:"), half)).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("\trd:i:"), "p_size")).otherwise("\tLN:i:5")
    lines = table(spark, sf_dir, "part").select(F.concat(F.lit("S\tp"), "p_partkey", F.lit("\t"), F.repeat(F.lit("A"), F.col("p_size")), tag).alias("value"))
    contigs = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("name"))
    return sidefiles.with_depths(contigs, sidefiles.graph_depths(lines))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN substr(p_name, 3, p_size % 5 + 1) ELSE p_name END AS seq FROM part WHERE p_size % 3 > 0 AND p_size % 7 > 0")
def canu_contigs(spark, sf_dir):
    size = F.col("p_size")
    header = F.concat(
        F.lit("tig suggestRepeat="), F.when(size % 3 == 0, "yes").otherwise("no"), F.lit(" suggestBubble="), F.when(size % 7 == 0, "yes").otherwise("no"),
        F.lit(" suggestCircular="), F.when(size % 2 == 0, "yes").otherwise("no"), F.lit(" trim=2-"), size % 5 + 3,
    )
    return sidefiles.canu_contigs(table(spark, sf_dir, "part").select("p_partkey", header.alias("header"), F.col("p_name").alias("seq"))).select("p_partkey", "seq")


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 0.9 * 150000 AND 1.2 * 150000) AS assembler FROM orders GROUP BY 1")
def chosen_assembly(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("assembler"), F.col("o_orderkey").alias("place"), (F.col("o_orderstatus") == "O").alias("resolved"), F.col("o_totalprice").alias("size"), F.lit(150000.0).alias("genome"))
    return R.chosen_assembly(runs, ["o_custkey"], "size", "genome", 0.9, 1.2)


@query("SELECT printf('sample_%02d', turn % 4 + 1) AS folder, '@r' || conv_id || chr(10) || coalesce(text, '') || chr(10) || '+' || chr(10) || repeat('I', length(coalesce(text, ''))) AS value FROM conversations")
def subset_records(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    reads = table(spark, sf_dir, "conversations").select((F.col("turn") % 4 + 1).alias("subset"), F.col("conv_id").alias("read_idx"), F.concat(F.lit("r"), "conv_id").alias("name"), text.alias("seq"), F.repeat(F.lit("I"), F.length(text)).alias("qual"))
    return O.subset_files(reads).select("folder", "value")


# ---------------------------------------------------------------- k-mers on both strands, end repair

_BENCH = "b AS (SELECT item_id AS seq_id, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS seq FROM benchmark), p AS (SELECT seq_id, seq, repeat('.', 4) || seq || repeat('.', 4) AS s FROM b), both_ AS (SELECT seq_id, true AS strand, s FROM p WHERE length(seq) >= 9 UNION ALL SELECT seq_id, false, reverse(translate(s, 'ACGT', 'TGCA')) FROM p WHERE length(seq) >= 9)"


def _bench(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.lit("s").alias("sample_id"), F.col("item_id").alias("seq_id"), S.dna_letters(F.col("text")).alias("seq"))


@query(f"WITH {_BENCH}, k AS (SELECT seq_id, strand, unnest(range(0, length(s) - 8)) AS pos, unnest(list_transform(range(1, length(s) - 7), lambda i: substr(s, i, 9))) AS kmer FROM both_) SELECT seq_id, strand, pos::INT AS pos, kmer FROM k")
def strand_kmers(spark, sf_dir):
    return K.kmer_positions(_bench(spark, sf_dir), 9).select("seq_id", "strand", F.col("pos").cast("int").alias("pos"), "kmer")


@query(
    f"""WITH {_BENCH}, every AS (SELECT s FROM p UNION ALL SELECT reverse(translate(s, 'ACGT', 'TGCA')) FROM p), w AS (SELECT w, count(*) AS c, 8 - length(replace(w, '.', '')) AS dots FROM (SELECT unnest(list_transform(range(1, length(s) - 6), lambda i: substr(s, i, 8))) AS w FROM every WHERE length(s) >= 8) GROUP BY w),
    st AS (SELECT substr(w, 5, 4) AS key, arg_min(w, (dots, -c, w)) AS w FROM w GROUP BY 1), en AS (SELECT substr(w, 1, 4) AS key, arg_min(w, (dots, -c, w)) AS w FROM w GROUP BY 1)
    SELECT seq_id, CASE WHEN length(seq) >= 9 THEN st.w || substr(s, 9, length(s) - 16) || en.w ELSE s END AS padded_seq FROM p LEFT JOIN st ON st.key = substr(s, 5, 4) LEFT JOIN en ON en.key = substr(s, length(s) - 7, 4)"""
)
def repaired_ends(spark, sf_dir):
    return K.repair_ends(_bench(spark, sf_dir), 9).select("seq_id", "padded_seq")


@query(
    f"""WITH {_BENCH}, every AS (SELECT seq_id, true AS strand, s FROM p UNION ALL SELECT seq_id, false, reverse(translate(s, 'ACGT', 'TGCA')) FROM p), o AS (SELECT seq_id, strand, unnest(range(1, length(s) - 6)) AS pos, unnest(list_transform(range(1, length(s) - 6), lambda i: substr(s, i, 8))) AS w FROM every WHERE length(s) >= 8),
    e AS (SELECT DISTINCT 's' AS side, substr(s, 5, 4) AS key FROM p WHERE length(seq) >= 9 UNION SELECT DISTINCT 'e', substr(s, length(s) - 7, 4) FROM p WHERE length(seq) >= 9),
    m AS (SELECT seq_id, strand, side, key, pos, w FROM o JOIN e ON key = CASE WHEN side = 's' THEN substr(w, 5, 4) ELSE substr(w, 1, 4) END),
    g AS (SELECT seq_id, strand, side, key, unnest(list_reduce(list_transform(list_sort(list(pos)), lambda x: [x]), lambda a, b: CASE WHEN b[1] >= a[-1] + 8 THEN list_concat(a, b) ELSE a END)) AS pos FROM m GROUP BY seq_id, strand, side, key),
    c AS (SELECT side, key, w, count(*) AS c, 8 - length(replace(w, '.', '')) AS dots FROM m JOIN g USING (seq_id, strand, side, key, pos) GROUP BY side, key, w),
    f AS (SELECT side, key, arg_min(w, (dots, -c, w)) AS w FROM c GROUP BY side, key)
    SELECT seq_id, CASE WHEN length(seq) >= 9 THEN st.w || substr(s, 9, length(s) - 16) || en.w ELSE s END AS padded_seq FROM p LEFT JOIN f st ON st.side = 's' AND st.key = substr(s, 5, 4) LEFT JOIN f en ON en.side = 'e' AND en.key = substr(s, length(s) - 7, 4)"""
)
def repaired_ends_apart(spark, sf_dir):
    return K.repair_ends(_bench(spark, sf_dir), 9, apart=True).select("seq_id", "padded_seq")


# ---------------------------------------------------------------- graphs of many samples


def _clusters(spark, sf_dir) -> DataFrame:
    """Graph rows: a customer is a cluster, its orders are unitigs in a chain; one order is a loop."""
    own = Window.partitionBy("cluster").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("sample_id"), F.col("o_custkey").cast("int").alias("cluster"), "o_orderkey")
    base = orders.withColumn("number", F.row_number().over(own))
    unitigs = base.select("sample_id", "cluster", "number", F.repeat(F.lit("A"), (F.col("o_orderkey") % 50 + 1).cast("int")).alias("seq"), (F.col("o_orderkey") % 8 / 4).alias("depth"))
    n = base.groupBy("sample_id", "cluster").agg(F.max("number").alias("n"))
    chain = base.join(n, ["sample_id", "cluster"]).where("number < n or n = 1").select("sample_id", "cluster", F.col("number").alias("src"), F.when(F.col("n") == 1, 1).otherwise(F.col("number") + 1).alias("dst"))
    links = chain.unionByName(chain.select("sample_id", "cluster", (-F.col("dst")).alias("src"), (-F.col("src")).alias("dst")))
    return graph_rows(unitigs, links, base.select("sample_id", "cluster", F.col("cluster").alias("seq_id"), F.col("number").alias("idx"), F.col("number").alias("unitig")), ["sample_id", "cluster"])


_COMB = """u AS (SELECT 's' || (o_custkey % 5) AS sample_id, o_custkey AS cluster, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number, o_orderkey % 50 + 1 AS len, o_orderkey % 8 AS d FROM orders),
pc AS (SELECT sample_id, cluster, count(*) AS n, sum(len) AS total FROM u GROUP BY ALL), off AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY sample_id ORDER BY total DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off, row_number() OVER (PARTITION BY sample_id ORDER BY total DESC, cluster) AS place FROM pc)"""


@query(f"WITH {_COMB} SELECT sample_id, (number + off)::INT AS number, cluster::INT AS cluster, len::BIGINT AS length, CASE WHEN n = 1 THEN 'circular' ELSE '' END AS shape FROM u JOIN off USING (sample_id, cluster)")
def combined_unitigs(spark, sf_dir):
    return O.combined(_clusters(spark, sf_dir)).unitigs.select("sample_id", "number", "cluster", F.length("seq").cast("bigint").alias("length"), "shape")


@query(
    f"""WITH {_COMB}, f AS (SELECT sample_id, number + off AS x, CASE WHEN n = 1 THEN number + off ELSE number + off + 1 END AS y FROM u JOIN off USING (sample_id, cluster) WHERE number < n OR n = 1)
    SELECT sample_id, x::INT AS src, y::INT AS dst FROM f UNION ALL SELECT sample_id, -y::INT, -x::INT FROM f"""
)
def combined_links(spark, sf_dir):
    return O.combined(_clusters(spark, sf_dir)).links


@query(f"WITH {_COMB} SELECT sample_id, cluster::INT AS cluster, place::INT AS place, total::BIGINT AS length, n::BIGINT AS unitigs, CASE WHEN n = 1 THEN 'circular' ELSE 'fragmented' END AS topology FROM off")
def combined_clusters(spark, sf_dir):
    return O.combined(_clusters(spark, sf_dir)).clusters.drop("read_depth")


@query(f"WITH {_COMB} SELECT sample_id, sum(total)::BIGINT AS consensus_assembly_bases, sum(n)::BIGINT AS consensus_assembly_unitigs, max(n) = 1 AS consensus_assembly_fully_resolved FROM off GROUP BY 1")
def combined_totals(spark, sf_dir):
    return O.combined(_clusters(spark, sf_dir)).totals


@query(
    f"""WITH {_COMB} SELECT sample_id, '>' || (number + off)::BIGINT || ' length=' || len || CASE WHEN n = 1 THEN ' circular=true topology=circular' ELSE '' END || chr(10) || repeat('A', len::INT) AS value FROM u JOIN off USING (sample_id, cluster)"""
)
def combined_fasta(spark, sf_dir):
    return O.combined_fasta(O.combined(_clusters(spark, sf_dir)), False).select("sample_id", "value")


@query(
    """WITH s AS (SELECT o_custkey AS cluster, o_orderkey AS sq, l_linenumber AS u FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL), n AS (SELECT cluster, count(DISTINCT sq) AS n FROM s GROUP BY 1)
    SELECT cluster::INT AS cluster, u::INT AS number, count(*)::DOUBLE AS depth, CASE WHEN count(*) = any_value(n) THEN 'anchor' ELSE 'other' END AS type FROM s JOIN n USING (cluster) GROUP BY cluster, u HAVING count(*) = any_value(n)"""
)
def bridged_anchors(spark, sf_dir):
    """Orders of a customer visit its line numbers in order: what every order visits is an anchor, and
    the bridges between neighbouring anchors are direct links or unambiguous."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    steps = lines.select(F.lit("s").alias("sample_id"), F.col("o_custkey").cast("int").alias("cluster"), F.col("l_orderkey").cast("int").alias("seq_id"), F.col("l_linenumber").cast("int").alias("unitig")).distinct().withColumn("idx", F.col("unitig"))
    unitigs = steps.groupBy("sample_id", "cluster", F.col("unitig").alias("number")).agg(F.count(F.lit(1)).alias("depth")).withColumn("seq", F.repeat(F.lit("A"), F.col("number")))
    follow = steps.withColumn("dst", F.lead("unitig").over(Window.partitionBy("cluster", "seq_id").orderBy("idx"))).where("dst is not null")
    rows = graph_rows(unitigs, follow.select("sample_id", "cluster", F.col("unitig").alias("src"), "dst").distinct(), steps, ["sample_id", "cluster"])
    made, _, _ = unpacked(bridged(rows), ["sample_id", "cluster"])
    return made.where("type = 'anchor'").select("cluster", "number", "depth", "type")
