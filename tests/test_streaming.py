"""A stream of reads counts like the same reads at once."""

from strandweave.operators.kmers import count_canonical
from strandweave.streaming.read_counts import kmer_counts


def test_stream(spark, tmp_path):
    reads = [(1, "ACGATTGCCAG"), (2, "CTGGCAATCGT"), (3, "TTTTTTTTTTT"), (4, "ACG")]
    for i, r in enumerate(reads):
        spark.createDataFrame([r], "read_id bigint, seq string").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    table = count_canonical(spark.createDataFrame([("ACGATTGCCAG",)], "seq string"), "seq", 5)
    source = spark.readStream.schema("read_id bigint, seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = kmer_counts(source, table, 5).writeStream.outputMode("complete").format("memory").queryName("counts")
    query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.kmer: r.n for r in spark.table("counts").collect()}
    once = {r.kmer: r.n for r in kmer_counts(spark.createDataFrame(reads, "read_id bigint, seq string"), table, 5).collect()}
    assert got == once and len(got) == 7 and set(got.values()) == {2}
