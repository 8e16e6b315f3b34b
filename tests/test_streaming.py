from pyspark.sql import functions as F

from linkloom.functions.text import prepare
from linkloom.operators import blocking
from linkloom.sources import tsv
from linkloom.sources.records import records
from linkloom.streaming.probe import probe


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    raw = records(spark, "/root/testdata/sf0.001").select("entity_id", "business_name", "business_address", "country")
    left, right = raw.where("entity_id like 'S1-%'"), prepare(raw.where("entity_id not like 'S1-%'")).persist()
    left.repartition(3).write.parquet(str(tmp_path / "in"))
    ours = prepare(left)
    postings = blocking.index(blocking.keys(right), blocking.shards(ours, right)).persist()
    stream = spark.readStream.schema(tsv.RECORD).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    probe(stream, postings, str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination(120)
    got = {(r["i"], r["j"], r["kscore"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    expected = {(r["i"], r["j"], r["kscore"]) for r in blocking.block(ours, right).collect()}
    assert got == expected and len({r["batch"] for r in spark.read.parquet(str(tmp_path / "out")).select(F.col("batch")).distinct().collect()}) == 3
