from pyspark.sql import functions as F

from passel.operators.corpus import hash_shards
from passel.plans.corpus import embed_passages, passages
from passel.streaming.ingest import ingest, read_documents


def raw(frame):
    key = F.col("doc_id").cast("string")
    return frame.select(key.alias("id"), F.col("source").alias("domain"), key.alias("source_id"), F.lit("").alias("title"), F.lit("").alias("url"), "text")


def test_stream_gives_the_same_passages_once(spark, tables, tmp_path):
    """Two arrivals, each ingested when it is there, equal one batch; a restart adds nothing."""
    documents = spark.read.parquet(f"{tables}/documents.parquet")
    inbox, target, checkpoint = (str(tmp_path / n) for n in ("inbox", "target", "checkpoint"))
    want = hash_shards(embed_passages(passages(raw(documents))), 8)
    halves = [documents.where(F.col("doc_id") % 2 == r) for r in (0, 1)]
    for half in (*halves, None):
        if half is not None:
            half.coalesce(2).write.mode("append").parquet(inbox)
        stream = raw(read_documents(spark, inbox, documents.schema, 1))
        query = ingest(stream, target, checkpoint)
        query.awaitTermination(120)
        assert query.exception() is None
    got = spark.read.parquet(target)
    columns = ["uid", "id", "chunk_id", "chunk_tokens", "embedding", "shard"]
    assert got.count() == want.count()
    assert got.select(*columns).exceptAll(want.select(*columns)).count() == 0
