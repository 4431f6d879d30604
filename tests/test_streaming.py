from driftlens.operators import markov
from driftlens.streaming import scoring
from pyspark.sql import functions as F


def test_streamed_transitions_are_those_of_the_batch(spark, tmp_path):
    rows = [(s, t, "abc"[(s + t * t) % 3]) for s in range(4) for t in range(30)]
    schema = "series_id long, t long, label string"
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 10 == part], schema).coalesce(1).write.parquet(f"{tmp_path}/in/part{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part*")
    out = scoring.transitions(stream).writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    got = {(r.next_state, r.cur_state): r.n for r in spark.table("streamed").groupBy("next_state", "cur_state").agg(F.sum("n").alias("n")).collect()}
    want = {(r.next_state, r.cur_state): r.n for r in markov.transitions(spark.createDataFrame(rows, schema)).collect() if r.n}
    assert sum(got.values()) == sum(want.values()) and got == want
