import math

from helpers import SEQS, sequence_table
from loglattice.operators import transitions
from loglattice.streaming.scoring import stream_surprise


def test_transitions_continue_across_batches(spark, tmp_path):
    table = transitions.train(sequence_table(spark, SEQS))
    schema = "row_id long, client_ip string, ts timestamp, label int"

    def write(rows):
        df = spark.createDataFrame(rows, "row_id long, client_ip string, t long, label int")
        df.selectExpr("row_id", "client_ip", "timestamp_seconds(t) AS ts", "label").write.mode("append").parquet(
            str(tmp_path / "in")
        )

    write([(0, "a", 10, 0), (1, "a", 20, 1), (2, "b", 5, 3)])
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = (
        stream_surprise(stream, table)
        .writeStream.format("memory")
        .queryName("surprise")
        .option("checkpointLocation", str(tmp_path / "state"))
        .start()
    )
    try:
        query.processAllAvailable()
        write([(3, "a", 30, 2), (4, "b", 40, 3)])
        query.processAllAvailable()
        write([(5, "a", 1, 0), (6, "a", 35, None)])  # too late for its client; no label
        query.processAllAvailable()
        got = {(r.client_ip, r.from_state, r.to_state): r.surprise for r in spark.table("surprise").collect()}
    finally:
        query.stop()
    assert set(got) == {("a", 0, 1), ("a", 1, 2), ("b", 3, 3)}
    assert got["a", 0, 1] == 1.0 and got["a", 1, 2] == 0.0 and got["b", 3, 3] == math.inf
