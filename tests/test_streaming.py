from gaugewright.sources.documents import load_task_bundle
from gaugewright.streaming import monitor

from . import demo


def test_monitor(spark, tmp_path):
    rows = demo.four_runs()
    rows[3]["c1"] = 99.0
    rows[12]["sensor_time_s"] = -1.0
    _, at = demo.write(tmp_path, rows, demo.task(d4=demo.D4))
    bundle = load_task_bundle(at)
    df = spark.read.csv(str(tmp_path / "data.csv"), header=True)
    source = tmp_path / "stream"
    df.withColumn("at", df["sensor_time_s"].cast("double").cast("timestamp")).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    q = monitor.not_increasing(stream, bundle, "reference_time_s").writeStream.format("memory").queryName("back").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    told = {r["run"]: r["n_not_increasing"] for r in spark.table("back").collect()}
    assert told == {"spiral_01": 0, "spiral_02": 1, "lissajous_01": 0, "lissajous_02": 0}
    q = monitor.findings_per_window(stream, bundle, "at").writeStream.format("memory").queryName("codes").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["code"] for r in spark.table("codes").collect()} == {"measurement_out_of_range", "synchronization_exceeded"}
