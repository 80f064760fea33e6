"""Events, batch completion and whole runs."""

import datetime as dt

from pyspark.sql import functions as F

from quillstone import catalog
from quillstone.operators import events, models
from quillstone.plans import pipeline
from quillstone.streaming import batches


def test_progress(spark):
    e = spark.createDataFrame([("b", "1", "completed"), ("b", "1", "completed"), ("b", "2", "error"), ("c", "3", "progress")], "batch_id string, task_id string, event string")
    got = {r.batch_id: (r.done, r.left, r.complete) for r in events.batch_progress(e, spark.createDataFrame([("b", 2), ("c", 1)], "batch_id string, total int")).collect()}
    assert got == {"b": (2, 0, True), "c": (0, 1, False)}


def test_completion_once_per_batch(spark, tmp_path):
    schema = "batch_id string, task_id string, event string, total int, ts timestamp"
    src = tmp_path / "in"
    for i, rows in enumerate(([("b", "1", "completed", 2), ("b", "1", "completed", 2)], [("b", "2", "error", 2), ("c", "9", "progress", 1)], [("b", "2", "completed", 2)])):
        spark.createDataFrame([(*r, dt.datetime(2025, 1, 1, i)) for r in rows], schema).coalesce(1).write.parquet(str(src / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
    q = batches.batch_completions(stream).writeStream.format("memory").queryName("done").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert [tuple(r) for r in spark.table("done").collect()] == [("b", 2, "batch_completed")]


def test_task_states_stream_equals_batch(spark, tmp_path):
    rows = [("t", "started", dt.datetime(2025, 1, 1)), ("t", "completed", dt.datetime(2025, 1, 2)), ("u", "started", dt.datetime(2025, 1, 1))]
    df = spark.createDataFrame(rows, "task_id string, event string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    q = batches.task_states(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, events.latest(df).collect()))


def test_states_are_forgotten(spark, tmp_path):
    schema = "task_id string, event string, ts timestamp"
    for i, day in enumerate((1, 20, 40)):
        spark.createDataFrame([(f"t{i}", "started", dt.datetime(2025, 1, 1) + dt.timedelta(days=day))], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = batches.task_states(stream).writeStream.format("memory").queryName("forgotten").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(r.task_id for r in spark.table("forgotten").collect()) == ["t0", "t1", "t2"]
    assert q.lastProgress.stateOperators[0].numRowsTotal < 3


def test_batch_without_total_waits(spark, tmp_path):
    schema = "batch_id string, task_id string, event string, total int, ts timestamp"
    for i, (task, total) in enumerate((("1", None), ("2", 2))):
        spark.createDataFrame([("b", task, "completed", total, dt.datetime(2025, 1, 1, i))], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = batches.batch_completions(stream).writeStream.format("memory").queryName("waits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [tuple(r) for r in spark.table("waits").collect()] == [("b", 2, "batch_completed")]


def test_json_or_raw(spark):
    got = spark.createDataFrame([('{"a": 1}',), ("oops",)], "x string").select(F.to_json(events.json_or_raw(F.col("x"))).alias("y")).collect()
    assert [r.y for r in got] == ['{"a":1}', '{"raw_response":"oops"}']


def test_model_errors_are_rows(spark):
    class Failing(models.OfflineModel):
        def read(self, image, prompt, max_tokens):
            raise RuntimeError("down")

    df = spark.createDataFrame([(b"x", "p")], "image binary, prompt string")
    (r,) = models.read_pages(df, make=Failing).select(models.shown(F.col("result"), F.col("error")).alias("s")).collect()
    assert r.s == "API Error: down"


def test_extraction_errors_are_told(spark):
    class Failing(models.OfflineModel):
        def extract(self, text, prompt):
            raise RuntimeError("no answer")

        def review(self, document, images):
            raise AssertionError("a failed extraction isn't reviewed")

    images = spark.createDataFrame([("f", "/f", i, bytes([i] * 9)) for i in range(8)], "pdf_name string, pdf_path string, page_num int, image binary")
    done = pipeline.run(images, make=Failing)
    assert [(r.extract_error, r.validation) for r in done.collect()] == [("no answer", None)]
    assert "image_paths" not in done.columns
    told = {r.event: (r.message, r.done) for r in pipeline.terminal_events(done, "b").collect()}
    assert told == {"error": ("no answer", None), "batch_completed": ("1 failed", 1)}


def test_boxes_are_found_once(spark, tmp_path):
    class Counting(models.OfflineModel):
        def layout(self, image):
            with open(tmp_path / "calls", "a") as f:
                f.write("x")
            return super().layout(image)

    images = spark.createDataFrame([("f", "/f", i, bytes([i] * 9)) for i in range(20)], "pdf_name string, pdf_path string, page_num int, image binary")
    pipeline.prepare(images, "default", make=Counting).count()
    assert len((tmp_path / "calls").read_text()) == 20


def test_run_covers_every_file(spark):
    images = spark.createDataFrame([(f"f{i % 5}", f"/f{i % 5}", i, bytes([i] * 9)) for i in range(40)], "pdf_name string, pdf_path string, page_num int, image binary")
    for template in ("default", "janzour", "massara"):
        got = pipeline.run(images, template).select("pdf_name", (F.size("pages") + F.size("skipped_pages")).alias("n"), F.col("validation").isNull().alias("bypassed")).collect()
        assert sorted((r.pdf_name, r.n) for r in got) == [(f"f{i}", 8) for i in range(5)]
        assert all(r.bypassed == (template != "default") for r in got)


def test_catalog_names(spark):
    assert set(catalog.SQL) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) > 50


def test_published_events_come_back(spark, tmp_path):
    schema = "task_id string, event string, ts timestamp"
    spark.createDataFrame([("t", "completed", None)], schema).write.parquet(str(tmp_path / "in"))
    q = batches.publish(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(90)
    q = batches.subscribe(spark, str(tmp_path / "out")).writeStream.format("memory").queryName("heard").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert [tuple(r) for r in spark.table("heard").collect()] == [("task_updates:t", '{"task_id":"t","event":"completed","ts":null}')]
