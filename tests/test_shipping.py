"""The package as workers get it: from the shipped zip, away from the repository."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from quillstone.functions import html
from quillstone.operators import headers, models
from quillstone.streaming import batches
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.executor.memory", "1g").config("spark.sql.shuffle.partitions", "1").getOrCreate()
rows = spark.createDataFrame([("<table><tr><td>x</td></tr></table>",)], "html string")
assert html.table_rows(rows, "html").select("rows.cells").first()[0] == [["x"]]
assert headers.invoice_header(rows, "html").count() == 1
assert models.boxes(rows.selectExpr("cast(html as binary) image")).first().boxes is not None
seen = rows.select((__import__("pyspark").sql.functions.udf(lambda _: __import__("quillstone.functions.html").__file__))("html")).first()[0]
assert ".zip" in seen, seen
print("SHIPPED")
spark.stop()
"""


def test_workers_import_from_the_zip(tmp_path):
    root = Path(__file__).resolve().parent.parent
    # only the driver's Python finds the repository; executors and their workers start elsewhere
    (tmp_path / "script.py").write_text(f"import sys\nsys.path.insert(0, {str(root)!r})\n" + SCRIPT)
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_SUBMIT_ARGS", "SPARK_HOME")}
    env["PYSPARK_PYTHON"] = sys.executable
    run = subprocess.run([sys.executable, "script.py"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "SHIPPED" in run.stdout, run.stderr[-3000:]


def test_settled_tables_are_forgotten(spark):
    from quillstone import runtime

    kept = runtime.settle(spark.range(5), "kept")
    folder = Path(kept.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists()
    assert runtime.forget(spark) >= 1
    assert not folder.exists()
