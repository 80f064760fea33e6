"""Files in and out."""

import os
import struct

from pyspark.sql import Observation
from pyspark.sql import functions as F

from quillstone.functions.geometry import png_size
from quillstone.operators import models, router
from quillstone.plans import pipeline
from quillstone.sources import files

PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 600, 1000)


def test_scans(spark, tmp_path):
    for name in ("a.pdf", "b.PDF", "c.txt", "sub/d.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF")
    got = {r.pdf_name for r in files.scan_pdfs(spark, str(tmp_path), "janzour").collect()}
    assert len(got) == 3
    names = spark.createDataFrame([("x.PdF",), ("y.doc",)], "filename string")
    assert [r.filename for r in files.only_pdfs(names).collect()] == ["x.PdF"]


def test_page_images_and_sinks(spark, tmp_path):
    (tmp_path / "in/doc").mkdir(parents=True)
    (tmp_path / "in/doc/page_2.png").write_bytes(PNG)
    (tmp_path / "in/doc/page_10.png").write_bytes(b"no image")
    read = files.scan_page_images(spark, str(tmp_path / "in"))
    assert sorted((r.pdf_name, r.page_num, r.status) for r in read.collect()) == [("doc", 1, "ok"), ("doc", 9, "skipped")]
    files.write_images(read, str(tmp_path / "out"))
    assert {r.name for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"page_2_processed.png", "page_10_processed.png"}
    groups = spark.createDataFrame([("b", "doc", [])], "batch_id string, pdf_name string, image_paths array<string>")
    files.write_interim(groups, str(tmp_path / "interim"))
    listing = spark.createDataFrame([("b", "/x/page_2_processed.png"), ("b", "/x/page_1_processed.jpg"), ("b", "/x/page_1.png")], "batch_id string, path string")
    (back,) = files.read_interim(spark, str(tmp_path / "interim"), "batch_id string, pdf_name string, image_paths array<string>", listing).collect()
    assert back.image_paths == ["/x/page_1_processed.jpg", "/x/page_2_processed.png"]


def test_sweep(spark, tmp_path):
    for name, age in (("old.json", 100), ("new.json", 1)):
        (tmp_path / name).write_text("{}")
        at = (tmp_path / name).stat().st_mtime - age * 3600
        os.utime(tmp_path / name, (at, at))
    assert files.sweep(spark, str(tmp_path)) == 1
    assert [p.name for p in tmp_path.glob("*.json")] == ["new.json"]


def test_run_reads_the_planned_part(spark):
    class Cutting(models.OfflineModel):
        def layout(self, image):
            return [{"label": x, "score": 0.9, "x1": 0, "y1": y, "x2": 500, "y2": y + 30} for x, y in (("doc_title", 100), ("table", 300), ("footer", 800))]

        def codes(self, image):
            return [{"label": "barcode", "score": 1.0, "x1": 100, "y1": 100, "x2": 200, "y2": 150}]

        def cut(self, image, crop, blank, turn):
            return repr((turn, sorted(crop.items()), [sorted(b.items()) for b in blank])).encode()

    rows = spark.createDataFrame([(PNG,)], "image binary")
    assert tuple(rows.select(png_size(F.col("image")).alias("s")).first().s) == (600, 1000)
    assert rows.select(png_size(F.lit(b"GIF")).alias("s")).first().s is None
    images = spark.createDataFrame([("f", "/f", 0, PNG)], "pdf_name string, pdf_path string, page_num int, image binary")
    seen = Observation("run")
    (done,) = pipeline.run(images, make=Cutting, progress=seen).collect()
    assert seen.get == {"files": 1, "failed": 0}
    crop = [("x1", 0), ("x2", 600), ("y1", 100), ("y2", 850)]
    blank = [("x1", 90), ("x2", 210), ("y1", 80), ("y2", 170)]
    assert done.pages[0].text == repr((0, crop, [blank]))


def test_card_plan(spark):
    boxes = "array<struct<label:string,score:double,x1:int,y1:int,x2:int,y2:int>>"
    rows = [(1, [("image", 0.9, 110, 510, 150, 540), ("image", 0.9, 0, 0, 900, 900)], [("qr", 1.0, 100, 500, 200, 600)], ("card", 5.8, False), 1000, 1000, 0)]
    df = spark.createDataFrame(rows, f"i int, boxes {boxes}, codes {boxes}, route struct<crop:string,right:double,footer_shift:boolean>, width int, height int, turn int")
    (r,) = router.crop_plan(df).collect()
    assert tuple(r.crop) == (100, 200, 680, 600)
    assert [tuple(b) for b in r.blank] == [(110, 510, 150, 540)]
