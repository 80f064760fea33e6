"""Scanned files in and results out, through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.text import file_name
from quillstone.operators.pages import page_id


def scan_pdfs(spark: SparkSession, path: str, template: str | None = None) -> DataFrame:
    """PDF files under a path with their names; other files are left out."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    named = files.withColumn("pdf_path", F.col("path")).withColumn("pdf_name", file_name(F.col("path")))
    return named.withColumn("template", F.lit(template).cast("string"))


def only_pdfs(df: DataFrame, name: str = "filename") -> DataFrame:
    """Rows of PDF files, whatever the case of the ending."""
    return df.where(F.lower(name).endswith(".pdf"))


def scan_page_images(spark: SparkSession, path: str) -> DataFrame:
    """Rendered pages `.../<pdf name>/page_<n>.png`, numbered from 0; files that aren't PNG or JPEG images are skipped pages (Spark doesn't list empty files)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "page_*.{png,jpg}").option("recursiveFileLookup", "true").load(path)
    number = F.regexp_extract("path", r"page_(\d+)(?:_processed)?\.\w+$", 1).cast("int") - 1
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("pdf_name"), F.col("path").alias("pdf_path"), number.alias("page_num"), F.col("content").alias("image"))
    return rows.withColumn("status", F.when(F.hex(F.substring("image", 1, 2)).isin("8950", "FFD8"), "ok").otherwise("skipped")).withColumn("page_uuid", page_id(F.col("pdf_path"), F.col("page_num")))


def write_images(df: DataFrame, path: str) -> None:
    """Processed page images as binary columns, with the names their files would have."""
    name = F.concat(F.lit("page_"), (F.col("page_num") + 1).cast("string"), F.lit("_processed.png"))
    df.select("pdf_name", "page_num", name.alias("name"), "image").write.mode("append").partitionBy("pdf_name").parquet(path)


def write_interim(groups: DataFrame, path: str) -> None:
    """Page groups per batch; the natural place to cut lineage."""
    groups.write.mode("append").partitionBy("batch_id").json(path)


def read_interim(spark: SparkSession, path: str, schema: str, listing: DataFrame | None = None) -> DataFrame:
    """Page groups; without image paths those of the batch's processed files stand in, sorted."""
    groups = spark.read.schema(schema).json(path)
    if listing is None:
        return groups
    found = listing.where(F.col("path").rlike(r"_processed\.(png|jpg)$")).groupBy("batch_id").agg(F.array_sort(F.collect_list("path")).alias("_found"))
    return groups.join(found, "batch_id", "left").withColumn("image_paths", F.when(F.size("image_paths") > 0, F.col("image_paths")).otherwise(F.coalesce("_found", F.expr("cast(array() as array<string>)")))).drop("_found")


def result_path(task: Column, root: str = "storage/results") -> Column:
    """S13."""
    return F.concat(F.lit(f"{root}/"), task, F.lit(".json"))


def expired(listing: DataFrame, now: Column, hours: int = 72) -> DataFrame:
    """Files older than their time to live."""
    return listing.where(F.col("modificationTime") < now - F.make_interval(hours=F.lit(hours)))


def sweep(spark: SparkSession, path: str, now: Column | None = None, hours: int = 72) -> int:
    """Delete the files under a path that are older than their time to live; how many went. Run it hourly."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime")
    old = expired(listing, F.current_timestamp() if now is None else now, hours).select("path")
    files, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for r in old.toLocalIterator():  # one name at a time
        name = files.Path(r.path)
        gone += name.getFileSystem(conf).delete(name, False)
    return gone


def encoded(image: Column) -> Column:
    """base64 of an image's bytes; empty without one."""
    return F.coalesce(F.base64(image), F.lit(""))


def origins(text: Column) -> Column:
    """A JSON list of strings; everything where it isn't one."""
    parsed = F.from_json(text, "array<string>", {"mode": "PERMISSIVE"})
    return F.when(F.try_parse_json(text).isNotNull() & (F.size(parsed) > 0), parsed).otherwise(F.array(F.lit("*")))
