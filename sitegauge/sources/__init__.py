"""sitegauge.sources"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of an input of few files out to all cores.

    A file of one row group is read by one task however large the cluster, and would keep
    one core busy with what follows; inputs of at least half as many files as there are
    cores pass unchanged, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 2 <= cores else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a dataset folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: What a source tree is searched for (fixed values).
SOURCE_ENDINGS = ("js", "jsx", "ts", "tsx", "vue", "html", "htm", "mdx", "css")
SKIPPED_FOLDERS = ("node_modules", ".git", "dist", "build", ".next", "coverage", "out")


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` (below the folder) and ``content`` of the source files of a tree."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{" + ",".join(SOURCE_ENDINGS) + "}")
    path = F.regexp_replace(F.col("_metadata.file_path"), "^.*?" + folder.rstrip("/").replace(".", r"\.") + "/", "")
    rows = files.select(path.alias("path"), F.col("value").alias("content"))
    return rows.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))))


def feedback_json(spark: SparkSession, path: str) -> DataFrame:
    """``id, message, created_at`` of a JSON array; rows that are no notes are dropped, a file
    that is none gives no rows."""
    rows = spark.read.schema("id string, message string, createdAt string").json(path, multiLine=True, mode="DROPMALFORMED")
    return rows.filter("id is not null and message is not null").select("id", "message", F.col("createdAt").alias("created_at"))


def url_lists(spark: SparkSession, path: str) -> DataFrame:
    """``file, n, line`` of text files that hold addresses separated by commas."""
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("line"))
    return rows


def direct_pages(spark: SparkSession, texts: list[str]) -> DataFrame:
    """``page_id, url, html`` of pages given as text, trimmed; blank ones have no html."""
    rows = [(k, None, (t or "").strip() or None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def append_notes(notes: DataFrame, path: str) -> None:
    """Adds ``id, message, created_at`` to a folder of notes; every call writes files of its own."""
    notes.select("id", "message", F.col("created_at").alias("createdAt")).write.mode("append").json(path)


def write_reports(reports: DataFrame, path: str, most_snippet: int = 450) -> None:
    """Reports as JSON lines, snippets cut for reading, one folder per grade."""
    told = F.transform("criteria", lambda c: c.withField("issues", F.transform(c["issues"], lambda i: i.withField("html_snippet", F.substring(i["html_snippet"], 1, most_snippet)))))
    reports.withColumn("criteria", told).write.mode("overwrite").partitionBy("grade").json(path)
