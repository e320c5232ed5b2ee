"""Text inputs: imported memories, markdown files, context files and JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema as S

REQUESTS = ("logInsight", "getContext", "recall", "getStats", "insertMemory", "importText", "getRecent", "consolidate", "fork")


def import_text(texts: DataFrame, extract: Callable[[Column], Column]) -> DataFrame:
    """Rows (id, data) of the items that ``extract`` (text -> array of strings) finds; blank texts and items give none."""
    items = texts.where(F.trim("text") != "").select("id", F.explode(extract(F.col("text"))).alias("data"))
    return items.where(F.trim("data") != "")


def parse_markdown(files: DataFrame) -> DataFrame:
    """Memories of markdown files (path, text): pairs of front matter and body between lines of three dashes.

    Front matter has tier, category, importance and tags; a file without such lines, or a pair with an empty body, gives none.
    """
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace("text", "\r\n", "\n"), F.lit("\n")), "\n---[ \\t]*(?=\n)")
    each = files.select("path", F.posexplode(parts).alias("n", "part"))
    order = Window.partitionBy("path").orderBy("n")
    pairs = each.withColumn("body", F.lead("part").over(order)).where((F.col("n") % 2 == 1) & (F.trim(F.coalesce("body", F.lit(""))) != ""))
    value = lambda key: F.nullif(F.trim(F.regexp_extract("part", rf"(?m)^\s*{key}\s*:[ \t]*(.*)$", 1)), F.lit(""))
    tags = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(value("tags"), F.lit("")), r"[\[\]]", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    tier = F.when(value("tier") == "semantic", "semantic").otherwise("episodic")
    return pairs.select("path", F.floor(F.col("n") / 2).alias("n"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("data"), tier.alias("tier"), value("category").alias("category"), F.coalesce(value("importance").try_cast("double"), F.lit(0.0)).alias("importance"), tags.alias("tags"))


def context_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a context folder: path, session, modified, bytes and text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ctx").load(folder)
    session = F.element_at(F.split("path", "/"), -2)
    return files.select("path", session.alias("session_id"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), F.col("content").cast("string").alias("text"))


def named_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows (name, text) of those of a few ``paths`` that exist, read on the executors; any store that Spark reads will do."""
    found = []
    for name in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at) and fs.getFileStatus(at).isFile():
            found.append((name, fs.getFileStatus(at).getPath().toString()))
    if not found:
        return spark.createDataFrame([], "name string, text string")
    read = spark.read.format("binaryFile").load([path for _, path in found]).select("path", F.col("content").cast("string").alias("text"))
    return spark.createDataFrame(found, "name string, path string").join(read, "path").select("name", "text")


def recent_files(files: DataFrame, limit: int = S.CONTEXT_FILES) -> DataFrame:
    """The newest ``limit`` files of each session."""
    newest = Window.partitionBy("session_id").orderBy(F.desc("modified"), "path")
    return files.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")


def files_text(files: DataFrame) -> DataFrame:
    """One row with the texts of context files, the newest first."""
    listed = files.agg(F.array_sort(F.collect_list(F.struct((-F.col("modified").cast("double")).alias("age"), "path", "text"))).alias("_l"))
    return listed.select(F.array_join(F.col("_l.text"), "\n\n---\n\n").alias("files"))


def disk_stats(files: DataFrame, as_of: Column) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.max(as_of.cast("double") - F.col("modified").cast("double")).alias("oldest_age_s"))


def stale_files(files: DataFrame, insights: DataFrame, as_of: Column, days: float) -> DataFrame:
    """Files of at least ``days`` that no open insight names: what pruning deletes."""
    old = files.where((as_of.cast("double") - F.col("modified").cast("double")) >= days * 86_400)
    return old.join(insights.where(~F.col("processed")).select(F.col("context_file").alias("path")), "path", "left_anti")


def deletable_files(insights: DataFrame) -> DataFrame:
    """Context files whose insights allow deletion."""
    return insights.where(F.coalesce("safe_to_delete", F.lit(False))).select("context_file").distinct()


def delete_files(files: DataFrame) -> int:
    """Delete the files named in ``files`` (path), one by one; those that are gone already do not count. Returns how many were deleted."""
    spark, n = files.sparkSession, 0
    for row in files.select("path").distinct().toLocalIterator():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(row.path)
        n += bool(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, False))
    return n


def parse_requests(lines: DataFrame) -> DataFrame:
    """Rows (id, type, payload) of JSON lines (value), batch or stream; malformed lines and unknown types are dropped."""
    parsed = lines.select(F.get_json_object("value", "$.id").alias("id"), F.get_json_object("value", "$.type").alias("type"), F.get_json_object("value", "$.payload").alias("payload"))
    return parsed.where(F.col("id").isNotNull() & F.col("type").isin(*REQUESTS))


def observation_tags(agent: Column, run: Column) -> Column:
    return F.array(F.concat(F.lit("agent:"), agent), F.concat(F.lit("run:"), run), F.lit("observation"))
