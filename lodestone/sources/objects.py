"""Objects and artifacts: raw bytes, JSON, vectors, by any file system Spark reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = ("raw", "staging")
PARSED = "title string, page_count int, pages array<struct<page: int, markdown: string, source: string, confidence: double>>"
CHUNKS = (
    "title string, parents array<struct<chunk_index: int, content: string, token_count: int, page_start: int, page_end: int, heading_path: string, language: string>>, "
    "children array<struct<chunk_index: int, parent_index: int, content: string, token_count: int, page_number: int, heading_path: string, language: string>>"
)
ENRICHED = "chunks array<struct<id: string, context: string, category: string>>"
CATEGORIES = ("LEGAL", "FINANCIAL", "TECHNICAL", "MEDICAL", "EDUCATION", "BUSINESS", "NEWS", "OTHER")


def split_key(key: Column, buckets: tuple[str, ...] = BUCKETS) -> Column:
    """``(bucket, rest)`` of ``bucket/rest``; null for a bucket that is not known."""
    bucket = F.substring_index(key, "/", 1)
    return F.when(bucket.isin(*buckets) & F.contains(key, F.lit("/")), F.struct(bucket.alias("bucket"), F.substr(key, F.length(bucket) + 2).alias("rest")))


def read_objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(path, modificationTime, length, content, sha256)`` of files; the digest is lazy."""
    reader = spark.read.format("binaryFile")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return rows.withColumn("sha256", F.sha2("content", 256))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``; errors other than its absence are raised."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no folder."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = there.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in system.listStatus(there)] if system.exists(there) else []


def create_file(spark: SparkSession, path: str) -> None:
    """An empty file; that one is there already is an error."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).create(there, False).close()


def delete(spark: SparkSession, path: str) -> bool:
    """Remove what is at ``path``; nothing there is no error."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that exists: an artifact's own place, then its backups."""
    return next((p for p in paths if exists(spark, p)), None)


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artifact, one document a file; fields that older ones lack are null."""
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("path", F.input_file_name())


def write_artifact(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_vectors(rows: DataFrame, path: str, column: str = "embedding") -> None:
    """Keyed vectors as single precision."""
    rows.withColumn(column, F.col(column).cast("array<float>")).write.mode("overwrite").parquet(path)


def pages_of(parsed: DataFrame, key: str = "document_id") -> DataFrame:
    return parsed.select(key, F.inline("pages"))


def parse_enrichment(reply: Column) -> Column:
    """Items of a provider's reply: ids as numbers, malformed items and replies dropped."""
    items = F.coalesce(F.from_json(reply, ENRICHED)["chunks"], F.array())
    typed = F.transform(items, lambda c: F.struct(c["id"].try_cast("int").alias("id"), F.coalesce(c["context"], F.lit("")).alias("context"), c["category"].alias("category")))
    return F.filter(typed, lambda c: c["id"].isNotNull())
