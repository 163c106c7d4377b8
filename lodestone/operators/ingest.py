"""Writes as table algebra: upsert, insert-if-absent, replacement, cascades, overlays, resumption, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_FILE_BYTES = 50 * 1024 * 1024


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``existing`` after ``new`` is merged in on ``keys``: every other column of a known key is overwritten."""
    return existing.join(new, list(keys), "left_anti").unionByName(new)


def insert_if_new(existing: DataFrame, new: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows of ``new`` that go in: the first by ``order`` of each key that ``existing`` has not."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    fresh = new.withColumn("_first", first).where("_first = 1").drop("_first")
    return fresh.join(existing, key, "left_anti")


def replace_documents(existing: DataFrame, new: DataFrame, document: str = "document_id") -> DataFrame:
    """Rows of ``existing`` with those of the documents in ``new`` replaced: what a document no longer has is gone."""
    return existing.join(new.select(document).distinct(), document, "left_anti").unionByName(new)


def delete_documents(tables: Sequence[DataFrame], gone: DataFrame, document: str = "document_id") -> list[DataFrame]:
    """Every table without the documents in ``gone``: a delete that cascades. Raw files are not touched."""
    return [t.join(gone.select(document).distinct(), document, "left_anti") for t in tables]


def overlay(under: DataFrame, over: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``under`` with ``columns`` taken from ``over`` where it has a row and a value."""
    top = over.select(*keys, *(F.col(c).alias(f"_over_{c}") for c in columns))
    joined = under.join(top, list(keys), "left")
    return joined.select(*(F.coalesce(f"_over_{c}", c).alias(c) if c in columns else F.col(c) for c in under.columns))


#: Ids that are written into a filter; more are joined as a table.
MAX_LISTED = 1_000


def by_ids(rows: DataFrame, ids: Sequence[str | int], key: str = "document_id") -> DataFrame:
    """The rows of some ids: none is read for an empty list, a short list is a filter that reaches the scan."""
    some = sorted(set(ids))
    if len(some) <= MAX_LISTED:
        return rows.where(F.col(key).isin(some)) if some else rows.limit(0)
    return rows.join(rows.sparkSession.createDataFrame([(i,) for i in some], f"{key} {rows.schema[key].dataType.simpleString()}"), key, "left_semi")


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What is still to do: a stage that was cut short takes up there."""
    return wanted.join(done.select(*keys).distinct(), list(keys), "left_anti")


def fingerprint(*columns: Column | str) -> Column:
    """A mark of a row's content; a stage's output keeps that of its input."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\u0000")) for c in columns)), 256)


def stale(inputs: DataFrame, outputs: DataFrame, key: str = "document_id") -> DataFrame:
    """Keys whose stage has no output yet or one made from another input."""
    made = outputs.select(key, F.col("input_fp").alias("_made_from"))
    return inputs.join(made, key, "left").where(~F.col("_made_from").eqNullSafe(F.col("input_fp"))).select(key)


def register_guards(payloads: DataFrame, objects: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """``error_code`` of each of ``payloads(sha256, filename, object_key, size_bytes)``; null where it is accepted."""
    there = objects.select("object_key", F.lit(True).alias("_there")).distinct()
    wrong = ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$") & (F.length("filename") <= 255) & (F.length("filename") > 0) & (F.col("size_bytes") > 0), F.lit(False))
    code = (
        F.when(wrong, "VALIDATION_ERROR").when(F.col("object_key") != F.concat(F.lit("raw/"), "sha256", F.lit(".pdf")), "HASH_MISMATCH")
        .when(F.col("_there").isNull(), "DOCUMENT_NOT_FOUND").when(F.col("size_bytes") > max_bytes, "PDF_TOO_LARGE")
    )
    return payloads.join(there, "object_key", "left").withColumn("error_code", code).drop("_there")


def list_documents(docs: DataFrame, limit: int = 20, offset: int = 0, where: Column | None = None, order: Sequence[str | Column] = ("document_id",)) -> DataFrame:
    """A page of rows with ``total``, the count of all that pass the filter."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset is not negative")
    rows = docs if where is None else docs.where(where)
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def dominant(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; nulls and blanks don't count, the value seen first wins a tie."""
    counted = rows.where((F.col(value) != "")).groupBy(group, value).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    best = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("_n"), "_first"))
    return counted.withColumn("_best", best).where("_best = 1").select(group, value)


def positional_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join that fails where either side has a key the other has not."""
    marked = left.withColumn("_l", F.lit(True)).join(right.withColumn("_r", F.lit(True)), list(keys), "full")
    whole = F.assert_true(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit("the two sides do not have the same keys"))
    return marked.where(whole.isNull()).drop("_l", "_r")
