"""What the numbered headings of a document have in common, as relations over (document, kind) and (document, kind, kind).

``headings(document, place, kind, markdown, dotted)``: the marked headings with a number, in order; ``kind`` is what stands
before the number, as ``chapter``. Tables here have a row for each heading or pair of kinds, and no text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULES = "kinds array<string>, dotted array<string>, apart array<struct<inner: string, outer: string>>"


def kinds_of(headings: DataFrame, key: str) -> DataFrame:
    """``(key, kind, n, dots, first, last)`` of the kinds that count.

    A kind counts that recurs, and of which one is markdown or of whose document no line is (``any_markdown``); or that
    recurs and begins after the last heading of those: an appendix.
    """
    each = headings.groupBy(key, "kind").agg(F.count("*").alias("n"), F.max("markdown").alias("as_markdown"), F.max("any_markdown").alias("any_markdown"), F.count_if("dotted").alias("dots"), F.min("place").alias("first"), F.max("place").alias("last"))
    recurring = each.where("n > 1").withColumn("body", F.col("as_markdown") | ~F.col("any_markdown"))
    end = F.max(F.when(F.col("body"), F.col("last"))).over(Window.partitionBy(key))
    return recurring.withColumn("end", end).where(F.col("body") | (F.col("first") > F.col("end"))).select(key, "kind", "n", "dots", "first", "last")


def divisions(headings: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """``(key, inner, outer)``: where two headings of ``inner`` follow each other with none of ``outer`` between them, but one before and one after both."""
    counted = headings.join(kinds.select(key, "kind"), [key, "kind"])
    paired = counted.withColumn("previous", F.lag("place").over(Window.partitionBy(key, "kind").orderBy("place")))
    outer = kinds.select(key, F.col("kind").alias("outer"), F.col("last").alias("outer_last"))
    grid = paired.join(outer, key)
    seen = F.max(F.when(F.col("kind") == F.col("outer"), F.col("place"))).over(Window.partitionBy(key, "outer").orderBy("place"))
    found = grid.withColumn("seen", seen).where((F.col("kind") != F.col("outer")) & (F.col("seen") < F.col("previous")) & (F.col("place") < F.col("outer_last")))
    return found.select(key, F.col("kind").alias("inner"), "outer").distinct()


def apart(kinds: DataFrame, divided: DataFrame, key: str) -> DataFrame:
    """``(key, inner, outer)``: ``inner`` is never filed under ``outer``, for one of two reasons.

    ``outer`` divides it, and is not divided by it or came later. Or it begins after the last of ``outer``, and nothing
    else that divides ``outer`` goes on until then.
    """
    side = lambda name: kinds.select(key, F.col("kind").alias(name), F.col("first").alias(f"{name}_first"), F.col("last").alias(f"{name}_last"))
    pairs = side("inner").join(side("outer"), key).where("inner <> outer")
    by_outer = divided.select(key, F.col("inner").alias("outer"), F.col("outer").alias("inner"), F.lit(True).alias("is_divided"))
    by_inner = divided.withColumn("divides", F.lit(True))
    told = pairs.join(by_outer, [key, "inner", "outer"], "left").join(by_inner, [key, "inner", "outer"], "left")
    lasting = divided.withColumnRenamed("inner", "part").join(kinds.select(key, F.col("kind").alias("part"), F.col("last").alias("part_last")), [key, "part"])
    two = F.slice(F.sort_array(F.collect_list(F.struct("part_last", "part")), asc=False), 1, 2)  # one of the two is not the kind itself
    told = told.join(lasting.groupBy(key, "outer").agg(two.alias("parts")), [key, "outer"], "left")
    is_divided, divides = (F.coalesce(F.col(c), F.lit(False)) for c in ("is_divided", "divides"))
    goes_on = F.coalesce(F.exists("parts", lambda p: (p["part"] != F.col("inner")) & (p["part_last"] >= F.col("inner_first"))), F.lit(False))
    reasons = F.array(is_divided & (~divides | (F.col("inner_first") < F.col("outer_first"))), (F.col("inner_first") > F.col("outer_last")) & ~goes_on)
    return told.where(F.array_contains(reasons, True)).select(key, "inner", "outer")


def rules(headings: DataFrame, key: str) -> DataFrame:
    """``(key, rules)`` of every document with a kind that counts; ``dotted`` are those with a full stop after most numbers."""
    kinds = kinds_of(headings, key)
    lists = kinds.groupBy(key).agg(F.sort_array(F.collect_list("kind")).alias("kinds"), F.sort_array(F.collect_list(F.when(F.col("dots") * 2 > F.col("n"), F.col("kind")))).alias("dotted"))
    pairs = apart(kinds, divisions(headings, kinds, key), key).groupBy(key).agg(F.collect_list(F.struct("inner", "outer")).alias("apart"))
    none = F.array().cast("array<struct<inner: string, outer: string>>")
    return lists.join(pairs, key, "left").select(key, F.struct("kinds", "dotted", F.coalesce("apart", none).alias("apart")).alias("rules"))
