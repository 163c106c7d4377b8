"""Line dedup by a suffix array over line ids, as DataFrame operations throughout.

The documents, in the order of (doc_id, text), are one sequence of line ids (MD5 of the line) with a gap after each
document; a suffix is known by its place there. Suffixes are ranked by distributed prefix doubling: the rank by the
first h ids and the rank that lies h places on give the order by the first 2h, until no two suffixes share a rank or a
document ends between them. Ranks are places in a range-partitioned sort of the distinct pairs, so no task sorts more
than its range and no window spans a class. A suffix that shares its first h ids with no other one lies in no interval
of h or more, and goes no further.

Suffixes with a common prefix of n lines are neighbours in this array: a longest-common-prefix interval, known by its
first suffix and n. The ranks of depth 1, 2, 4, ... give the intervals of these depths; the ones between are found as
common prefixes are, by halves: an interval of n lines is parted by the ranks that its suffixes have n places on.
So each suffix comes to the deepest interval in which it is not the first, the longest prefix that occurred before.
Those that don't lie in their left neighbour's are the maximal repeated runs. Later copies of runs that count, by
``min_lines`` lines or ``min_words`` words, are deleted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import discard, materialize, spare

MIN_LINES, MIN_WORDS = 3, 50
NO_ID = -(1 << 63)
WORD = r"[^\x20\x09-\x0D]+"
DOC = ("doc", "text_hash")


def _doc() -> list[Column]:
    """What makes a document: its id and text. A null id is NO_ID, and never the same document as one with that id."""
    return [F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text", F.col("doc_id").isNull()).alias("text_hash")]


def _numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``(doc, text_hash, start)`` of the documents in order, a written table, and the places that each takes.

    Only the number of rows of each range of the sort comes to the driver.
    """
    sizes = docs.select(*_doc(), F.size(F.split("text", "\n", -1)).alias("n")).groupBy(*DOC).agg(F.max("n").alias("n"))
    ordered = materialize(sizes.orderBy(*DOC).withColumn("id", F.monotonically_increasing_id()), "ordered")
    ranges = ordered.groupBy(F.shiftright("id", 33).alias("range")).agg(F.count("*"), F.max("n")).orderBy("range").collect()
    room, before, bases = max((r[2] for r in ranges), default=0) + 1, 0, []
    for number, n, _ in ranges:
        bases.append((number, before))
        before += n
    # From a list of rows Spark would start Python workers of another kind on each executor, which stay there.
    columns = {c: pa.array([b[i] for b in bases], pa.int64()) for i, c in enumerate(("range", "base"))}
    base = docs.sparkSession.createDataFrame(pa.table(columns))
    # As many rows as the sort has ranges: of a known size.
    placed = ordered.withColumn("range", F.shiftright("id", 33)).join(F.broadcast(base), "range")
    start = (F.col("base") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))) * F.lit(room).cast("long")
    numbered = materialize(placed.select(*DOC, start.alias("start")), "numbered")
    discard(ordered)
    return numbered, room


def _lines(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """``(place, start, line)`` of the lines of each document, once; line as the 16 bytes of its MD5."""
    listed = docs.select(*_doc(), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select(*DOC, "pos", F.unhex(F.md5("line")).alias("line"))
    placed = listed.join(numbered.hint("merge"), list(DOC)).dropDuplicates([*DOC, "pos"])
    return placed.select((F.col("start") + F.col("pos")).alias("place"), "start", "line")


def _ranked(suffixes: DataFrame, by: list[str], how: str, name: str) -> DataFrame:
    """``suffixes``, a written table that is used up, with ``rank`` and ``first`` of their class by ``by``.

    ``rank`` is the class's place in the order of ``by``, ``first`` the place where the class first occurs. Classes
    of one suffix have neither, and ``how`` says whether such suffixes stay.
    """
    classes = suffixes.dropna(subset=by).groupBy(*by).agg(F.count("*").alias("n"), F.min("place").alias("first")).where("n > 1").drop("n")
    ranks = materialize(classes.orderBy(*by).withColumn("rank", F.monotonically_increasing_id()), f"{name}-ranks")
    placed = materialize(suffixes.join(ranks.hint("merge"), by, how).drop("line", "next"), name)
    discard(suffixes, ranks)
    return placed


def suffix_ranks(docs: DataFrame, numbered: DataFrame) -> list[DataFrame]:
    """The ranks at depths 1, 2, 4, ... as written tables ``(head, head_first, place, start, rank, first)``.

    A table has the suffixes that share as many lines as its depth with another one. ``head`` and ``head_first`` are
    their rank and class's first place there, ``rank`` and ``first`` those at twice the depth, null where a suffix
    shares so many lines with none; the last table has no such. In the order of head a table is the suffix array to
    its depth.
    """
    found: list[DataFrame] = []
    here = lines = _ranked(materialize(_lines(docs, numbered), "lines"), ["line"], "inner", "suffixes-1")
    while not found or not here.isEmpty():
        depth = 1 << len(found)
        further = Window.partitionBy("start").orderBy("place").rangeBetween(depth, depth)
        pairs = here.select(F.col("rank").alias("head"), F.col("first").alias("head_first"), "place", "start", F.first("rank").over(further).alias("next"))
        found.append(_ranked(materialize(pairs, "pairs"), ["head", "next"], "left", f"suffixes-{2 * depth}"))
        here = found[-1].where("rank IS NOT NULL")
    discard(lines)
    return found


def _narrowed(intervals: DataFrame, ranks: DataFrame, step: int) -> DataFrame:
    """Each suffix of ``intervals(place, start, first, n)`` goes to the interval of ``step`` more lines unless it is the first there."""
    firsts = intervals.select(F.col("first").alias("place"), F.lit(None).cast("long").alias("start"), "first", "n").distinct()
    asked = intervals.unionByName(firsts).withColumn("at", F.col("place") + F.col("n"))
    looked = asked.join(ranks.select(F.col("place").alias("at"), "head").hint("merge"), "at", "left").drop("at")
    parts = looked.where("head IS NOT NULL").groupBy("first", "n", "head").agg(F.min("place").alias("least"))
    joined = looked.where("start IS NOT NULL").join(parts.hint("merge"), ["first", "n", "head"], "left")
    goes = F.col("least") < F.col("place")
    return joined.select("place", "start", F.when(goes, F.col("least")).otherwise(F.col("first")).alias("first"), F.when(goes, F.col("n") + step).otherwise(F.col("n")).alias("n"))


def deepest_intervals(tables: list[DataFrame]) -> DataFrame:
    """``(place, start, first, n)``: for each suffix the deepest interval in which it isn't the first, a written table.

    ``n`` is the number of lines, ``first`` the place of their earliest copy. A suffix whose first line is new has no
    row. ``tables`` are those of ``suffix_ranks``, which are used up.
    """
    found = None
    for k in range(len(tables) - 1, -1, -1):
        depth = 1 << k
        alone_deeper = F.col("first").isNull() | (F.col("first") == F.col("place"))
        own = tables[k].where((F.col("place") > F.col("head_first")) & alone_deeper).select("place", "start", F.col("head_first").alias("first"), F.lit(depth).cast("long").alias("n"))
        # Those that came here from twice the depth or more look for as many more lines.
        here = own if found is None else _narrowed(found, tables[k], depth).unionByName(own)
        here = materialize(here, f"intervals-{depth}")
        if found is not None:
            discard(found)
        found = here
    discard(*tables)
    return found


def maximal_runs(intervals: DataFrame, min_lines: int) -> DataFrame:
    """Those of ``intervals`` that reach further than their left neighbour's, with ``fresh``.

    ``fresh`` is the first place of the run that no run of ``min_lines`` or more to its left covers.
    """
    before = Window.partitionBy("start").orderBy("place")
    stop = F.col("place") + F.col("n")
    covered = F.max(F.when(F.col("n") >= min_lines, stop)).over(before.rowsBetween(Window.unboundedPreceding, -1))
    reached = intervals.withColumns({"stop": stop, "left": F.lag(stop).over(before), "fresh": F.greatest("place", covered)})
    return reached.where("left IS NULL OR stop > left").drop("stop", "left")


def repeated_runs(docs: DataFrame, min_lines: int = 1) -> DataFrame:
    """The maximal runs of ``min_lines`` or more lines in ``docs(doc_id, text)`` that occurred before.

    Returns doc_id, line (from 0), n, first_doc_id and first_line, where the run's earliest copy begins. Runs may
    overlap one another and their own copy. Documents are as ``dedup_lines`` has them.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    numbered, room = _numbered(some)
    runs = maximal_runs(deepest_intervals(suffix_ranks(some, numbered)), min_lines).where(F.col("n") >= min_lines)
    ids = numbered.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "start")
    first = ids.select(F.col("doc_id").alias("first_doc_id"), F.col("start").alias("first_start"))
    line = F.col("first") % room
    named = runs.join(ids.hint("merge"), "start").withColumns({"first_line": line, "first_start": F.col("first") - line}).join(first.hint("merge"), "first_start")
    return named.select("doc_id", (F.col("place") - F.col("start")).alias("line"), "n", "first_doc_id", "first_line")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """Delete later copies of repeated runs of ``min_lines`` lines or ``min_words`` words from ``docs(doc_id, text, ...)``.

    Every row comes back with its other columns, ``text`` without the deleted lines, and ``n_lines`` and
    ``n_removed``. A run that overlaps its own later copy keeps what lies before that copy. A null text stays null
    with 0 lines; an empty one is one empty line. Rows with the same doc_id and text count as one document and come
    back alike; null ids come first in the order. Columns of the input named like the two counts are replaced, or kept
    where ``counts`` is off and nothing is added.
    """
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    rows = rows.drop("n_lines", "n_removed") if counts else rows
    some = rows.select("doc_id", "text").where("text IS NOT NULL")
    numbered, _ = _numbered(some)
    intervals = deepest_intervals(suffix_ranks(some, numbered))
    at = lambda c: (F.col(c) - F.col("start")).cast("int").alias(c)
    runs = maximal_runs(intervals, min_lines).groupBy("start").agg(F.collect_list(F.struct(at("place"), F.col("n").cast("int").alias("n"), at("fresh"))).alias("runs"))
    doc, text_hash, runs_of, gone = (spare(rows, n) for n in ("run_doc", "run_text_hash", "run_list", "lines_gone"))
    runs = materialize(numbered.join(runs.hint("merge"), "start").select(F.col("doc").alias(doc), F.col("text_hash").alias(text_hash), F.col("runs").alias(runs_of)), "runs")
    discard(numbered, intervals)
    # What is deleted grows with the input: never broadcast, whatever its size.
    of_doc, of_text = _doc()
    joined = rows.join(runs.hint("merge"), (of_doc == F.col(doc)) & (of_text == F.col(text_hash)) & F.col("text").isNotNull(), "left")
    lines = F.split("text", "\n", -1)
    words = lambda r: F.aggregate(F.slice(lines, r["place"] + 1, r["n"]), F.lit(0), lambda n, x: n + F.regexp_count(x, F.lit(WORD)))
    counted = F.filter(runs_of, lambda r: (r["n"] >= min_lines) | (words(r) >= min_words))
    places = F.array_distinct(F.flatten(F.transform(counted, lambda r: F.sequence(r["fresh"], r["place"] + r["n"] - 1))))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    counted_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed")
    return joined.withColumn(gone, places).select(
        *(F.when(F.coalesce(F.size(gone), F.lit(0)) == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else F.col(f"`{c}`") for c in rows.columns),
        *(counted_lines if counts else ()),
    )


ORACLE = r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, pos, lines[pos + 1] AS line FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS pos FROM docs)),
counted AS (SELECT doc_id, pos, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines),
runs AS (
  SELECT doc_id, pos, line, lead(line, 1) OVER w AS line1, lead(line, 2) OVER w AS line2, words, words + lead(words, 1) OVER w AS words1
  FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
copies AS (
  SELECT 1 AS n, doc_id, pos, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS copy FROM runs WHERE words >= 50
  UNION ALL
  SELECT 2, doc_id, pos, row_number() OVER (PARTITION BY line, line1 ORDER BY doc_id, pos) FROM runs WHERE line1 IS NOT NULL AND words1 >= 50
  UNION ALL
  SELECT 3, doc_id, pos, row_number() OVER (PARTITION BY line, line1, line2 ORDER BY doc_id, pos) FROM runs WHERE line2 IS NOT NULL
),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM copies, range(3) AS ks(k) WHERE copy > 1 AND k < n),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n
  FROM lines ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       (CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END - coalesce(k.n, 0))::BIGINT AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
