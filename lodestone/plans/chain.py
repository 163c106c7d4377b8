"""A chain of stages over documents that takes up where it was cut short.

Each stage's rows, and a ledger with an entry for each document a stage was run for, are Parquet files that are only added
to, a folder for each run. Both carry ``input_fp``, made of the stage and of what the stages before it put
out for the document, so a change anywhere makes all after it stale, and stale rows are never read: nothing
has to be deleted first. Rows count from when they are written, whatever becomes of their run.

An entry says how many units of the document there were and how many have a row. A stage that was cut short, as by a
provider's rate limit, leaves a document PARTIAL, and its next run is given the units without a row alone. A document of
which nothing came is EMPTY, which is as final as DONE until its input changes.

With ``step_units`` a stage that works by units takes about so many at a time. Each step's rows stand when it ends, and how
far its documents have come can be read while the stage still runs: ``progress``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.state import clear_progress, report_progress
from lodestone.sources.objects import delete, list_names

LEDGER = "document_id string, input_fp string, output_fp string, units long, made long, state string, stage string, run int"
REPORT = "document_id string, made long, total long, at double, run int, place int, step int"
PROGRESS = "document_id string, stage string, done long, total long, at double"
DONE, EMPTY, PARTIAL = "DONE", "EMPTY", "PARTIAL"


@dataclass(frozen=True)
class Stage:
    """A step of the chain.

    ``run`` gets the tables it reads by name, of the documents that are due; the first of ``reads`` holds its units of
    work, and of these it gets the ones without a row. ``documents`` are the chain's own. With ``key``, a unit is a row of
    a document, and the rows that ``run`` makes have document_id and ``key``; without, it is the whole document.
    ``schema`` is that of the rows. ``version`` is changed to make a stage anew.
    """

    name: str
    run: Callable[[dict[str, DataFrame]], DataFrame]
    schema: str
    reads: tuple[str, ...] = ("documents",)
    key: tuple[str, ...] = ()
    version: str = "1"


def row_fingerprint(columns: Sequence[str]) -> Column:
    """A document's rows as one mark, in whatever order they are, repeated ones too."""
    cells = F.struct(*(F.col(c) for c in sorted(columns)))
    two = [F.sum(F.xxhash64(F.lit(seed), cells).cast("decimal(38,0)")) for seed in (0, 1)]
    return F.sha2(F.concat_ws("|", F.count("*"), *two), 256)


class Chain:
    """``stages`` in order, with tables under ``root``. One run at a time is assumed."""

    def __init__(self, spark: SparkSession, root: str, stages: Sequence[Stage], step_units: int | None = None):
        names = ["documents"]
        for stage in stages:
            if missing := set(stage.reads) - set(names):
                raise ValueError(f"stage {stage.name} reads {sorted(missing)}, which no stage before it makes")
            names.append(stage.name)
        self.spark, self.root, self.stages, self.step_units = spark, root.rstrip("/"), list(stages), step_units

    # -- tables

    def _rows_path(self, stage: Stage) -> str:
        return f"{self.root}/{stage.name}"

    def _next_run(self) -> int:
        names = [n for s in self.stages for n in list_names(self.spark, self._rows_path(s))] + list_names(self.spark, f"{self.root}/_slices")
        return 1 + max((int(n.partition("=")[2]) for n in names if n.startswith("run=")), default=0)

    def _all_rows(self, stage: Stage) -> DataFrame:
        schema = f"{stage.schema}, input_fp string, run int, step int"
        if not list_names(self.spark, self._rows_path(stage)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._rows_path(stage))

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(f"{self.root}/_ledger") if list_names(self.spark, f"{self.root}/_ledger") else self.spark.createDataFrame([], LEDGER)

    def _last(self) -> DataFrame:
        """For each document, the last entry of each stage as a struct under the stage's name: one aggregation for all stages."""
        entry = F.struct("input_fp", "output_fp", "units", "made", "state", "run")
        return self._entries().groupBy("document_id").agg(*(F.max_by(entry, F.when(F.col("stage") == s.name, F.col("run"))).alias(s.name) for s in self.stages))

    def rows(self, name: str) -> DataFrame:
        """What counts of a stage's rows, with ``input_fp`` and the ``run`` that made them: those of each document's last input."""
        current = self._last().select("document_id", F.col(f"{name}.input_fp").alias("input_fp")).where("input_fp IS NOT NULL")
        return self._all_rows(next(s for s in self.stages if s.name == name)).join(current, ["document_id", "input_fp"], "left_semi").drop("step")

    def outcomes(self) -> DataFrame:
        """``(stage, document_id, state, units, made, run)``: how far each document has come."""
        last = self._last()
        each = F.array(*(F.struct(F.lit(s.name).alias("stage"), F.col(s.name).alias("last")) for s in self.stages))
        return last.select("document_id", F.inline(each)).where("last IS NOT NULL").select("stage", "document_id", "last.state", "last.units", "last.made", "last.run")

    # -- what is due

    def _expected(self) -> dict[str, Column]:
        """For each stage the fingerprint of a document's input, made of what the stages before put out; null where one is not complete."""
        outs, found = {"documents": F.col("content_fp")}, {}
        for s in self.stages:
            parts = [outs[r] for r in s.reads]
            found[s.name] = F.when(F.concat(*parts).isNotNull(), F.sha2(F.concat_ws("|", F.lit(s.name), F.lit(s.version), *parts), 256))
            outs[s.name] = F.when(self._complete(s, found[s.name]), F.col(f"{s.name}.output_fp"))
        return found

    @staticmethod
    def _complete(stage: Stage, expected: Column) -> Column:
        return F.coalesce((F.col(f"{stage.name}.input_fp") == expected) & (F.col(f"{stage.name}.state") != PARTIAL), F.lit(False))

    def behind(self, documents: DataFrame) -> DataFrame:
        """``documents(document_id, content_fp)`` that some stage is not complete for, with their last entries and ``tried``, the last run that had them."""
        expected = self._expected()
        complete = F.lit(True)
        for s in self.stages:
            complete = complete & self._complete(s, expected[s.name])
        runs = [F.col(f"{s.name}.run") for s in self.stages]
        known = documents.select("document_id", "content_fp").join(self._last(), "document_id", "left").where(~complete)
        return known.withColumn("tried", F.greatest(*runs, F.lit(0)))

    # -- a run

    def advance(self, documents: DataFrame, slice_documents: int | None = None) -> int:
        """Run every stage for the documents that are behind, and return the run's number; 0 where none is.

        ``documents(document_id, content_fp, ...)`` has a row for each document. A slice takes ``slice_documents`` of
        them: those never tried, then those tried longest ago, by id. A document that a stage leaves PARTIAL goes no
        further in this run. What a stage makes for documents or units it was not given is dropped.
        """
        chosen = self.behind(documents)
        if slice_documents is not None:
            chosen = chosen.orderBy("tried", "document_id").limit(slice_documents)
        run = self._next_run()
        state = self._kept(chosen, run, "begin")
        if state.isEmpty():
            delete(self.spark, f"{self.root}/_slices/run={run:06d}")
            return 0
        docs = documents.join(state.select("document_id"), "document_id", "left_semi")
        self._forget_reports()
        for stage in self.stages:
            state = self._run_stage(stage, docs, state, run)
        self._forget_reports()
        return run

    def _kept(self, state: DataFrame, run: int, after: str) -> DataFrame:
        """The slice's state, written: what a stage was run for is not computed again from tables that have grown meanwhile."""
        path = f"{self.root}/_slices/run={run:06d}/{after}"
        state.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(state.schema).parquet(path)

    # -- progress

    def _forget_reports(self) -> None:
        """Of this run, or of one that was killed before."""
        for folder in ("_progress", "_steps"):
            delete(self.spark, f"{self.root}/{folder}")

    def _steps(self, stage: Stage, units: DataFrame, todo: DataFrame, run: int) -> list[tuple[int, DataFrame]]:
        """``todo`` in steps of about ``step_units``, dealt by hash of the unit, so that a long document is in many; and a first report of what was there."""
        if not stage.key or not self.step_units:
            return [(0, todo)]
        key = ["document_id", *stage.key]
        steps = max(1, -(-todo.count() // self.step_units))
        place = F.pmod(F.xxhash64(*key), F.lit(steps)).cast("int")
        task = F.pmod(F.hash(*key), F.lit(self.spark.sparkContext.defaultParallelism))
        path = f"{self.root}/_steps/run={run:06d}/{stage.name}"
        todo.withColumn("step", place).repartition(F.col("step"), task).write.mode("overwrite").partitionBy("step").parquet(path)
        dealt = self.spark.read.schema(T.StructType([*todo.schema, T.StructField("step", T.IntegerType())])).parquet(path) if list_names(self.spark, path) else todo.withColumn("step", place)
        all_units = units.select(key).distinct().groupBy("document_id").agg(F.count("*").alias("total"))
        open_units = todo.select(key).distinct().groupBy("document_id").agg(F.count("*").alias("open"))
        begun = all_units.join(open_units, "document_id", "left").select("document_id", (F.col("total") - F.coalesce("open", F.lit(0))).alias("made"), "total")
        self._report(stage, begun, run, -1)
        return [(n, dealt.where(F.col("step") == n).drop("step")) for n in range(steps)]

    def _report(self, stage: Stage, counts: DataFrame, run: int, step: int) -> None:
        """Add to the reports of a run; one that comes after the first has only what its step made."""
        total = F.col("total") if "total" in counts.columns else F.lit(None)
        rows = counts.select("document_id", F.col("made").cast("long"), total.cast("long").alias("total"), (F.unix_micros(F.current_timestamp()) / 1e6).alias("at"))
        rows.write.mode("overwrite").parquet(f"{self.root}/_progress/run={run:06d}/place={self.stages.index(stage)}/step={step}")

    def progress(self) -> DataFrame:
        """``PROGRESS`` of the documents in a run that goes on, or that was killed: where they are, in units done and in all, and when that was told in seconds.

        Documents that all stages are through with are not shown, and a run that ends takes its reports with it.
        """
        if not list_names(self.spark, f"{self.root}/_progress"):
            return self.spark.createDataFrame([], PROGRESS)
        reports = self.spark.read.schema(REPORT).parquet(f"{self.root}/_progress")
        names = F.array(*(F.lit(s.name) for s in self.stages))
        summed = reports.groupBy("document_id", "run", "place").agg(F.sum("made").alias("done"), F.max("total").alias("total"), F.max("at").alias("at"))
        told = summed.select("document_id", F.get(names, F.col("place")).alias("stage"), "done", "total", "at")
        ended = self.outcomes().where((F.col("stage") == self.stages[-1].name) & (F.col("state") != PARTIAL)).select("document_id", "run")
        last_run = reports.groupBy("document_id").agg(F.max("run").alias("run"))
        return clear_progress(report_progress(self.spark.createDataFrame([], PROGRESS), told), ended.join(last_run, ["document_id", "run"], "left_semi"))

    # -- a stage

    def _run_stage(self, stage: Stage, docs: DataFrame, state: DataFrame, run: int) -> DataFrame:
        expected = self._expected()[stage.name]
        due = state.where(expected.isNotNull() & ~self._complete(stage, expected)).withColumn("input_fp", expected)
        ids, key = due.select("document_id", "input_fp"), ["document_id", *stage.key]
        of = {s.name: s for s in self.stages}

        def given(name: str) -> DataFrame:
            if name == "documents":
                return docs.join(ids, "document_id", "left_semi")
            wanted = due.select("document_id", F.col(f"{name}.input_fp").alias("input_fp"))
            return self._all_rows(of[name]).join(wanted, ["document_id", "input_fp"], "left_semi").drop("input_fp", "run", "step")

        inputs = {name: given(name) for name in stage.reads}
        units = inputs[stage.reads[0]]
        had = self._all_rows(stage).join(ids, ["document_id", "input_fp"], "left_semi").select(key)
        todo = units.join(had, key, "left_anti")
        columns = [c for c in self._all_rows(stage).columns if c not in ("input_fp", "run", "step")]
        for step, part in self._steps(stage, units, todo, run):
            made = stage.run({**inputs, stage.reads[0]: part}).select(columns)
            asked_for = made.join(part.select(key), key, "left_semi") if stage.key else made  # a document that was not given is no part of ids
            rows = asked_for.join(ids, "document_id")
            path = f"{self._rows_path(stage)}/run={run:06d}/step={step}"
            rows.write.mode("overwrite").parquet(path)
            if stage.key and self.step_units:
                came = self.spark.read.schema(rows.schema).parquet(path).select(key).distinct()
                self._report(stage, came.groupBy("document_id").agg(F.count("*").alias("made")), run, step)

        now = self._all_rows(stage).join(ids, ["document_id", "input_fp"], "left_semi")
        count = F.count_distinct(*stage.key) if stage.key else F.lit(1).cast("long")
        done = now.groupBy("document_id").agg(row_fingerprint(columns).alias("output_fp"), count.alias("made"))
        wanted = (units.select(key).distinct() if stage.key else ids).groupBy("document_id").agg(F.count("*").alias("units"))
        counts = ids.join(wanted, "document_id", "left").join(done, "document_id", "left").withColumns({"units": F.coalesce("units", F.lit(0).cast("long")), "made": F.coalesce("made", F.lit(0).cast("long"))})
        nothing = F.col("output_fp").isNull()
        outcome = F.when((F.col("made") < F.col("units")) & F.lit(bool(stage.key)), PARTIAL).when(nothing, EMPTY).otherwise(DONE)
        out = F.when(nothing, F.sha2(F.concat(F.lit("nothing|"), "input_fp"), 256)).otherwise(F.col("output_fp"))
        entries = counts.select("document_id", "input_fp", out.alias("output_fp"), "units", "made", outcome.alias("state"))
        path = f"{self.root}/_ledger/stage={stage.name}/run={run:06d}"
        entries.write.mode("overwrite").parquet(path)
        written = self.spark.read.schema(entries.schema).parquet(path).select("document_id", F.struct("input_fp", "output_fp", "units", "made", "state", F.lit(run).alias("run")).alias("_new"))
        if stage is self.stages[-1]:
            return state
        joined = state.join(written, "document_id", "left")
        return self._kept(joined.withColumn(stage.name, F.coalesce("_new", stage.name)).drop("_new"), run, stage.name)
