"""The engine's entry points over tables in a folder: register, list, delete, re-ingest, ask, evaluate.

A table is a folder of buckets by document hash, each a row of numbered Parquet versions. A version counts once its
commit file is there, which is made last and never overwritten; readers take the newest that counts. So a job that dies
at any point leaves the version before in place, and a change to some documents writes their buckets alone. One writer
at a time is assumed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import evaluation as E
from lodestone.operators import ingest as I
from lodestone.operators.state import may_reopen
from lodestone.plans.read_path import Stages, Trace, ask
from lodestone.sources.objects import create_file, list_names

#: Folders of a table; a write touches those of its documents.
BUCKETS = 64

DOCUMENTS = "document_id string, sha256 string, filename string, object_key string, size_bytes long, status string, stage string, title string, language string, page_count int, attempts int, failed_stage string, last_error string, created_at timestamp, completed_at timestamp"
TRACES = "trace_id string, question string, iterations int, total_ms long, citation_count int, nodes string, created_at timestamp"


#: What a run changes of a document, and what taking it up again clears.
RUN_STATE = ("status", "stage", "attempts", "failed_stage", "last_error")


def _mask(buckets: Iterable[int]) -> int:
    return sum(1 << b for b in set(buckets))


def _bits(mask: str) -> set[int]:
    return {b for b in range(BUCKETS) if int(mask, 16) >> b & 1}


def bucket_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


@dataclass
class Engine:
    spark: SparkSession
    root: str

    # -- tables

    def _newest(self, name: str) -> tuple[int, dict[int, str]]:
        """The number of the last commit, -1 without one, and for each bucket that was ever written its folder; empty where it has no rows."""
        held: dict[int, str] = {}
        last = -1
        for file in sorted(list_names(self.spark, f"{self.root}/{name}/_commits")):
            number, folder, written, filled = file.split("-")
            last = int(number)
            for bucket in _bits(written):
                held[bucket] = f"{self.root}/{name}/{folder}/bucket={bucket}" if bucket in _bits(filled) else ""
        return last, held

    def _read(self, schema: str, paths: Iterable[str]) -> DataFrame:
        some = sorted(filter(None, paths))
        return self.spark.read.schema(schema).parquet(*some) if some else self.spark.createDataFrame([], schema)

    def table(self, name: str, schema: str) -> DataFrame:
        """The table as last committed; without rows where it was never written."""
        last, held = self._newest(name)
        if last < 0 and list_names(self.spark, f"{self.root}/{name}"):
            raise ValueError(f"table {name} has versions of which none is committed")
        return self._read(schema, held.values())

    def replace(self, name: str, rows: DataFrame, key: str = "document_id", buckets: Iterable[int] = range(BUCKETS)) -> None:
        """Make ``rows`` the table, or those of its buckets that are named; ``rows`` has no row of others then."""
        last, _ = self._newest(name)
        if last < 0:
            last = 0
            create_file(self.spark, f"{self.root}/{name}/_commits/{last:012d}-none-0-0")  # from now on the table is there, and empty
        folder = uuid.uuid4().hex
        rows.withColumn("bucket", bucket_of(F.col(key))).write.partitionBy("bucket").parquet(f"{self.root}/{name}/{folder}")
        filled = (int(f.partition("=")[2]) for f in list_names(self.spark, f"{self.root}/{name}/{folder}") if f.startswith("bucket="))
        create_file(self.spark, f"{self.root}/{name}/_commits/{last + 1:012d}-{folder}-{_mask(buckets):x}-{_mask(filled):x}")

    def change(self, name: str, schema: str, keys: DataFrame, by: Callable[[DataFrame], DataFrame], key: str = "document_id") -> None:
        """Replace the buckets that hold ``keys(key)`` by what ``by`` makes of their rows. Bucket numbers alone come to the driver."""
        hit = [r[0] for r in keys.select(bucket_of(F.col(key)).alias("b")).distinct().collect()]
        if hit:
            _, held = self._newest(name)
            self.replace(name, by(self._read(schema, (held.get(b, "") for b in hit))), key, hit)

    @property
    def documents(self) -> DataFrame:
        return self.table("documents", DOCUMENTS)

    # -- ingestion

    def is_new(self, hashes: DataFrame) -> DataFrame:
        return hashes.join(self.documents, "sha256", "left_anti")

    def register(self, payloads: DataFrame, objects: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(accepted, rejected) of ``payloads(sha256, filename, object_key, size_bytes)``; a file is accepted once."""
        judged = I.register_guards(payloads, objects)
        good = judged.where("error_code IS NULL").drop("error_code")
        place = F.row_number().over(Window.partitionBy("sha256").orderBy("filename", "size_bytes"))
        numbered = good.withColumn("_place", place)
        old = self.documents.select("sha256")
        fresh = numbered.where("_place = 1").drop("_place").join(old, "sha256", "left_anti")
        # A file that is known, or that comes a second time here, whatever it is called.
        known = numbered.where("_place > 1").unionByName(numbered.where("_place = 1").join(old, "sha256", "left_semi")).drop("_place").withColumn("error_code", F.lit("DOCUMENT_ALREADY_INGESTED"))
        row = {"document_id": F.sha2(F.concat_ws("|", F.lit("document"), "sha256"), 256), "status": F.lit("QUEUED"), "attempts": F.lit(0), "created_at": F.current_timestamp()}
        wanted = [c.split()[0] for c in DOCUMENTS.split(", ")]
        types = dict(c.split() for c in DOCUMENTS.split(", "))
        accepted = fresh.select(*((row[c] if c in row else F.col(c) if c in fresh.columns else F.lit(None)).cast(types[c]).alias(c) for c in wanted))
        path = f"{self.root}/arrivals/{uuid.uuid4().hex}"
        accepted.write.parquet(path)  # timestamps are fixed here
        accepted = self.spark.read.schema(DOCUMENTS).parquet(path)
        rejected = judged.where("error_code IS NOT NULL").unionByName(known)
        rejected.write.parquet(f"{path}-rejected")
        self.change("documents", DOCUMENTS, accepted, lambda held: held.unionByName(accepted))
        return accepted, self.spark.read.schema(rejected.schema).parquet(f"{path}-rejected")

    def list_documents(self, limit: int = 20, offset: int = 0, status: str | None = None) -> DataFrame:
        where = None if status is None else F.col("status") == status
        return I.list_documents(self.documents, limit, offset, where, (F.desc("created_at"), "document_id"))

    def document(self, document_id: str) -> DataFrame:
        """The row of one document, from its bucket alone."""
        bucket = self.spark.range(1).select(bucket_of(F.lit(document_id))).first()[0]
        return self._read(DOCUMENTS, [self._newest("documents")[1].get(bucket, "")]).where(F.col("document_id") == document_id)

    def delete_document(self, document_id: str, tables: dict[str, str] | None = None) -> bool:
        """Whether there was such a document; its rows in ``tables`` (name to schema) go with it, raw files stay."""
        gone = self.document(document_id).select("document_id")
        if gone.isEmpty():
            return False
        for name, schema in {**(tables or {}), "documents": DOCUMENTS}.items():
            self.change(name, schema, gone, lambda held: I.delete_documents([held], gone)[0])
        return True

    def reingest(self, ids: DataFrame | Sequence[str] | None = None, force: bool = False) -> DataFrame:
        """Queue finished documents again: ``(document_id, relaunched, before)`` for those asked for, all finished ones by default.

        ``ids`` may be a table with document_id. ``relaunched`` is false for a document that runs and null for one
        that is not there; ``before`` is what was overwritten, for ``restore``.
        """
        documents = self.documents
        if ids is None:
            asked = documents.where("completed_at IS NOT NULL").select("document_id")
        else:
            asked = (ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "document_id string")).select("document_id").distinct()
        held = documents.select("document_id", may_reopen(F.col("status"), force).alias("relaunched"), F.struct(*RUN_STATE).alias("before"))
        path = f"{self.root}/reingested/{uuid.uuid4().hex}"
        asked.join(held, "document_id", "left").write.parquet(path)
        report = self.spark.read.parquet(path)
        types = dict(c.split() for c in DOCUMENTS.split(", "))
        self._run_state(report.where("relaunched").select("document_id", F.struct(*(F.lit(v).cast(types[c]).alias(c) for c, v in zip(RUN_STATE, ("QUEUED", None, 0, None, None), strict=True))).alias("state")))
        return report

    def restore(self, report: DataFrame) -> None:
        """Undo a re-ingest whose run never started."""
        self._run_state(report.where("relaunched").select("document_id", F.col("before").alias("state")))

    def _run_state(self, states: DataFrame) -> None:
        def put(rows: DataFrame) -> DataFrame:
            joined = rows.join(states, "document_id", "left")
            return joined.withColumns({c: F.when(F.col("state").isNotNull(), F.col(f"state.{c}")).otherwise(F.col(c)) for c in RUN_STATE}).select(*rows.columns)

        self.change("documents", DOCUMENTS, states, put)

    # -- questions

    def ask(self, questions: DataFrame, stages: Stages, max_iterations: int = 1) -> tuple[DataFrame, DataFrame, Trace]:
        """Answer a batch; a trace row is kept for a batch that fails, too. A trace that can't be written costs nothing else."""
        trace = Trace()
        try:
            return ask(questions, stages, max_iterations, trace)
        finally:
            try:
                self._keep(questions, trace)
            except Exception as e:  # the answer goes out whatever becomes of its trace
                trace.nodes.append({"node": "persist_trace", "ms": 0, "error": str(e)})

    def _keep(self, questions: DataFrame, trace: Trace) -> None:
        """A row for each question: what was asked and how many citations its answer has; nodes and time are the batch's."""
        text = F.col("text") if "text" in questions.columns else F.lit(None)
        asked = questions.select(F.col("q_id" if "q_id" in questions.columns else questions.columns[0]).cast("string").alias("q_id"), text.cast("string").alias("question"))
        counted = trace.citations if trace.citations is not None else self.spark.createDataFrame([], "q_id string, citation_count int")
        rows = asked.join(counted, "q_id", "left").select(
            F.uuid().alias("trace_id"), "question", F.lit(trace.iterations).alias("iterations"), F.lit(trace.total_ms).cast("long").alias("total_ms"),
            "citation_count", F.lit(json.dumps(trace.nodes)).alias("nodes"), F.current_timestamp().alias("created_at"),
        )
        rows.write.mode("append").parquet(f"{self.root}/query_traces")

    @property
    def traces(self) -> DataFrame:
        return self.spark.read.schema(TRACES).parquet(f"{self.root}/query_traces")

    def evaluate(self, hits: DataFrame, k: int = 10, gold: DataFrame | None = None) -> DataFrame:
        """Recall and mean reciprocal rank by kind, measured as hits leave fusion.

        ``hits(q_id, kind, rank, match)``; or, with ``gold(q_id, kind, gold_sha256, gold_page)``,
        ``hits(q_id, rank, document_id, page_number)``, where a hit matches that has its question's file and page.
        """
        if gold is not None:
            hits = E.matched(hits, gold, self.documents.select("document_id", "sha256"))
        return E.summary(E.per_question(hits, k, ["q_id", "kind"]))
