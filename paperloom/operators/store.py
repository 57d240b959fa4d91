"""The store: append-only Parquet logs of documents, audit events and corrections, with current views.

A version of a document is a row; nothing is overwritten. The current row has the last hashes and time, the last
JSON and type that are not null, and the order of the first version.

Tables of one batch appear together. Each try of a batch writes folders of its own (run, batch, kind, try); what makes them
visible is one row in the log of commits, a single file, written when all of them are there. Of several tries of a batch the
last that was committed counts, so a batch may run again, and a try that fails leaves nothing to see. A commit has a version: it
is that of the batch's first commit, so that a later try changes no order. Versions order rows of one document; seq is the order in
which documents came, and stays. Two writers that commit at the same moment may share a version; then run, batch and kind decide.

compact() folds all versions into a snapshot, in buckets by document. The current view is then the last snapshot and the
versions committed since; what is looked up by id reads one bucket, and of the rest the folders of those commits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions.scores import overall_status

SCHEMAS = {
    "documents": "document_id string, file_hash_sha256 string, perceptual_hash string, upload_timestamp string, full_result_json string, doc_type string, seq long",
    "audit_log": "document_id string, action string, actor string, timestamp string, detail string, seq long",
    "corrections": "document_id string, doc_type string, field_name string, original_value string, corrected_value string, corrected_by string, corrected_at string, ocr_context_snippet string, seq long",
}
PLACE = ("run", "batch", "kind", "try")
PLACES = "run string, batch long, kind string, try string"
COMMITS = f"{PLACES}, version long, tables array<string>, committed_at timestamp"
#: When a value was set, as far as order goes: one for the row itself, and one for each column of which the last that is not null counts.
ORDER = "struct<version:long,run:string,batch:long,kind:string,seq:long>"
SNAPSHOT = SCHEMAS["documents"] + f", o_row {ORDER}, o_json {ORDER}, o_type {ORDER}, bucket int"
BUCKETS = 64


def fold_versions(versions: DataFrame, key: str, last: list[str], last_not_null: list[str]) -> DataFrame:
    """Current rows of versions (key, seq, …): the last of some columns, the last that is not null of others."""
    newest = [F.max_by(c, "seq").alias(c) for c in last]
    filled = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in last_not_null]
    return versions.groupBy(key).agg(F.min("seq").alias("seq"), *newest, *filled)


def folded(rows: DataFrame) -> DataFrame:
    """One row a document of rows like those of a snapshot; parts may be folded before others are added."""
    last = lambda c, o: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(o))).alias(c)
    when = lambda c, o: F.max(F.when(F.col(c).isNotNull(), F.col(o))).alias(o)
    return rows.groupBy("document_id").agg(
        *[F.max_by(c, "o_row").alias(c) for c in ("file_hash_sha256", "perceptual_hash", "upload_timestamp")],
        last("full_result_json", "o_json"), last("doc_type", "o_type"), F.min("seq").alias("seq"),
        F.max("o_row").alias("o_row"), when("full_result_json", "o_json"), when("doc_type", "o_type"),
    )


def bucket_of(document_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


@dataclass
class Store:
    spark: SparkSession
    root: str
    run: str = "main"

    # -- commits -------------------------------------------------------------------------------------------------------

    def _there(self, path: str) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _log(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        return self.spark.read.schema(schema).parquet(path) if self._there(path) else self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        """The last committed try of every batch, with the version of the first."""
        own = Window.partitionBy("run", "batch", "kind")
        last = F.row_number().over(own.orderBy(F.desc("committed_at"), F.desc("try")))
        return self._log("commits", COMMITS).withColumn("version", F.min("version").over(own)).withColumn("last", last).filter("last = 1").drop("last")

    def _publish(self, batch: int, kind: str, attempt: str, tables: list[str]) -> None:
        own = self._log("commits", COMMITS)
        version, own_version = own.agg(F.max("version"), F.min(F.when((F.col("run") == self.run) & (F.col("batch") == batch) & (F.col("kind") == kind), F.col("version")))).first()
        row = self.spark.createDataFrame([(self.run, batch, kind, attempt, own_version or (version or 0) + 1, tables)], COMMITS.rsplit(", ", 1)[0])
        row.withColumn("committed_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")

    def append(self, table: str, rows: DataFrame, batch: int, kind: str = "rows", attempt: str | None = None) -> None:
        """Rows of one table. With attempt they are a part of a batch that commit() makes visible; without they are a batch."""
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        own = attempt or uuid.uuid4().hex
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/{table}/run={self.run}/batch={batch}/kind={kind}/try={own}")
        if attempt is None:
            self._publish(batch, kind, own, [table])

    def commit(self, tables: dict[str, DataFrame], batch: int, kind: str) -> None:
        """Rows of several tables, visible together or not at all."""
        attempt = uuid.uuid4().hex
        for table, rows in tables.items():
            self.append(table, rows, batch, kind, attempt)
        self._publish(batch, kind, attempt, list(tables))

    def _versions(self, table: str, without_batch: int | None) -> DataFrame:
        """Committed rows with the place and version of their commits."""
        commits = self.commits().drop("tables", "committed_at")
        if without_batch is not None:
            commits = commits.filter((F.col("run") != self.run) | (F.col("batch") != without_batch))
        return self._log(table, f"{SCHEMAS[table]}, {PLACES}").join(commits, list(PLACE))

    def read(self, table: str, without_batch: int | None = None) -> DataFrame:
        """The committed rows of a table; those of one batch of this run are left out if it is about to be written (again)."""
        return self._versions(table, without_batch).drop(*PLACE, "version")

    # -- current views ---------------------------------------------------------------------------------------------------

    def _ordered(self, versions: DataFrame) -> DataFrame:
        order = F.struct("version", "run", "batch", "kind", "seq")
        return versions.select(*[c.split()[0] for c in SCHEMAS["documents"].split(", ")], *[order.alias(o) for o in ("o_row", "o_json", "o_type")])

    def _snapshot(self):
        """The last snapshot as a row (snapshot, buckets), or None."""
        return self._log("snapshots", "snapshot string, buckets int, made_at timestamp").orderBy(F.desc("made_at"), "snapshot").first()

    def _since(self, snapshot: str) -> DataFrame:
        """Versions committed since a snapshot, read from their folders alone: batches are as many as there were since then."""
        covered = self.spark.read.schema(PLACES).parquet(f"{self.root}/covered/{snapshot}")
        fresh = self.commits().filter(F.array_contains("tables", "documents")).join(covered, list(PLACE), "left_anti")
        folders = [f"{self.root}/documents/" + "/".join(f"{c}={r[c]}" for c in PLACE) for r in fresh.select(*PLACE).collect()]
        schema = f"{SCHEMAS['documents']}, {PLACES}"
        rows = self.spark.read.schema(schema).option("basePath", f"{self.root}/documents").parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.join(fresh.select(*PLACE, "version"), list(PLACE))

    def compact(self, buckets: int = BUCKETS) -> None:
        """Fold all committed versions into a snapshot of `buckets` files; choose as many as keep a bucket within a task."""
        name, covered = uuid.uuid4().hex, self.commits().filter(F.array_contains("tables", "documents")).select(*PLACE)
        covered.coalesce(1).write.parquet(f"{self.root}/covered/{name}")
        covered = self.spark.read.schema(PLACES).parquet(f"{self.root}/covered/{name}")
        rows = folded(self._ordered(self._versions("documents", None).join(covered, list(PLACE), "left_semi"))).withColumn("bucket", bucket_of(F.col("document_id"), buckets))
        rows.repartition(buckets, "bucket").sortWithinPartitions("document_id").write.partitionBy("bucket").parquet(f"{self.root}/snapshot/{name}")
        row = self.spark.createDataFrame([(name, buckets)], "snapshot string, buckets int").withColumn("made_at", F.current_timestamp())
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/snapshots")

    def current(self, without_batch: int | None = None, document_id: str | None = None) -> DataFrame:
        """The current row of every document, or of one. A view without a batch that a snapshot holds folds the whole log."""
        last = self._snapshot()
        if last and without_batch is not None:
            own = self.spark.read.schema(PLACES).parquet(f"{self.root}/covered/{last['snapshot']}").filter((F.col("run") == self.run) & (F.col("batch") == without_batch))
            last = None if not own.isEmpty() else last
        if last is None:
            rows = self._ordered(self._versions("documents", without_batch))
            rows = rows if document_id is None else rows.filter(F.col("document_id") == document_id)
        else:
            held, fresh = self.spark.read.schema(SNAPSHOT).parquet(f"{self.root}/snapshot/{last['snapshot']}"), self._since(last["snapshot"])
            if without_batch is not None:
                fresh = fresh.filter((F.col("run") != self.run) | (F.col("batch") != without_batch))
            fresh = self._ordered(fresh)
            if document_id is not None:
                bucket = self.spark.range(1).select(bucket_of(F.lit(document_id), last["buckets"])).first()[0]
                held, fresh = held.filter((F.col("bucket") == bucket) & (F.col("document_id") == document_id)), fresh.filter(F.col("document_id") == document_id)
            rows = held.drop("bucket").unionByName(fresh)
        return folded(rows).drop("o_row", "o_json", "o_type")

    def result(self, document_id: str, schema: str) -> DataFrame:
        """The stored result of one document as a STRUCT; no row where there is none or it cannot be parsed."""
        found = self.current(document_id=document_id).filter(F.coalesce("full_result_json", F.lit("")) != "")
        return found.select(F.from_json("full_result_json", schema).alias("result")).filter("result is not null")

    def processed(self, schema: str) -> DataFrame:
        """All documents with a result, newest first; id, type and time fall back to the row's own."""
        held = self.current().filter(F.coalesce("full_result_json", F.lit("")) != "").withColumn("r", F.from_json("full_result_json", schema)).filter("r is not null")
        names = [f.name for f in held.schema["r"].dataType.fields]
        pick = lambda n, other: F.coalesce(F.col(f"r.{n}"), other) if n in names else other
        return held.select(
            pick("document_id", F.col("document_id")).alias("document_id"),
            pick("doc_type", F.coalesce("doc_type", F.lit("other"))).alias("doc_type"),
            pick("upload_timestamp", F.col("upload_timestamp")).alias("upload_timestamp"),
            "r", "seq",
        ).orderBy(F.desc("seq"))

    def _as_versions(self, rows: DataFrame) -> DataFrame:
        """rows (document_id, full_result_json) as versions of documents that exist; others are ignored. The order in which the documents
        came stays."""
        keep = rows.select("document_id", "full_result_json").join(self.current().select("document_id", "file_hash_sha256", "perceptual_hash", "upload_timestamp", "seq"), "document_id")
        return keep.withColumn("doc_type", F.lit(None).cast("string"))

    def save_json(self, rows: DataFrame, batch: int) -> None:
        """rows (document_id, full_result_json) as new versions of documents that exist; others are ignored."""
        self.append("documents", self._as_versions(rows), batch, "json")

    @staticmethod
    def _told(corrections: DataFrame) -> dict[str, DataFrame]:
        """Corrections, and the audit events that tell of them."""
        clean = corrections.withColumns({c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("field_name", "original_value", "corrected_value", "corrected_by", "ocr_context_snippet")})
        detail = F.concat(F.col("field_name"), F.lit(": '"), F.col("original_value"), F.lit("' -> '"), F.col("corrected_value"), F.lit("'"))
        events = clean.select("document_id", F.lit("field_corrected").alias("action"), F.col("corrected_by").alias("actor"), F.col("corrected_at").alias("timestamp"), detail.alias("detail"), "seq")
        return {"corrections": clean, "audit_log": events}

    def correct(self, corrections: DataFrame, batch: int) -> None:
        """Corrections and the audit events that tell of them, in one batch."""
        self.commit(self._told(corrections), batch, "corrected")

    def record(self, events: DataFrame, batch: int, kind: str = "events") -> None:
        """Audit events; events of one batch and kind replace those written before."""
        self.append("audit_log", stamped(events), batch, kind)

    def corrections_of(self, document_id: str) -> DataFrame:
        """The corrections of one document in the order in which they were made, without nulls."""
        own = self.read("corrections").filter(F.col("document_id") == document_id)
        return session_corrections(own).drop("document_id", "seq")

    def apply_corrections(self, schema: str, corrections: DataFrame, batch: int) -> None:
        """Corrections (as correct() takes them) written into the stored results too: value, full score, green. Corrections, their audit
        events and the new JSON are one batch."""
        held = self.current().filter(F.coalesce("full_result_json", F.lit("")) != "").select("document_id", F.from_json("full_result_json", schema).alias("r")).filter("r is not null")
        told = self._told(corrections)
        changed = applied_corrections(held, told["corrections"]).select("document_id", F.to_json("result", {"ignoreNullFields": "false"}).alias("full_result_json"))
        self.commit(told | {"documents": self._as_versions(changed)}, batch, "corrected")


def stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("timestamp", F.coalesce("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))


def session_corrections(corrections: DataFrame) -> DataFrame:
    """Corrections (document_id, field_name, …, seq) as they are shown, by document in the order in which they were made: no nulls, and a
    reviewer without a name is called Reviewer."""
    filled = {"original_value": "", "corrected_value": "", "corrected_by": "Reviewer", "corrected_at": ""}
    shown = [F.coalesce(F.nullif(c, F.lit("")), F.lit(other)).alias(c) for c, other in filled.items()]
    return corrections.select("document_id", "field_name", *shown, "seq").orderBy("document_id", "seq")


def applied_corrections(results: DataFrame, corrections: DataFrame) -> DataFrame:
    """(document_id, result) of those of results (document_id, r) that corrections (document_id, field_name, corrected_value, seq) change:
    the last correction of a field is its value, with full score, and the status is judged anew."""
    last = corrections.groupBy("document_id", "field_name").agg(F.max_by("corrected_value", "seq").alias("v"))
    changes = last.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "v"))).alias("changes"))
    field = lambda f: F.when(
        F.map_contains_key("changes", f["name"]),
        f.withField("value", F.element_at("changes", f["name"])).withField("confidence.combined_score", F.lit(1.0)).withField("confidence.bucket", F.lit("green")),
    ).otherwise(f)
    result = F.col("r").withField("extracted_fields", F.transform("r.extracted_fields", field))
    red = F.exists(F.coalesce(result["extracted_fields"], F.array()), lambda f: f["confidence"]["bucket"] == "red")
    failed = F.exists(F.coalesce(F.col("r.cross_checks"), F.array()), lambda c: ~c["passed"])
    high = F.exists(F.coalesce(F.col("r.tamper_flags"), F.array()), lambda c: F.lower(c["severity"]) == "high")
    result = result.withField("overall_status", overall_status(F.lit("ok"), red, failed, high))
    return results.join(changes, "document_id").select("document_id", result.alias("result"))
