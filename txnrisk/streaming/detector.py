"""The detector as a service: records are submitted as JSON lines, every one
ends in exactly one of four routes, and live statistics are kept beside them.

A micro-batch is worked through in ``foreachBatch`` by batch operators, with
state that is kept in tables of the output folder:

* ``state``: one line a batch -- the greatest event time so far, which batches
  of ids and of profiles are live, and running totals;
* ``ids``: what was accepted, by batch.  A record behind the watermark (the
  greatest event time of all earlier batches less ``delay``) is late, so only ids
  at or after it can be duplicates: older batches drop out;
* ``profiles``: count, mean and squared deviations of each customer's amounts,
  by batch.  They are summed where a customer comes up again, however long it
  was idle; nothing is evicted.

Once ``COMPACT`` batches are live, the next one merges them.  All tables have a
folder per batch that is written as a whole, and a batch reads only folders of
earlier ones, so a batch that is run again after a failure writes the same.

Routes, in this order: ``error`` (not JSON, a field of the wrong type, no id, no
amount), ``late``, ``duplicate`` (the id was accepted before; of copies in a batch
the earliest counts), ``scored``.  A record without a time gets that of its
arrival (when its file was written) and neither is late nor moves the watermark.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from txnrisk.operators import dashboard, keyed, scoring
from txnrisk.operators.joins import sized, sized_join
from txnrisk.streaming import pipeline as sp

ID, KEY = sp.ID, sp.KEY
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
FIELDS = T.StructType([
    T.StructField(ID, T.LongType()), T.StructField(KEY, T.LongType()), T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("amount", T.DoubleType()), T.StructField("merchant_category", T.StringType()),
    T.StructField("location", T.StringType()), T.StructField("transaction_type", T.StringType()),
    T.StructField("device_type", T.StringType())])
ROUTES = ["error", "late", "duplicate", "scored"]
IDS = f"{ID} long, event_ts timestamp"
PROFILES = f"{KEY} long, n long, mean double, m2 double"
#: live batches of ids or profiles before they are merged
COMPACT = 16


def submit(records: DataFrame, inbox: str) -> None:
    """Append ``records`` (any of ``FIELDS``) to the inbox as JSON lines; a missing or null field is left out."""
    known = [f.name for f in FIELDS if f.name in records.columns]
    submit_lines(records.select(F.to_json(F.struct(*known), {"timestampNTZFormat": TIME_FORMAT}).alias("value")), inbox)


def submit_lines(lines: DataFrame, inbox: str) -> None:
    """Append lines of text as they are."""
    lines.select(F.col(lines.columns[0]).alias("value")).write.mode("append").text(inbox)


def records(spark: SparkSession, inbox: str, max_files: int | None = None) -> DataFrame:
    """The inbox as a stream: ``FIELDS``, ``_corrupt`` (the line, where it could not be read), the line and its arrival."""
    reader = spark.readStream.schema("value string")
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader
    schema = T.StructType([*FIELDS, T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
                                           "timestampNTZFormat": TIME_FORMAT})
    return reader.text(inbox).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                                     F.col("_metadata.file_modification_time").alias("arrival"), parsed.alias("r")
                                     ).select("line", "file", "arrival", "r.*")


def reason() -> Column:
    """Why a record cannot be scored, or NULL."""
    return (F.when(F.col("_corrupt").isNotNull(), "unreadable").when(F.col(ID).isNull(), "no id")
            .when(F.col("amount").isNull() | F.isnan("amount"), "no amount"))


def route(staged: DataFrame, known: DataFrame, watermark: int | None) -> DataFrame:
    """``staged`` rows with their ``route``.  ``known``: ids accepted before, at or after the ``watermark`` (microseconds)."""
    late = F.lit(False) if watermark is None else F.col("timestamp").isNotNull() & (F.unix_micros("event_ts") < watermark)
    rows = staged.withColumn("route", F.when(F.col("reason").isNotNull(), "error").when(late, "late"))
    fresh = rows.where(F.col("route").isNull())
    first = fresh.groupBy(F.col(ID).alias("_id")).agg(F.min(F.struct("event_ts", "line", "row"))["row"].alias("_first"))
    first = first.join(known.select(F.col(ID).alias("_id")).distinct().withColumn("_known", F.lit(True)), "_id", "left")
    marked = fresh.join(sized(first), F.col(ID) == F.col("_id")).withColumn("route", F.when(
        F.col("_known").isNotNull() | (F.col("row") != F.col("_first")), "duplicate").otherwise("scored"))
    return rows.where(F.col("route").isNotNull()).unionByName(marked.drop("_id", "_first", "_known"))


def moments(rows: DataFrame) -> DataFrame:
    """``PROFILES`` of the amounts of ``rows``, one row a customer."""
    x = F.col("amount")
    return rows.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))


def merged(profiles: DataFrame) -> DataFrame:
    """Profiles of several batches as one (Chan et al.: deviations from each batch's own mean, and those of the means)."""
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    return profiles.groupBy(KEY).agg(n.alias("n"), mean.alias("mean"), (F.sum("m2") + F.greatest(spread, F.lit(0.0))).alias("m2"))


def with_profile(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """``n_before, avg_before, std_before``: the customer's amounts of earlier batches and before the row in its own."""
    own = keyed.asof_stats(rows, KEY, "event_time", ID, "amount", n="_n1", mean="_a1", std="_s1")
    here = rows.select(KEY).where(F.col(KEY).isNotNull()).distinct()
    past = merged(profiles.join(here, KEY, "left_semi")).select(
        F.col(KEY).alias("_key"), F.col("n").alias("_n0"), F.col("mean").alias("_a0"), F.col("m2").alias("_m0"))
    out = own.join(sized(past), F.col(KEY) == F.col("_key"), "left")
    n0, n1 = F.coalesce("_n0", F.lit(0)), F.coalesce("_n1", F.lit(0))
    a0, a1 = F.coalesce("_a0", F.lit(0.0)), F.coalesce("_a1", F.lit(0.0))
    n = n0 + n1
    m2 = (F.coalesce("_m0", F.lit(0.0)) + F.coalesce(F.col("_s1") * F.col("_s1") * (n1 - 1), F.lit(0.0))
          + F.when(n > 0, n0 * n1 / n * (a1 - a0) * (a1 - a0)).otherwise(0.0))
    has = F.col(KEY).isNotNull()
    return out.select(*rows.columns, F.when(has, n).alias("n_before"), F.when(has & (n > 0), (n0 * a0 + n1 * a1) / n).alias("avg_before"),
                      F.when(has & (n > 1), F.sqrt(m2 / (n - 1))).alias("std_before"))


@dataclass
class Detector:
    """``score``: from transactions with the customer's attributes (``profile``, a table by
    customer) and history to scored rows (``scoring.combine`` and ``mark_invalid``)."""
    spark: SparkSession
    out_dir: str
    profile: DataFrame
    score: Callable[[DataFrame], DataFrame] = sp.score_stream
    delay: str = "1 hour"
    max_files: int | None = None
    query: StreamingQuery | None = field(default=None, repr=False)

    @property
    def inbox(self) -> str:
        return os.path.join(self.out_dir, "inbox")

    # --- service

    def start(self, available_now: bool = False, interval: str = "1 second") -> StreamingQuery:
        if self.running:
            return self.query
        fs, path = self._fs(self.inbox)
        fs.mkdirs(path)
        w = (records(self.spark, self.inbox, self.max_files).writeStream.foreachBatch(self.process)
             .option("checkpointLocation", os.path.join(self.out_dir, "_checkpoint")))
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
        self.query = w.start()
        return self.query

    @property
    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def stop(self) -> None:
        """Work through what has been submitted, then end."""
        if self.running:
            self.query.processAllAvailable()
            self.query.stop()

    def submit(self, rows: DataFrame) -> bool:
        """Whether the records were taken: a detector that doesn't run takes none."""
        if not self.running:
            return False
        submit(rows, self.inbox)
        return True

    def drain(self) -> None:
        """Work through the inbox as it is."""
        sp.finish(self.start(available_now=True))

    # --- tables

    def _path(self, table: str, batch: int | None = None) -> str:
        return os.path.join(self.out_dir, table, *([] if batch is None else [f"batch_id={batch}"]))

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _submitted(self) -> int:
        """Files of the inbox that hold anything."""
        fs, p = self._fs(self.inbox)
        found = fs.listStatus(p) if fs.exists(p) else []
        return sum(s.getLen() > 0 and not s.getPath().getName().startswith(("_", ".")) for s in found)

    def _write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        df.write.mode("overwrite").parquet(self._path(table, batch))
        return self.spark.read.parquet(self._path(table, batch))

    def table(self, table: str) -> DataFrame:
        """``routed, scored, alerts`` or ``progress``, with ``batch_id``."""
        return self.spark.read.option("basePath", self._path(table)).parquet(self._path(table))

    def _live(self, table: str, schema: str, batches: list[int]) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[self._path(table, b) for b in batches]) if batches else self.spark.createDataFrame([], schema)

    def state(self, before: int | None = None) -> dict:
        """State after the last batch (before batch ``before``)."""
        done = sorted(int(n.split("=")[1]) for n in self._names(self._path("state")) if n.startswith("batch_id="))
        done = [b for b in done if before is None or b < before]
        if not done:
            return {"batch": None, "top": None, "ids": [], "profiles": [], "rows": 0, "scored": 0, "fraud": 0, "alerts": 0, "millis": 0, "files": 0}
        return json.loads(self.spark.read.text(self._path("state", done[-1])).first()[0])

    # --- a micro-batch

    def process(self, batch: DataFrame, batch_id: int) -> None:
        began, st = time.monotonic(), self.state(batch_id)
        micros = self._micros(self.delay)
        watermark = None if st["top"] is None else st["top"] - micros
        staged = self._write(batch.withColumns({
            "reason": reason(), "row": F.monotonically_increasing_id(),
            "event_ts": F.coalesce(sp.ntz_to_instant("timestamp"), F.col("arrival"))}), "staged", batch_id)
        timed = F.col("reason").isNull() & F.col("timestamp").isNotNull()
        seen = staged.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("file").alias("files"),
                          F.max(F.when(timed, F.unix_micros("event_ts"))).alias("top")).first()
        live = [(b, top) for b, top in st["ids"] if watermark is None or top >= watermark]
        known = self._live("ids", IDS, [b for b, _ in live])
        known = known if watermark is None else known.where(F.unix_micros("event_ts") >= watermark)
        routed = self._write(route(staged, known, watermark).drop("_corrupt"), "routed", batch_id)

        taken = routed.where(F.col("route") == "scored")
        ids, profiles = taken.select(ID, "event_ts"), moments(taken)
        merge = len(live) >= COMPACT
        newest_id = self._write(ids.unionByName(known) if merge else ids, "ids", batch_id).agg(F.max(F.unix_micros("event_ts"))).first()[0]
        past = self._live("profiles", PROFILES, st["profiles"])
        merge_profiles = len(st["profiles"]) >= COMPACT
        self._write(merged(profiles.unionByName(past)) if merge_profiles else profiles, "profiles", batch_id)

        tx = taken.withColumns({"event_time": sp.instant_to_ntz("event_ts"), "has_time": F.col("timestamp").isNotNull()}).drop(
            "line", "file", "arrival", "reason", "row", "route", "timestamp")
        tx = with_profile(sized_join(tx, self.profile, KEY, "left", materialize=False), past)
        scored = self._write(self.score(tx), "scored", batch_id)
        counts = scored.agg(F.count_if("is_fraud_pred").alias("fraud"), F.count_if("alert_triggered").alias("alerts")).first()
        self._write(scoring.alert_records(scored), "alerts", batch_id)

        by_route = {r["route"]: r["count"] for r in routed.groupBy("route").count().collect()}  # four rows at most
        files = st["files"] + seen["files"]
        top = max((t for t in (st["top"], seen["top"]) if t is not None), default=None)
        now = {"batch": batch_id, "top": top,
               "ids": ([] if merge else live) + ([[batch_id, newest_id]] if newest_id is not None else []),
               "profiles": ([] if merge_profiles else st["profiles"]) + [batch_id],
               "rows": st["rows"] + seen["rows"], "scored": st["scored"] + by_route.get("scored", 0),
               "fraud": st["fraud"] + counts["fraud"], "alerts": st["alerts"] + counts["alerts"],
               "files": files, "millis": st["millis"] + int(1000 * (time.monotonic() - began))}
        waiting = max(0, self._submitted() - files)
        self._write(self.spark.createDataFrame(
            [(seen["rows"], *[by_route.get(r, 0) for r in ROUTES], counts["fraud"], counts["alerts"],
              now["millis"] - st["millis"], waiting, watermark)],
            "n_rows long, " + ", ".join(f"n_{r} long" for r in ROUTES) + ", fraud long, alerts long, millis long, files_waiting long, watermark long"),
            "progress", batch_id)
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(self._path("state", batch_id))

        self._prune(batch_id, st, now)

    def _prune(self, batch_id: int, before: dict, now: dict) -> None:
        """Remove state that neither this batch, should it run again, nor a later one reads."""
        keep = {"ids": {b for st in (before, now) for b, _ in st["ids"]}, "profiles": {b for st in (before, now) for b in st["profiles"]},
                "state": {before["batch"]}, "staged": set()}
        for table, live in keep.items():
            for name in self._names(self._path(table)):
                b = int(name.split("=")[1]) if name.startswith("batch_id=") else batch_id
                if b < batch_id and b not in live:
                    fs, path = self._fs(os.path.join(self._path(table), name))
                    fs.delete(path, True)

    def _micros(self, interval: str) -> int:
        return self.spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {interval})")).first()[0]

    # --- what it has done

    def statistics(self) -> dict:
        """Running totals, the mean processing time of a transaction, and what waits."""
        st = self.state()
        waiting = self._submitted() - st["files"]
        return {"total_transactions": st["rows"], "fraud_detected": st["fraud"], "alerts_triggered": st["alerts"],
                "avg_processing_time": st["millis"] / 1000 / st["rows"] if st["rows"] else 0.0,
                "files_waiting": max(0, waiting), "is_running": self.running}

    def running_statistics(self) -> DataFrame:
        """The same from the ``progress`` table, as one row."""
        return self.table("progress").agg(
            F.sum("n_rows").alias("total_transactions"), F.sum("fraud").alias("fraud_detected"), F.sum("alerts").alias("alerts_triggered"),
            (F.sum("millis") / 1000 / F.sum("n_rows")).alias("avg_processing_time"),
            F.max_by("files_waiting", "batch_id").alias("files_waiting"), F.count(F.lit(1)).alias("batches"))

    def history(self) -> DataFrame:
        """Scored rows as history records; a row's processing time is its share of its batch's."""
        per_row = self.table("progress").select("batch_id", (F.col("millis") / 1000 / F.col("n_rows")).alias("processing_time"))
        return dashboard.history(self.table("scored").join(F.broadcast(per_row), "batch_id"))  # a row a batch
