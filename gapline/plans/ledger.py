"""Run ledger: an append-only event log, the latest artifact of each step, and current tables, in a catalog database's folder.

Both logs are numbered without gaps or repeats however many sessions write at once (:class:`NumberedLog`)."""

from __future__ import annotations

import datetime
import json
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "id long, timestamp string, operation string, input_path string, output_path string, parameters_json string, status string, message string"
ARTIFACTS = "step string, updated_at string, artifact_path string, parameters_json string, message string"


def latest_by(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only log; partial before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def history(events: DataFrame, limit: int = 100) -> DataFrame:
    return events.orderBy(F.desc("id")).limit(limit)


def safe_name(name: str) -> str:
    out = re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_")
    if not out:
        raise ValueError("a table needs a name")
    return out


class NumberedLog:
    """An append-only log that many writers share: an entry is a file named by its number, made complete under another name and then linked to
    its own, which only one writer can do. Who comes second takes the next number. Readers see complete entries only, and what a writer that died left behind
    has no number. Numbers rise from 1 without gaps."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        sc = spark.sparkContext
        self.jvm, conf = sc._jvm, sc._jsc.hadoopConfiguration()
        self.files = self._path("").getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), conf)
        self.files.mkdirs(self._path(""))
        scheme = self.files.getScheme()
        self.local = self.files.makeQualified(self._path("")).toUri().getPath() if scheme == "file" else None

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def last(self) -> int:
        names = os.listdir(self.local) if self.local else [x.getPath().getName() for x in self.files.listStatus(self._path(""))]
        return max((int(n[:20]) for n in names if n.endswith(".json")), default=0)

    def _claim(self, temporary: str, name: str) -> bool:
        """Gives the temporary entry its name; False if another has it."""
        if self.local:  # a link is made or not, in one step
            try:
                os.link(f"{self.local}/{temporary}", f"{self.local}/{name}")
            except FileExistsError:
                return False
            os.remove(f"{self.local}/{temporary}")
            return True
        try:
            none = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
            self.context.rename(self._path(temporary), self._path(name), none)
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    def append(self, row: dict, number: str) -> int:
        n = self.last()
        while True:
            n += 1
            text = json.dumps({number: n} | row, ensure_ascii=False) + "\n"
            temporary = f"_{uuid.uuid4().hex}"  # readers pass over names that begin so
            if self.local:
                with open(f"{self.local}/{temporary}", "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                out = self.files.create(self._path(temporary), False)
                out.write(bytearray(text.encode()))
                out.close()
            if self._claim(temporary, f"{n:020d}.json"):
                return n
            if self.local:
                os.remove(f"{self.local}/{temporary}")
            else:
                self.files.delete(self._path(temporary), False)

    def read(self, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).json(self.folder)


class Ledger:
    def __init__(self, spark: SparkSession, database: str = "calibration"):
        self.spark, self.db = spark, safe_name(database)
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.db}")
        home = spark.catalog.getDatabase(self.db).locationUri.rstrip("/")
        self.events = NumberedLog(spark, f"{home}/calibration_events_log")
        self.saved = NumberedLog(spark, f"{home}/current_artifacts_log")

    def _append(self, table: str, row: dict, number: str) -> None:
        now = datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%S")
        log, stamp = (self.events, "timestamp") if table == "calibration_events" else (self.saved, "updated_at")
        log.append({stamp: now} | row, number)

    def log_event(
        self,
        operation: str,
        input_path: str = "",
        output_path: str = "",
        parameters: dict | None = None,
        status: str = "success",
        message: str = "",
    ) -> None:
        self._append(
            "calibration_events",
            {
                "operation": operation,
                "input_path": input_path or "",
                "output_path": output_path or "",
                "parameters_json": json.dumps(parameters or {}, ensure_ascii=False, default=str),
                "status": status,
                "message": message,
            },
            "id",
        )

    def save_artifact(self, step: str, path: str = "", parameters: dict | None = None, message: str = "") -> None:
        self._append(
            "current_artifacts_log",
            {
                "step": step,
                "artifact_path": path or "",
                "parameters_json": json.dumps(parameters or {}, ensure_ascii=False, default=str),
                "message": message,
            },
            "seq",
        )

    def artifacts(self) -> DataFrame:
        return latest_by(self.saved.read("seq long, " + ARTIFACTS), "step", "seq").drop("seq").orderBy("step")

    def artifact_path(self, step: str) -> str | None:
        row = self.artifacts().where(F.col("step") == step).first()
        return row["artifact_path"] or None if row else None

    def history(self, limit: int = 100) -> DataFrame:
        return history(self.events.read(EVENTS), limit)

    def replace_table(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").option("overwriteSchema", "true").saveAsTable(f"{self.db}.{safe_name(name)}")

    def read_table(self, name: str) -> DataFrame:
        full = f"{self.db}.{safe_name(name)}"
        return self.spark.table(full) if self.spark.catalog.tableExists(full) else self.spark.createDataFrame([], "empty string")

    def restore(self, *names: str) -> dict[str, DataFrame]:
        return {n: self.read_table(n) for n in names} | {"history": self.history(), "artifacts": self.artifacts()}
