"""One object with the everyday calls, over a folder of Parquet tables that it keeps.

    store/snapshots/snapshot_time=...   registry snapshots: name, version, maintainer
    store/findings/date=...             findings of audits and sweeps: subject, rule_id, severity, score
    store/indicators                    imported indicators
    store/forgotten                     names whose findings are no longer shown

Every call returns a DataFrame or writes whole partitions; a partition written again replaces itself.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions.names import version_order
from auditloom.functions.text import name_key
from auditloom.operators import corpus, indicators, reports, scoring, sweep
from auditloom.plans.audit import audit
from auditloom.sources import feeds
from auditloom.sources.work import ship_package

_FINDING = "subject string, rule_id string, severity string, score int, date date"


class Engine:
    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        ship_package(spark)

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str, schema: str) -> DataFrame:
        if not self._there(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.store}/{name}").parquet(f"{self.store}/{name}")

    # ---- diffs ----

    def audit(self, diffs: DataFrame, id_column: str = "package", text_column: str = "diff_text") -> DataFrame:
        """Scores, bands, rules and gaps of diffs."""
        return audit(diffs, id_column, text_column)

    def analyze_text(self, package: str, old: str | None, new: str) -> DataFrame:
        """The audit of one change, given as two texts; the same plan as for many."""
        rows = self.spark.createDataFrame([(package, old, new)], "package string, old string, new string")
        return self.audit(rows.select("package", reports.unified_diff("old", "new").alias("diff_text")))

    def inspect(self, diffs: DataFrame, package: str) -> DataFrame:
        return self.audit(diffs.where(F.col("package") == package))

    def review(self, installed: DataFrame, diffs: DataFrame, threshold: int = 20) -> DataFrame:
        """Audits of what an update would bring: installed packages (name, version) that are older than the newest snapshot, above the threshold."""
        newest = self.snapshot().select(F.col("name"), F.col("version").alias("latest"))
        old = installed.select(name_key(F.col("name")).alias("name"), F.col("version")).join(newest, "name").where(version_order("version", "latest") < 0)
        wanted = diffs.join(old.select(F.col("name").alias("package")).distinct(), "package", "left_semi")
        return reports.over_threshold(self.audit(wanted), threshold)

    def record(self, scored: DataFrame, day: str) -> None:
        """Keep an audit's findings under a day."""
        rows = scored.select(F.col("package").alias("subject"), F.explode(F.split("rules", ",")).alias("rule_id"), F.col("worst").alias("severity"), "score").where("rule_id <> ''")
        feeds.append_history(rows, f"{self.store}/findings", day)

    # ---- corpus ----

    def snapshot(self) -> DataFrame:
        """The newest snapshot."""
        every = self._snapshots()
        last = every.agg(F.max("snapshot_time").alias("snapshot_time"))
        return every.join(F.broadcast(last), "snapshot_time")

    def _snapshots(self) -> DataFrame:
        return self._read("snapshots", "name string, version string, maintainer string, snapshot_time long")

    def refresh_corpus(self, packages: DataFrame, snapshot_time: int, **thresholds: float) -> DataFrame:
        """Take in a registry snapshot (name, version, maintainer) and give the findings of the sweep against the one before.

        Snapshots come in the order of their times. Two are read; of the others only the counts that were kept when they came in.
        """
        rows = packages.select(name_key(F.col("name")).alias("name"), F.col("version"), F.coalesce(name_key(F.col("maintainer")), F.lit("")).alias("maintainer")).where("name IS NOT NULL")
        feeds.write_snapshot(rows, f"{self.store}/snapshots", snapshot_time)
        every = self._snapshots()
        before = every.where(F.col("snapshot_time") < snapshot_time).agg(F.max("snapshot_time")).first()[0]
        two = every.where(F.col("snapshot_time").isin([snapshot_time] + ([before] if before is not None else [])))
        raw = two.select(F.col("snapshot_time").alias("snapshot_no"), F.lit(1).alias("delivery_no"), "name", F.col("version").alias("current_version"), F.col("maintainer").alias("current_maintainer"))
        held = corpus.held_snapshots(raw)
        sweep.cycle_counts(held).drop("snapshot_no").write.mode("overwrite").parquet(f"{self.store}/counts/snapshot_no={snapshot_time}")
        past = self._read("counts", "maintainer string, k long, snapshot_no long").where(F.col("snapshot_no") < snapshot_time)
        return sweep.corpus_findings(held, past=past, **thresholds).where(F.col("snapshot_no") == snapshot_time)

    def watch(self, folder: str, every: str | None = None) -> None:
        """Take in the snapshots that arrive in a folder (with a column snapshot_time), one file at a time, and keep their findings."""
        stream = self.spark.readStream.schema("name string, version string, maintainer string, snapshot_time long").option("maxFilesPerTrigger", 1).parquet(folder)

        def take(batch: DataFrame, _: int) -> None:
            # A file holds one snapshot or a few, so there are few times.
            for r in sorted(batch.select("snapshot_time").distinct().collect()):
                found = self.refresh_corpus(batch.where(F.col("snapshot_time") == r.snapshot_time), r.snapshot_time)
                day = F.to_date(F.timestamp_seconds(F.lit(r.snapshot_time))).alias("d")
                date = self.spark.range(1).select(day.cast("string")).first()[0]
                feeds.append_history(found.select("subject", "rule_id", "severity", scoring.severity_weight(F.col("severity")).cast("int").alias("score")), f"{self.store}/findings", date)

        writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.store}/watch")
        query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        if not every:
            query.awaitTermination()

    # ---- indicators ----

    def import_indicators(self, path: str, source: str) -> DataFrame:
        """Take in a JSONL feed as all that its source says now, and give what the feed holds."""
        feeds.read_indicators(self.spark, path).drop("source").write.mode("overwrite").parquet(f"{self.store}/indicators/source={source}")
        return self.indicators().where(F.col("source") == source)

    def indicators(self) -> DataFrame:
        return self._read("indicators", "kind string, value string, confidence string, expires_at string, source string")

    def pivot(self, indicator: str) -> DataFrame:
        """Whom an indicator touches in the newest snapshot: by name, then by maintainer."""
        rows = self.snapshot()
        pairs = lambda c: rows.select(F.col("name").alias("subject"), F.col(c).alias("value"))
        return indicators.pivot([("name", pairs("name")), ("maintainer", pairs("maintainer"))], indicator).orderBy("subject")

    # ---- the store ----

    def history(self, subject: str | None = None, most: int = 100) -> DataFrame:
        """The newest findings, of one subject or of all that aren't forgotten."""
        rows = reports.without(self._read("findings", _FINDING), "subject", self._read("forgotten", "name string"))
        return (rows.where(F.col("subject") == subject) if subject else rows).orderBy(F.desc("date"), F.desc("score"), "subject", "rule_id").limit(most)

    def packages(self) -> DataFrame:
        """The newest snapshot's packages with their number of findings, by name."""
        found = reports.without(self._read("findings", _FINDING), "subject", self._read("forgotten", "name string"))
        counts = found.groupBy(F.col("subject").alias("name")).agg(F.count(F.lit(1)).alias("n_findings"), F.max("score").alias("score"))
        return self.snapshot().join(counts, "name", "left").fillna(0, ["n_findings", "score"]).orderBy("name")

    def status(self) -> DataFrame:
        """One row: snapshots, packages, findings, indicators."""
        one = lambda df, *a: df.agg(*a).withColumn("k", F.lit(1))
        n = F.count(F.lit(1))
        out = one(self._snapshots(), F.count_distinct("snapshot_time").alias("n_snapshots"), F.count_distinct("name").alias("n_packages"))
        out = out.join(one(self._read("findings", _FINDING), n.alias("n_findings")), "k").join(one(self.indicators(), n.alias("n_indicators")), "k")
        return out.drop("k")

    def forget(self, *names: str) -> None:
        """Show no findings of these subjects any more."""
        self.spark.createDataFrame([(n,) for n in names], "name string").write.mode("append").parquet(f"{self.store}/forgotten")

    def prune(self) -> DataFrame:
        """Forget what the newest snapshot no longer holds, and give all that is forgotten."""
        gone = reports.untracked(self._read("findings", _FINDING).select(F.col("subject").alias("name")), self.snapshot())
        gone.write.mode("append").parquet(f"{self.store}/forgotten")
        return self._read("forgotten", "name string").distinct()
