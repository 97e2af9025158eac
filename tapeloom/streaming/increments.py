"""Streams over arriving tables (ST1-ST3).

Every sink writes a folder per batch id and replaces it on a retry, so a restarted query repeats a batch
without doubling it. State that would grow for ever (recordings done, decisions applied) lives in tables cut into
buckets by key, not in the state store; only open windows are kept there. A batch reads and writes the buckets it
touches, whatever the number of batches before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.workflow import apply_to_candidates, apply_to_recordings, create_jams, decision_jams, resolve, run_step
from tapeloom.session import delete_folder, discard, store

BUCKETS = 64
LOG = "recording_id long, step string, version string, completed_at timestamp_ntz, status string, error_message string"


def read_table_stream(spark: SparkSession, folder: str, name: str, **options) -> DataFrame:
    """Files named ``name*.parquet`` of a folder as a stream, with the schema of the files there now."""
    schema = spark.read.option("pathGlobFilter", f"{name}*.parquet").parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet").options(**options).parquet(folder)


def hopping_stats(
    frames: DataFrame, keys: list[str], ts: str, value: str, length: str, step: str, started_at: Column,
    lateness: str = "1 hour",
) -> DataFrame:
    """ST1: mean and population variance per key and hopping event-time window.

    A window that begins before the recording started is dropped, as segments never begin before 0.
    """
    started = frames.withColumn("_t", F.col(ts).cast("timestamp")).withColumn("started_at", started_at.cast("timestamp"))
    windows = started.withWatermark("_t", lateness).groupBy(*keys, "started_at", F.window("_t", length, step).alias("w"))
    return windows.agg(
        F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.count(F.lit(1)).alias("rows")
    ).filter(F.col("w.start") >= F.col("started_at")).select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "variance", "rows"
    )


def run_updates(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Drain a windowed aggregate in update mode; each batch holds the windows that changed in it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_updates(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """Newest value of every window written by ``run_updates``."""
    rows = spark.read.option("basePath", out).parquet(out)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in rest]
    )


class Buckets:
    """A table in buckets by a hash of ``key``; batch ``b`` sees what all batches before it left.

    A batch writes the buckets it changes to a folder of its own and then a list of the newest folder of every bucket. Lists of the
    last two batches and the folders they name are kept, so that a batch can be repeated; older ones are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema, number: int | None = None):
        self.spark, self.folder, self.key, self.schema, self.number = spark, folder, key, schema, number or BUCKETS

    def of(self, keys: DataFrame) -> set[int]:
        """Buckets of the ids in the one column of ``keys``."""
        numbers = keys.select(F.pmod(F.xxhash64(F.col(keys.columns[0]).cast("long")), F.lit(self.number)).cast("int").alias("b"))
        return {r["b"] for r in numbers.distinct().collect()}  # ``number`` at most

    def listed(self, batch: int) -> dict[int, int] | None:
        """Bucket -> batch that wrote its newest rows, as batch ``batch`` left it; None if that batch left no list."""
        path = f"{self.folder}/lists/batch={batch}"
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not jvm.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(jvm):
            return None
        return {r["bucket"]: r["batch"] for r in self.spark.read.schema("bucket int, batch int").json(path).collect()}

    def begin(self, base: DataFrame | None) -> None:
        """What there is before the first batch."""
        if self.listed(-1) is None and self.listed(0) is None:
            rows = base if base is not None else self.spark.createDataFrame([], self.schema)
            self.write(-1, rows, set(range(self.number)))

    def paths(self, batch: int, buckets: set[int] | None = None) -> list[str]:
        """Folders that hold the buckets (all by default) before ``batch``; one per bucket at most."""
        return [f"{self.folder}/rows/batch={b}/bucket={n}" for n, b in sorted(self.listed(batch - 1).items()) if buckets is None or n in buckets]

    def read(self, batch: int, buckets: set[int] | None = None) -> DataFrame:
        paths = self.paths(batch, buckets)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, batch: int, rows: DataFrame, buckets: set[int]) -> None:
        """Replace the given buckets by ``rows``, which lie in them."""
        number = F.pmod(F.xxhash64(F.col(self.key).cast("long")), F.lit(self.number)).cast("int")
        own = f"{self.folder}/rows/batch={batch}"
        rows.withColumn("bucket", number).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(own)
        before = (self.listed(batch - 1) or {}) if batch >= 0 else {}
        held = self.spark.read.parquet(own).select("bucket").distinct().collect() if self._has_rows(own) else []
        now = {n: b for n, b in before.items() if n not in buckets} | {r["bucket"]: batch for r in held}
        self.spark.createDataFrame(sorted(now.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").json(f"{self.folder}/lists/batch={batch}")
        older = self.listed(batch - 2) if batch >= 1 else None
        if older is not None:  # nothing repeats a batch before this one any more
            for n, b in older.items():
                if before.get(n) != b:
                    delete_folder(self.spark, f"{self.folder}/rows/batch={b}/bucket={n}")
            delete_folder(self.spark, f"{self.folder}/lists/batch={batch - 2}")

    def _has_rows(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        status = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
        return any(f.isDirectory() for f in status)

    def newest(self) -> DataFrame:
        """The table after the last batch that wrote all of its buckets."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/lists")
        status = path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
        batches = sorted((int(f.getPath().getName().split("=")[1]) for f in status), reverse=True)  # three at most
        return self.read(next(b for b in batches if self.listed(b) is not None) + 1)


def step_log(spark: SparkSession, out: str) -> Buckets:
    return Buckets(spark, f"{out}/log", "recording_id", spark.createDataFrame([], LOG).schema)


def process_new_recordings(
    batch: DataFrame, batch_id: int, out: str, step: str, version: str, at: Column, work: Callable[[DataFrame], DataFrame],
) -> None:
    """ST2: one batch of arriving recordings; the log of their buckets tells which are done."""
    log = step_log(batch.sparkSession, out)
    log.begin(None)
    rows = batch.dropDuplicates(["id"])
    touched = log.of(rows.select("id"))
    done = log.read(batch_id, touched)
    _, entries = run_step(rows, done, step, version, at, work)
    log.write(batch_id, done.unionByName(entries.select(done.columns)), touched)


def run_new_recordings(
    stream: DataFrame, out: str, checkpoint: str, step: str, version: str, at: Column,
    work: Callable[[DataFrame], DataFrame],
) -> None:
    """ST2: process every arriving recording once; the log written so far tells which are done.

    Recordings that failed are tried again when they arrive again.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        process_new_recordings(batch, batch_id, out, step, version, at, work)

    query = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def decision_tables(spark: SparkSession, out: str, recordings: DataFrame, songs: DataFrame, candidates: DataFrame) -> dict[str, Buckets]:
    """The tables that decisions change, and the owners of candidates, which name the recording a decision is about."""
    owners = candidates.select("id", "recording_id")
    bases = {"recordings": (recordings, "id"), "songs": (songs, "id"), "candidates": (candidates, "recording_id"), "owners": (owners, "id")}
    tables = {n: Buckets(spark, f"{out}/{n}", key, df.schema) for n, (df, key) in bases.items()}
    for name, table in tables.items():
        table.begin(bases[name][0])
    return tables


def apply_decisions(batch: DataFrame, batch_id: int, sessions: DataFrame, tables: dict[str, Buckets]) -> None:
    """ST3: one batch of decisions; recordings and candidates are read and written in the buckets of the recordings concerned.

    Songs are read whole, as new titles and slugs are counted among all of them, and written where new ones fall.
    """
    owners = tables["owners"].read(0, tables["owners"].of(batch.filter("candidate_id is not null").select("candidate_id")))
    about = batch.filter("recording_id is not null").select("recording_id").unionByName(
        owners.join(batch.select(F.col("candidate_id").alias("id")), "id", "left_semi").select("recording_id"))
    touched = tables["recordings"].of(about)
    recs, cands, known = tables["recordings"].read(batch_id, touched), tables["candidates"].read(batch_id, touched), tables["songs"].read(batch_id)
    batch = store(resolve(batch, cands), "decisions")
    jams = decision_jams(batch, recs, cands)
    dated = recs.select(F.col("id").alias("recording_id"), "session_id").join(
        sessions.select(F.col("id").alias("session_id"), F.col("date").alias("session_date")), "session_id", "left"
    )
    new = create_jams(jams.join(dated, "recording_id"), known, "session_date", "seq")
    tables["recordings"].write(batch_id, apply_to_recordings(recs, batch, cands, new, known), touched)
    tables["candidates"].write(batch_id, apply_to_candidates(cands, batch), touched)
    created = tables["songs"].of(new.select("id"))
    grown = tables["songs"].read(batch_id, created).unionByName(new.select("id", "title", "slug", "song_type"), allowMissingColumns=True)
    tables["songs"].write(batch_id, grown, created)
    discard(batch)


def run_decisions(
    stream: DataFrame, recordings: DataFrame, sessions: DataFrame, songs: DataFrame, candidates: DataFrame,
    out: str, checkpoint: str,
) -> None:
    """ST3: apply decisions as they arrive. Splits are left to a batch job, because they give out new ids."""
    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_decisions(batch, batch_id, sessions, decision_tables(batch.sparkSession, out, recordings, songs, candidates))

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
