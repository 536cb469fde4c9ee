"""Streams: durable journals, routing of failures, and throughput with state."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.readers import _path, exists


def journal_rows(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, torn): a line that doesn't parse is torn if it is its file's last line and lacks a line end; any other raises.

    Files of any size are read by splits. One aggregate for each file decides: its lines' bytes with a line end each are one more
    than the file has where the last line lacks its own, and the only bad line has to be the last. It runs when this is called.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size"), F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).alias("_at"), F.col("value").alias("line"))
    lines = lines.withColumn("r", F.from_json("line", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    blank = F.trim(F.regexp_replace("line", r"[\t\r]", " ")) == ""
    lines = lines.withColumn("_bad", ~blank & (F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()))
    checked = lines.groupBy("_file").agg(F.sum(F.octet_length("line") + F.lit(1)).alias("bytes"), F.max("_size").alias("size"), F.count_if("_bad").alias("bad"), F.max_by("_bad", "_at").alias("last_bad"))
    # A byte order mark is three bytes of the file that no line has.
    unterminated = (F.col("bytes") - F.col("size")).isin(1, -2)
    inside = checked.where((F.col("bad") > 0) & ~((F.col("bad") == 1) & F.col("last_bad") & unterminated)).select("_file").limit(3).collect()
    if inside:
        raise ValueError(f"corrupt line inside {', '.join(sorted(r['_file'] for r in inside))}")
    return lines.where(~F.col("_bad") & ~blank).select("r.*").drop("_corrupt_record"), lines.where("_bad").select("_file", "line")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _put(batch: DataFrame, journal: str, name: str) -> None:
    """Write a batch as files of the journal with names of its own; files that an earlier try left under them go first."""
    beside = f"{journal}/_writing-{name}"
    batch.write.mode("overwrite").parquet(beside)
    fs, folder = _path(batch.sparkSession, beside)
    done = _path(batch.sparkSession, f"{journal}/{name}-00000.parquet")[1]
    if fs.exists(done):
        for old in fs.globStatus(_path(batch.sparkSession, f"{journal}/{name}-*.parquet")[1]):
            fs.delete(old.getPath(), False)
    found = sorted(s.getPath().toString() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-"))
    for i, file in reversed(list(enumerate(found))):  # the first one, which marks that there may be more, comes last
        fs.rename(_path(batch.sparkSession, file)[1], _path(batch.sparkSession, f"{journal}/{name}-{i:05d}.parquet")[1])
    fs.delete(folder, True)


def _known(stream: DataFrame, journal: str, place: str, key: str, digest: Column) -> DataFrame:
    """A stream of the keys and digests that the journal had when this was first called for place, where they are written once."""
    spark = stream.sparkSession
    if not exists(spark, f"{place}/_SUCCESS"):
        before = spark.read.schema(stream.schema).parquet(journal) if exists(spark, journal) else spark.createDataFrame([], stream.schema)
        before.select(key, digest).write.mode("overwrite").parquet(place)
    return spark.readStream.schema(stream.select(key, digest).schema).parquet(place)


def append_journal(stream: DataFrame, journal: str, checkpoint: str, key: str, **trigger):
    """A query that appends rows with new keys. A row like one that is there is ignored; the same key with other values stops it.

    Keys with a digest each are in the state store, and a key's row beside them, so a batch costs what it brings, whatever the
    journal's size; keys that the journal has when the query first starts come before the stream, from a folder of the checkpoint.
    Of equal rows the first passes into the sums of its key, so a key is touched only by what is new: its first row, or one that
    conflicts. A batch that runs again replaces its own files. The store is RocksDB; trigger is that of writeStream, everything
    there is by default.
    """
    spark, names = stream.sparkSession, stream.columns
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    digest = F.unhex(F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)).alias("_digest")
    known = _known(stream, journal, f"{checkpoint}/known", key, digest)
    rows = stream.select(F.col(key).alias("_key"), digest, F.lit(False).alias("_old"), F.struct(*names).alias("_row"))
    old = known.select(F.col(key).alias("_key"), "_digest", F.lit(True).alias("_old"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    passed = rows.union(old).dropDuplicates(["_key", "_digest", "_old"])
    sums = passed.groupBy("_key").agg(F.min("_digest").alias("_low"), F.max("_digest").alias("_high"), F.bool_or("_old").alias("_old"), F.first("_row", ignorenulls=True).alias("_row"))
    conflict = F.raise_error(F.concat(F.lit("conflicting rows in the journal: "), F.coalesce(F.col("_key").cast("string"), F.lit("null"))))
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def put(batch: DataFrame, epoch: int) -> None:
        fresh = batch.where(F.when(F.col("_low") == F.col("_high"), ~F.col("_old")).otherwise(conflict.cast("boolean"))).select("_row.*")
        _put(fresh, journal, f"{run}-{epoch:012d}")

    return sums.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(**trigger or {"availableNow": True})


def route_failures(stream: DataFrame, folder: str, checkpoint: str, status: str = "status"):
    """A query that writes each status to its own folder; a batch that runs again overwrites its own output."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_status", F.coalesce(status, F.lit("unknown"))).write.mode("overwrite").partitionBy("_status").parquet(f"{folder}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


RATES = "worker string, stage string, done long, total long, percent double, rate double, eta double"
STATE = "pid long, stage string, done long, at double"


def measured(state: tuple | None, pid: int, stage: str, done: int, total: int, now: float) -> tuple[tuple | None, tuple]:
    """(new state, (percent, rate, eta)). The state is where counting began; another pid or stage, or fewer done, begins anew."""
    if not total:
        return None, (None, None, None)
    if state is None or (state[0], state[1]) != (pid, stage) or done < state[2]:
        state = (pid, stage, done, now)
    seconds = now - state[3]
    rate = (done - state[2]) / seconds if seconds > 0 else None
    return state, (100.0 * done / total, rate, max(0, total - done) / rate if rate else None)


def rates(status: DataFrame) -> DataFrame:
    """Throughput and time left of each worker from its status rows, batch or stream (worker, pid, stage, done, total, observed_unix)."""

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = []
        for r in pd.concat(list(batches)).sort_values("observed_unix").itertuples():
            held, values = measured(held, r.pid, r.stage, r.done, r.total, r.observed_unix)
            rows.append((key[0], r.stage, r.done, r.total, *values))
        state.update(held) if held is not None else state.remove()
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RATES.split(", ")])

    return status.groupBy("worker").applyInPandasWithState(run, RATES, STATE, "append", GroupStateTimeout.NoTimeout)


def rates_batch(status: DataFrame) -> DataFrame:
    """The same for a finished table, with windows: a session begins where pid or stage changes or the count falls."""
    from pyspark.sql import Window

    order = Window.partitionBy("worker").orderBy("observed_unix", "event_id") if "event_id" in status.columns else Window.partitionBy("worker").orderBy("observed_unix")
    new = (~F.lag("pid").over(order).eqNullSafe(F.col("pid"))) | (~F.lag("stage").over(order).eqNullSafe(F.col("stage"))) | (F.col("done") < F.lag("done").over(order))
    rows = status.withColumn("_session", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order))
    base = Window.partitionBy("worker", "_session").orderBy(*(["observed_unix", "event_id"] if "event_id" in status.columns else ["observed_unix"]))
    seconds = F.col("observed_unix") - F.first("observed_unix").over(base)
    rows = rows.withColumn("rate", F.when(seconds > 0, (F.col("done") - F.first("done").over(base)) / F.nullif(seconds, F.lit(0.0))))
    return rows.withColumn("eta", F.when(F.col("rate") > 0, F.greatest(F.col("total") - F.col("done"), F.lit(0)) / F.nullif("rate", F.lit(0.0)))).drop("_session")


def latest_status(status: DataFrame, precedence: tuple[str, ...]) -> DataFrame:
    """One row for each worker: of rows with the control row's pid, the source that comes first; else the control row."""
    rank = reduce(lambda acc, i: acc.when(F.col("source") == precedence[i], i), range(len(precedence)), F).otherwise(len(precedence))
    control = status.where(F.col("source") == "control").select("worker", F.col("pid").alias("_pid"))
    own = status.join(control, "worker").where((F.col("pid") == F.col("_pid")) | (F.col("source") == "control"))
    rest = [c for c in status.columns if c != "worker"]
    return own.groupBy("worker").agg(F.min_by(F.struct(*rest), F.struct(rank, -F.col("observed_unix"))).alias("_r")).select("worker", "_r.*")


def polled(stream: DataFrame, seconds: int, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that runs a sink every so many seconds."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")


def is_ready(newest: Column, quiet_seconds: int = 60) -> Column:
    return newest < F.current_timestamp() - F.make_dt_interval(secs=F.lit(quiet_seconds))
