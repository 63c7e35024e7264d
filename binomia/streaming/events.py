"""The usage log as streams: sessions, throttling, counters, dashboard. Each gives what its batch operator gives.

Sessions and counters are Spark's own stateful operators. Throttling and the dashboard run their batch operators on each micro-batch, beside a state that is a table: so one
user's events spread over tasks in a stream too. State and output are committed together by the number of the micro-batch (`Ledger`), so that one repeated after a failure counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from binomia.functions.shared import drop_written, new_path, written
from binomia.operators import events as batch
from binomia.operators import throttle
from binomia.operators.events import LAST, SPECIES_A_WRITE
from binomia.sources.ledger import Ledger

WRITER = "stream"
FLUSH = 1 << 62  # the number of the commit that closes a throttled stream
LONG_AGO = -(1 << 62)
TIDY = 64  # micro-batches after which parts of states that were replaced are deleted


def event_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """path: a Parquet folder or file; as a pattern, which a stream takes for either."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(f"{path}*")


def once_a_session(visits: DataFrame, late: str = "1 day") -> DataFrame:
    """One visit of each (user_id, session); the state of a session is let go when the watermark has passed it."""
    return visits.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "session"])


class Throttled:
    """Throttling of a stream of (user_id, event_id, ts) that may be out of order by `late_s`.

    Events wait in table `pending` until the watermark, the latest time less late_s, has passed them; then the batch operator runs over them and the
    last event accepted of each user, which it accepts again. Table `last` holds only users whose gap the watermark has not passed, as others' next events are accepted anyway. Events behind the
    watermark when they come go to table `late`. flush() takes what waits, at the end of a stream.

    Events without a time are left out; an event repeated in the stream is an event of the same time, so it isn't accepted twice.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, gap_s: float, late_s: float) -> None:
        self.ledger, self.schema, self.gap_s, self.late_s = Ledger(spark, path), schema, gap_s, late_s

    def step(self, rows: DataFrame, number: int) -> None:
        """One micro-batch; one that is committed already changes nothing."""
        if not self.ledger.committed(WRITER, number):
            rows = rows.select("user_id", "event_id", "ts").where("ts IS NOT NULL")
            self._advance(rows, number, flush=False)

    def flush(self) -> None:
        self._advance(self.ledger.spark.createDataFrame([], self.schema), FLUSH, flush=True)

    def _advance(self, rows: DataFrame, number: int, flush: bool) -> None:
        led, t = self.ledger, F.unix_micros(F.col("ts").cast("timestamp"))
        mark = led.read("watermark", "at long").first()
        passed = LONG_AGO if mark is None else mark[0]
        held = led.read("pending", self.schema)
        newest = (held if flush else rows).agg(F.max(t)).first()[0]
        now = passed if newest is None else max(passed, newest - (0 if flush else round(self.late_s * 1_000_000)))
        pending = held.unionByName(rows.where(t > passed))
        accepted = written(throttle.rate_limited(led.read("last", self.schema).unionByName(pending.where(t <= now)), self.gap_s), "accepted")
        last = accepted.groupBy("user_id").agg(F.max_by(F.struct("user_id", "event_id", "ts"), "ts").alias("r")).select("r.*").where(t + round(self.gap_s * 1_000_000) > now)
        at = led.spark.createDataFrame([(now,)], "at long")
        led.commit(WRITER, number, {"accepted": accepted.where(t > passed), "late": rows.where(t <= passed)}, {"pending": pending.where(t > now), "last": last, "watermark": at})
        drop_written(accepted)
        if number % TIDY == TIDY - 1:
            led.clean()

    def accepted(self) -> DataFrame:
        return self.ledger.read("accepted", self.schema)

    def run(self, events: DataFrame, checkpoint: str) -> StreamingQuery:
        return events.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def throttled(events: DataFrame, gap_s: float, late_s: float, path: str | None = None) -> Throttled:
    """All that is there of a stream, throttled and flushed."""
    spark = events.sparkSession
    base = path or new_path(spark, "throttled")
    rows = events.select("user_id", "event_id", "ts")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = Throttled(spark, f"{base}/tables", schema, gap_s, late_s)
    out.run(rows, f"{base}/state").awaitTermination()
    out.flush()
    return out


def counters(events: DataFrame, n) -> DataFrame:
    """Sessions and species found so far."""
    return events.agg(F.count("*").alias("sessions"), F.coalesce(F.sum(F.when(n <= SPECIES_A_WRITE, n)), F.lit(0)).cast("long").alias("species_total"))


class Dashboard:
    """Counters and the last visits of a stream: the state is a row of sums and the last `n` visits, whatever has been read."""

    def __init__(self, spark: SparkSession, path: str, schema: str, species: Column, n: int = LAST) -> None:
        self.ledger, self.schema, self.species, self.n = Ledger(spark, path), schema, species, n

    def step(self, rows: DataFrame, number: int) -> None:
        if self.ledger.committed(WRITER, number):
            return
        sums = self.ledger.read("sums", "sessions long, species_total long").unionByName(batch.counters(rows, self.species))
        recent = batch.last_visits(self.ledger.read("recent", self.schema).unionByName(rows), self.n)
        total = sums.agg(*(F.sum(c).alias(c) for c in ("sessions", "species_total")))
        self.ledger.commit(WRITER, number, replace={"sums": total, "recent": recent})
        if number % TIDY == TIDY - 1:
            self.ledger.clean()

    def shown(self) -> DataFrame:
        """The dashboard's row as of the last micro-batch."""
        recent = self.ledger.read("recent", self.schema).agg(F.countDistinct(batch.location()).alias("locations"), F.count_if((F.col("lat") != 0) & (F.col("lng") != 0)).alias("markers"))
        sums = self.ledger.read("sums", "sessions long, species_total long").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sessions", "species_total")))
        return sums.crossJoin(recent)  # one row each

    def run(self, visits: DataFrame, checkpoint: str) -> StreamingQuery:
        return visits.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dashboard(visits: DataFrame, species: Column, n: int = LAST) -> Dashboard:
    """All that is there of a stream of visits, read once."""
    spark = visits.sparkSession
    base = new_path(spark, "dashboard")
    out = Dashboard(spark, f"{base}/tables", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in visits.schema), species, n)
    out.run(visits, f"{base}/state").awaitTermination()
    return out


def append_valid(visits: DataFrame, ok, path: str, checkpoint: str) -> StreamingQuery:
    """A running query that appends valid visits to a table of a ledger, and the others to `rejected`; a micro-batch counts once."""
    ledger = Ledger(visits.sparkSession, path)

    def step(rows: DataFrame, number: int) -> None:
        marked = rows.withColumn("_ok", ok)
        ledger.commit(WRITER, number, {"valid": marked.where("_ok").drop("_ok"), "rejected": marked.where("NOT _ok").drop("_ok")})

    return visits.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(df: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all that is there now, through files in the shared folder; of complete results the last one."""
    spark = df.sparkSession
    base = new_path(spark, "stream")
    ledger = Ledger(spark, f"{base}/out")

    def save(rows: DataFrame, number: int) -> None:
        ledger.commit(WRITER, number, **{"replace" if mode == "complete" else "append": {"out": rows}})

    query = df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return ledger.read("out")
