"""Line dedup by levelled sorted runs of line hashes; DataFrame functions only.

`LineRuns` keeps, like a log-structured store, bucketed tables sorted by line hash with the number of
documents holding the line. A line that reaches the threshold within a run is settled there. Documents come in batches by a hash, whatever the files' layout; each batch's lines are merge-anti-joined
against the settled lines of all runs before it (they need no more counting), and what is left becomes a run of level 0. When a level has `fanout`
runs they are compacted into one run of the next level: counts are summed, which settles more lines. All runs are bucketed and sorted alike, so a merge join with
them shuffles neither side again; a compaction deals its runs out anew. Buckets are as many as a batch's lines need, so that small runs aren't many tiny files. Two 64-bit hashes with different seeds stand for a line. In the last join, rows of the most frequent lines are salted.

Cases: a null or empty text is one empty line; empty keys are never dropped; a document counts once for a line
it repeats; repeated rows count as documents each; a null id is a value like any other; an empty table settles
nothing. Other columns are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from binomia.llm.common import LOWER, UPPER, table_path, written

STRIP = " \t\n\x0b\x0c\r"
BATCHES = 8
FANOUT = 4
SALT, HOT = 32, 8000  # rows of a line with more than a HOT-th of all lines are dealt over SALT parts; there are at most HOT such lines
BUCKET = 1 << 15  # lines of a batch a bucket
KEY = ("h1", "h2")


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, row, pos, h1, h2): a row a line with a key of at least one code point; th: the text's hash, row: a number for the row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("row"), F.split(F.translate(text, UPPER, LOWER), "\n", -1).alias("lines"))
    keyed = rows.select("id", "th", "row", F.posexplode("lines").alias("pos", "line")).withColumn("key", F.btrim("line", F.lit(STRIP))).where("key <> ''")
    return keyed.select("id", "th", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


class LineRuns:
    """Levelled sorted runs of (h1, h2, n), and settled runs of lines in at least `threshold` documents."""

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}  # of runs, by name

    def _write(self, df: DataFrame) -> str:
        """df, dealt out by h1 into the buckets, as a run. A task writes one file; should a shuffle have more parts than there are buckets, a task takes several of them."""
        name = f"binomia_run_{uuid.uuid4().hex}"
        self.paths[name] = table_path(self.spark, "run")
        df.coalesce(self.buckets).write.bucketBy(self.buckets, "h1").sortBy(*KEY).option("path", self.paths[name]).saveAsTable(name)
        return name

    def _runs(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def _settled(self, name: str) -> DataFrame:
        """Of a run, the lines that need no more counting: a filter on its table, which is written once."""
        return self.spark.table(name).where(F.col("n") >= self.threshold).select(*KEY)

    def uncounted(self, lines: DataFrame) -> DataFrame:
        """lines (h1, h2, ...) without those that a run has settled."""
        for name in self._runs():
            lines = lines.join(self._settled(name).hint("merge"), list(KEY), "left_anti")
        return lines

    def add(self, batch: DataFrame) -> None:
        """Counts a batch of (row, h1, h2): anti-joins what the runs have settled, then adds the rest as a run of its own."""
        own = batch.select("row", *KEY).repartition(self.buckets, "h1").distinct().groupBy(*KEY).agg(F.count("*").alias("n"))
        self.levels[0].append(self._write(self.uncounted(own)))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                self._compact(k)

    def _summed(self, names: list[str]) -> DataFrame:
        """Counts of runs added up. Their files are read by path: Spark 4.1 takes a union of bucketed tables to be bucketed but reads it table by table, which leaves equal lines of two runs apart."""
        rows = self.spark.read.schema("h1 long, h2 long, n long").parquet(*(self.paths[n] for n in names))
        return rows.repartition(self.buckets, "h1").groupBy(*KEY).agg(F.sum("n").alias("n"))

    def _compact(self, level: int) -> None:
        names, self.levels[level] = self.levels[level], []
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._write(self._summed(names)))
        self._drop(names)

    def _drop(self, names: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for n in names:
            self.spark.sql(f"DROP TABLE {n}")
            p = jvm.org.apache.hadoop.fs.Path(self.paths.pop(n))
            p.getFileSystem(conf).delete(p, True)

    def frequent(self) -> DataFrame:
        """(h1, h2, n) of every line in at least `threshold` documents of all batches; n counts up to where it settled."""
        return self._summed(self._runs()).where(F.col("n") >= self.threshold)

    def close(self) -> None:
        """Deletes the runs; frames over them must not be read afterwards."""
        self._drop(self._runs())
        self.levels = [[]]


def drop_frequent_lines(df: DataFrame, id_col: str, text_col: str, threshold: int = 10, batches: int = BATCHES, by_text: bool = False, keep_first: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, n_lines, n_dropped, kept): each document without the lines found in at least `threshold` documents.

    by_text: documents of equal text count as one, and come into the same batch. keep_first: the document with the smallest
    (id, text hash) of a frequent line's keeps it. carry: columns passed on; none may be named like an added one.
    """
    clashing = set(carry) & {id_col, "n_lines", "n_dropped", "kept"}
    if clashing:
        raise ValueError(f"carried columns are named like added ones: {sorted(clashing)}")
    spark = df.sparkSession
    lines = line_hashes(df, id_col, text_col)
    if by_text:
        lines = lines.withColumn("row", F.col("th"))  # equal texts come into one batch
    lines = written(lines.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(batches)).cast("int")).sortWithinPartitions("batch"), "lines")  # sorted, so that a batch's pages alone are read
    n_lines = lines.count()
    cores, most = spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = LineRuns(spark, threshold, buckets=min(most, max(cores, -(-n_lines // (batches * BUCKET)))))
    for k in range(batches):
        runs.add(lines.where(F.col("batch") == k))
    frequent = written(runs.frequent().coalesce(runs.buckets), "frequent")
    runs.close()
    hot = [r[0] for r in frequent.where(F.col("n") * HOT > n_lines).select("h1").collect()]
    is_hot = F.col("h1").isin(hot) if hot else F.lit(False)
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    salt = F.when(is_hot, F.pmod(F.xxhash64("row", "pos"), F.lit(SALT)).cast("int")).otherwise(0)
    hits = lines.select("id", "th", "pos", *KEY, salt.alias("salt")).join(frequent.select(*KEY, F.explode(parts).alias("salt")), [*KEY, "salt"], "left_semi")
    if keep_first:
        first = hits.groupBy(*KEY).agg(F.min(F.struct("id", "th")).alias("first")).select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), F.col("first.id").alias("f_id"), F.col("first.th").alias("f_th"))
        hits = hits.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")) & (F.col("th") == F.col("f_th")) & F.col("id").eqNullSafe(F.col("f_id")), "left_anti")
    hits = hits.groupBy("id", "th").agg(F.collect_set("pos").alias("gone"))
    hits = hits.select(F.col("id").alias("_id"), F.col("th").alias("_th"), "gone")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("_doc"), *carry, text.alias("_text"), F.xxhash64(text).alias("_hash"))
    joined = docs.join(hits, docs["_doc"].eqNullSafe(hits["_id"]) & (docs["_hash"] == hits["_th"]), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("_lines"), i)), "\n")
    return joined.withColumn("_lines", split_lines(F.col("_text"))).select(
        F.col("_doc").alias(id_col),
        *carry,
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("_text")).otherwise(kept).alias("kept"),
    )
