"""Line dedup over levelled sorted runs of line hashes.

A run holds, for the line keys of some batches, (key, documents that hold it,
largest document id). Runs are written into buckets of the key's hash, sorted by
key, so that runs are merged, and anti-joined by a batch, bucket by bucket and
never shuffled again. Each new batch merge-anti-joins what the runs have settled
(keys already found in enough documents), adds the rest as a run of level 0, and
``FANOUT`` runs of a level are compacted into one of the next. Batches come in
descending ids, so a key's first run already has its largest id, and settled
keys cost later batches nothing.

A key is the MD5 of the normalised line (128 bits). Finding the keys shuffles
keys and ids alone; then texts are shuffled once, to meet the list of keys that
each loses. A key's rows are joined under AQE's skew split, so a line that a
third of all documents hold does not meet in one task.

Defined results: a null or empty text is one empty line; rows with one id are
one document; rows with a null id are one document too, which never keeps a
line against another; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.common import Scratch, ascii_lower, count_partitions, let, removed, scratch, table, written

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2


def line_key(line: Column) -> Column:
    return F.md5(ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\f\r"))))


def _long(line: Column, min_chars: int) -> Column:
    return F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) >= min_chars


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The runs: partitions of one bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.path = scratch(spark, "line-runs")
        self.name = "line_runs_" + self.path.rsplit("-", 1)[-1]
        self.buckets = count_partitions(spark)
        self.levels: list[list[int]] = []
        self.n_runs = 0

    def _merged(self, runs: list[int]) -> DataFrame:
        rows = self.spark.table(self.name).where(F.col("run").isin(runs))
        return rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("max_id").alias("max_id"))

    def _write(self, df: DataFrame, level: int) -> None:
        rows = df.select("key", "n_docs", "max_id", F.lit(self.n_runs).alias("run"))
        writer = rows.write.mode("append").format("parquet").option("compression", "zstd").option("path", self.path)
        writer.partitionBy("run").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self.name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(self.n_runs)
        self.n_runs += 1

    def state(self) -> DataFrame:
        """Every key of the runs, merged."""
        return self._merged([r for rs in self.levels for r in rs])

    def unsettled(self, own: DataFrame) -> DataFrame:
        """The rows of a batch whose keys the runs have not yet found in enough documents."""
        settled = self.state().where(F.col("n_docs") >= self.min_docs).select("key")
        return own.join(settled.hint("merge"), "key", "left_anti")

    def add(self, pairs: DataFrame) -> None:
        """pairs: distinct or not (key, id) of a batch; ids of a batch are in no other."""
        own = pairs.distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("max_id"))
        self._write(self.unsettled(own) if any(self.levels) else own, 0)
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                self._write(self._merged(runs), level + 1)
                self.levels[level] = []

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        removed(self.spark, self.path)


def batch_ranges(low: int, high: int, batches: int) -> list[tuple[int, int]]:
    """The ids from low to high in parts, as first and last of each, highest first; ids may be any 64-bit numbers."""
    edges = [low + (high - low + 1) * b // batches for b in range(batches + 1)]
    return [(a, b - 1) for a, b in reversed(list(zip(edges[:-1], edges[1:], strict=True))) if a < b]


def dropped_keys(docs: DataFrame, id_col: str, text: str, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """(id, drop): for each document that loses lines, their keys."""
    spark = docs.sparkSession
    steps = Scratch(spark)
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: _long(x, min_chars)), line_key))
    pairs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.explode(keys).alias("key")).select("id", F.unhex("key").alias("key"))
    pairs = steps.written(pairs, "line-keys")
    low, high = pairs.agg(F.min("id"), F.max("id")).first()
    runs = LineRuns(spark, min_docs)
    for first, last in [] if low is None else batch_ranges(low, high, batches):
        inside = F.col("id").between(first, last)
        runs.add(pairs.where(inside | F.col("id").isNull() if first == low else inside))
    if low is None:
        runs.add(pairs)
    # Written out, so that both sides of the join are plain exchanges and AQE can split a line that very many documents hold.
    often = steps.written(runs.state().where(F.col("n_docs") >= min_docs).select("key", "max_id"), "line-often")
    runs.drop()
    lost = pairs.join(often, "key").where(~F.col("id").eqNullSafe(F.col("max_id")))
    drops = written(lost.groupBy("id").agg(F.collect_set(F.lower(F.hex("key"))).alias("drop")), "line-drops")
    steps.clear()
    return drops


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", out: str = "kept_text",
    min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES,
) -> DataFrame:
    """Adds ``out`` (the text without its dropped lines), n_lines and n_dropped."""
    drops = dropped_keys(docs, id_col, text, min_chars, min_docs, batches).withColumnsRenamed({"id": "__id", "drop": "__drop"})
    both = docs.join(drops.hint("shuffle_hash"), docs[id_col].eqNullSafe(drops["__id"]), "left")

    def kept(lines: Column) -> Column:
        stays = lambda x: ~(_long(x, min_chars) & F.array_contains("__drop", line_key(x)))
        return F.when(F.col("__drop").isNull(), lines).otherwise(F.filter(lines, stays))

    result = let(
        _lines(F.col(text)),
        lambda x: let(
            kept(x),
            lambda k: F.struct(
                F.array_join(k, "\n").alias("t"), F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(k)).cast("bigint").alias("d")
            ),
        ),
    )
    return both.withColumn("__r", result).withColumns({out: F.col("__r.t"), "n_lines": F.col("__r.n"), "n_dropped": F.col("__r.d")}).drop("__r", "__id", "__drop")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, often.keeper IS NOT NULL AND k.doc_id <> often.keeper AS gone FROM k LEFT JOIN often ON k.key = often.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
