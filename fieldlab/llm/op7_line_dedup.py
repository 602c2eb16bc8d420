"""Line dedup over levelled sorted runs of line hashes.

Each batch of documents gives one run: distinct line keys (128-bit hashes) with the number of documents
that hold them, bucketed and sorted by key. A new batch is merge-anti-joined with the runs: keys that a
run already knows to be frequent aren't added again. FANOUT runs of a level are compacted into one run
of the next level, where counts add up. All runs share their buckets, so neither the anti-joins nor the
final merge of two runs shuffles them.

Null or empty text is one empty line. Empty keys are never counted or dropped. Repeated rows are
separate documents. Extra columns pass through; columns named n_lines or n_dropped are replaced.
"""

from __future__ import annotations

import uuid

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import add_columns, cut, raw_texts, small_batches, table, tidy

#: Runs of a level that are compacted into one of the next.
FANOUT = 3
#: Batches that a table is dealt into by the query.
BATCHES = 4
#: Frequent keys (16 bytes each) that may be sent to every worker; above it they're joined.
BROADCAST_KEYS = 400_000
#: Distinct keys that a task holds before it passes their counts on.
TASK_KEYS = 100_000

BLANKS = b" \t\n\x0b\x0c\r"


def keys_of(raw: bytes) -> list[bytes]:
    """The key of each line; b'' for an empty one."""
    return [x.strip(BLANKS).lower() for x in raw.split(b"\n")]


def key_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n): in how many documents each line key is."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        digest, counts = xxhash.xxh3_128_digest, {}
        pour = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["key", "n"])
        for batch in batches:
            for raw in raw_texts(batch, text):
                for key in set(keys_of(raw)):
                    if key:
                        key = digest(key)
                        counts[key] = counts.get(key, 0) + 1
            if len(counts) > TASK_KEYS:
                yield pour()
                counts.clear()
        yield pour()

    return docs.select(text).mapInArrow(tidy(run), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


class LineRuns:
    """The levelled runs, as bucketed tables in the shared warehouse."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, buckets: int | None = None):
        self.spark, self.min_docs = spark, min_docs
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def write(self, counts: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        counts.repartition(self.buckets, "key").write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= FANOUT:
            old, self.levels[level] = self.levels[level], []
            self.write(self.merged([self.spark.table(x) for x in old]), level + 1)
            for x in old:
                self.spark.sql(f"DROP TABLE {x}")

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        """Counts of several runs added up, by merge joins of the sorted runs.

        Not by a union: Spark 4.1 takes a union of tables with equal buckets for partitioned by key, then
        drops the bucketing from its scans, and a grouping of it gives a key several rows.
        """
        out = runs[0]
        for run in runs[1:]:
            right = run.select(F.col("key").alias("_k"), F.col("n").alias("_n"))
            n = F.coalesce("n", F.lit(0).cast("long")) + F.coalesce("_n", F.lit(0).cast("long"))
            out = out.join(right, F.col("key") == F.col("_k"), "full_outer").select(F.coalesce("key", "_k").alias("key"), n.alias("n"))
        return out

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Merge-anti-join of a new batch with the runs; what is left becomes a run of level 0."""
        new = key_counts(docs, text)
        for run in self.runs():
            new = new.join(run.where(F.col("n") >= self.min_docs).select("key"), "key", "left_anti")
        self.write(new, 0)

    def frequent(self) -> DataFrame:
        """Keys that at least min_docs documents of all batches hold."""
        return self.merged(self.runs()).where(F.col("n") >= self.min_docs).select("key")

    def close(self) -> None:
        for level in self.levels:
            for x in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {x}")
        self.levels = [[]]


def batches_of(docs: DataFrame, n: int = BATCHES, text: str = "text") -> list[DataFrame]:
    """docs in n batches: files of a plain Parquet read, which has enough of them, else rows by a hash of their text."""
    plan = docs._jdf.queryExecution().analyzed().treeString().strip()
    files = sorted(docs.inputFiles()) if plan.startswith("Relation") and "\n" not in plan else []
    if len(files) >= n:
        return [docs.sparkSession.read.schema(docs.schema).parquet(*files[i::n]) for i in range(n)]
    return [docs.where(F.pmod(F.xxhash64(text), F.lit(n)) == i) for i in range(n)]


def drop_keys(docs: DataFrame, frequent: DataFrame, text: str = "text", most: int = BROADCAST_KEYS) -> DataFrame:
    """docs without the lines whose key is in frequent, with n_lines (before) and n_dropped."""
    sure = frequent.limit(most + 1).collect()
    if len(sure) <= most:
        sent = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in sure))

        def start():
            bad = sent.value
            return lambda raws: kept([(x, None) for x in raws], lambda key, _: key in bad)

        return replaced(add_columns(docs, text, "_kept string, n_lines long, n_dropped long", start), docs, text)
    # More keys than may be sent: (text, key) pairs meet them in a join, then each text its own keys.
    marked = add_columns(docs, text, "_h binary", lambda: lambda raws: [[xxhash.xxh3_128_digest(x) for x in raws]])
    pairs = add_columns(marked.select("_h", text), text, "_keys array<binary>", lambda: lambda raws: [[[xxhash.xxh3_128_digest(k) for k in set(keys_of(x)) if k] for x in raws]])
    own = pairs.select("_h", F.explode("_keys").alias("key")).distinct().join(frequent, "key", "left_semi").groupBy("_h").agg(F.collect_set("key").alias("_bad"))
    own = cut(own)  # so Spark can split the rows of a text that is repeated a lot
    joined = marked.join(own, "_h", "left").drop("_h")

    out = [f for f in docs.schema if f.name not in ("n_lines", "n_dropped")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bad = [frozenset(x or ()) for x in batch.column("_bad").to_pylist()]
            a, b, c = kept(list(zip(raw_texts(batch, text), bad, strict=True)), lambda key, own: key in own)
            new = {text: pa.array(a, pa.string()), "n_lines": pa.array(b, pa.int64()), "n_dropped": pa.array(c, pa.int64())}
            names = [f.name for f in out] + ["n_lines", "n_dropped"]
            yield pa.RecordBatch.from_arrays([new[n] if n in new else batch.column(n) for n in names], names)

    from pyspark.sql import types as T

    return joined.mapInArrow(tidy(run), T.StructType([*out, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def kept(texts: list, is_bad) -> tuple[list, list, list]:
    digest, out, lines, dropped = xxhash.xxh3_128_digest, [], [], []
    for raw, own in texts:
        all_lines = raw.split(b"\n")
        stay = [x for x in all_lines if not (k := x.strip(BLANKS).lower()) or not is_bad(digest(k), own)]
        out.append(raw.decode() if len(stay) == len(all_lines) else b"\n".join(stay).decode())
        lines.append(len(all_lines))
        dropped.append(len(all_lines) - len(stay))
    return out, lines, dropped


def replaced(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return df.select(*[F.col("_kept").alias(text) if c == text else F.col(c) for c in names], "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, batches: list[DataFrame] | None = None, min_docs: int = 10, text: str = "text", most: int = BROADCAST_KEYS) -> DataFrame:
    """docs without lines that at least min_docs documents hold. batches: docs, in parts; else docs is one batch."""
    runs = LineRuns(docs.sparkSession, min_docs)
    try:
        for batch in batches or [docs]:
            runs.add(batch, text)
        frequent = cut(runs.frequent())
    finally:
        runs.close()
    return drop_keys(docs, frequent, text, most)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = dedup_lines(docs.select("doc_id", "text"), batches_of(docs))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT r, doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.k IS NOT NULL) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f USING (k) GROUP BY r, doc_id
"""
