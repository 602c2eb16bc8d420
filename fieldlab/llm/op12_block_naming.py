"""Exact dedup by deterministic block naming.

A text, its A-Z lower-cased, is cut into blocks of BLOCK bytes. The distinct blocks of the corpus are sorted, and a
block's name is its integer place. Then adjacent names of a document are paired, the distinct pairs are sorted and
named in turn, and so on until each document has one name: its identity, with the number of rounds. Names are given
to whole blocks and whole pairs, so two documents have one identity only if their texts are equal.

Blocks meet their names by a 128-bit hash, after a check that no two distinct blocks of the corpus share one; if some
do, another seed is taken. So contents are shuffled once, to find the distinct ones, and partial aggregation takes the
copies of a block out before that. Names are written to the shared folder before they are used: a lost executor
can't give a block two names, and Spark can split the rows of a block or of a group that is repeated a lot.

Null or empty text is one empty block. Rows that are repeated are documents of their own: of those with the largest
id one is kept. Null ids come last. Columns of docs other than text stay; those named as added
ones are replaced, and the names _row, _hashes, _level, _name and _keep are taken.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import Stored, az_lower, table

#: Bytes of a block.
BLOCK = 1024
ADDED = ["keep_id", "group_size", "kept"]


def blocks(text: Column, size: int = BLOCK) -> Column:
    """The blocks of a text's bytes, one empty block for none."""
    raw = az_lower(F.coalesce(text, F.lit(""))).cast("binary")
    starts = lambda r: F.sequence(F.lit(1), F.greatest(F.octet_length(r), F.lit(1)), F.lit(size))
    # The outer array holds the bytes once; named within the inner function, they'd be made anew for each block.
    return F.flatten(F.transform(F.array(raw), lambda r: F.transform(starts(r), lambda at: F.substring(r, at, F.lit(size)))))


def hashed(block: Column, seed: int) -> Column:
    """128 bits of a block; the seed goes first, so that colliding blocks part with another one."""
    return F.struct(F.xxhash64(F.lit(2 * seed), block).alias("a"), F.xxhash64(F.lit(2 * seed + 1), block).alias("b"))


def named(distinct: DataFrame, order: list[str], keys: list[Column]) -> DataFrame:
    """(keys, name) of distinct rows: their places in the sorted parts that they are dealt to. To be written at once."""
    return distinct.sortWithinPartitions(*order).select(*keys, F.monotonically_increasing_id().alias("name"))


def block_names(docs: DataFrame, text: str, size: int, store: Stored) -> tuple[DataFrame, int]:
    """(a, b, name) of the distinct blocks, and the seed with which a and b tell them all apart."""
    distinct = docs.select(F.explode(blocks(F.col(text), size)).alias("block")).distinct()
    for seed in count():
        h = hashed(F.col("block"), seed)
        names = store(named(distinct, ["block"], [h["a"].alias("a"), h["b"].alias("b")]))
        if names.groupBy("a", "b").count().where("count > 1").isEmpty():
            return names, seed


def identities(docs: DataFrame, text: str, size: int, store: Stored) -> DataFrame:
    """docs without text, with _row, text_sha256 and the identity: _level (rounds of pairing) and _name."""
    names, seed = block_names(docs, text, size, store)
    lower = az_lower(F.coalesce(F.col(text), F.lit("")))
    kept = [F.col(c) for c in docs.columns if c not in (text, "_row", "_hashes", "_level", "_name", "_keep", "text_sha256", *ADDED)]
    rows = docs.select(*kept, F.sha2(lower, 256).alias("text_sha256"), F.transform(blocks(F.col(text), size), lambda b: hashed(b, seed)).alias("_hashes"), F.monotonically_increasing_id().alias("_row"))
    rows = store(rows)  # so a row's number is the same for all that follows

    places = rows.select("_row", F.size("_hashes").alias("m"), F.posexplode("_hashes").alias("k", "h")).select("_row", "m", "k", "h.a", "h.b")
    most = rows.agg(F.max(F.size("_hashes"))).first()[0] or 1
    done, level = [], 0
    while True:
        now = places.join(names, ["a", "b"]).select("_row", "m", "k", "name")
        if most == 1:
            done.append(now.select("_row", F.lit(level).alias("_level"), F.col("name").alias("_name")))
            break
        now = store(now)
        done.append(now.where("m = 1").select("_row", F.lit(level).alias("_level"), F.col("name").alias("_name")))
        pair = [F.max(F.when(F.col("k") % 2 == i, F.col("name"))) for i in (0, 1)]
        halves = now.where("m > 1").groupBy("_row", F.ceil(F.col("m") / 2).cast("int").alias("m"), F.floor(F.col("k") / 2).cast("int").alias("k"))
        places = store(halves.agg(pair[0].alias("a"), F.coalesce(pair[1], F.lit(-1)).alias("b")))  # -1: a last name without partner
        names = store(named(places.select("a", "b").distinct(), ["a", "b"], [F.col("a"), F.col("b")]))
        most, level = -(-most // 2), level + 1
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    return rows.drop("_hashes").join(every, "_row")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = BLOCK) -> DataFrame:
    """docs without text, with text_sha256, keep_id (largest id of equal texts), group_size and kept."""
    store, work = Stored(docs.sparkSession), Stored(docs.sparkSession)
    rows = store(identities(docs, text, size, work))
    work.remove()
    groups = rows.groupBy("_level", "_name").agg(F.max(F.struct(F.col(id).alias("id"), "_row")).alias("top"), F.count("*").alias("group_size"))
    groups = store(groups.select("_level", "_name", F.col("top.id").alias("keep_id"), F.col("top._row").alias("_keep"), "group_size"))
    return rows.join(groups, ["_level", "_name"]).withColumn("kept", F.col("_row") == F.col("_keep")).drop("_level", "_name", "_row", "_keep")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, r DESC)
"""
