"""Benchmark decontamination as a prefix-filtered set join.

Records of the join are the distinct windows of the benchmark: WINDOW consecutive words of an item, or
the whole of a shorter one. Tokens are shingles of SHINGLE words (of all words in shorter windows). A
document contains a window only if it contains all of the window's tokens, so the necessary prefix is one
token: the rarest one, by a count over all documents. Documents are scanned for these prefix tokens only.
Where one occurs, its offset in the window gives the one place where the window may begin (positional
bound), which must leave room for the whole window (length bound); then the words are compared.

The benchmark is cut into blocks of about BLOCK (window, item) pairs, dealt by a hash of both, so a window that
very many items hold is in several blocks, with some of the items in each. A block fits in any worker, so its
size bounds what is sent. Where there are several, each is a pass that writes only what it found, by a 128-bit hash of
the text; at the end the documents meet that in one join, however many blocks there were.

Null or empty texts have no words: such documents are clean, such items never occur. Items without an id
mark words but aren't listed. Repeated rows are scored alike. Columns named n_words, hits, items or
contaminated are replaced; others pass through.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlab.llm.common import Stored, as_batch, cut, raw_texts, send, small_batches, table, tidy
from fieldlab.llm.text import words

WINDOW = 13
SHINGLE = 5
#: (window, item) pairs of a block.
BLOCK = 100_000
#: A document is contaminated if at least this share of its words is hit.
SHARE = 0.05

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FILTER_BITS = 20
#: Hashes of texts with hits that a task remembers at most.
SEEN = 1_000_000


def windows_of(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(window, item_id): the distinct windows of each item, words joined by a space."""
    small_batches(benchmark.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found, ids = [], []
            for raw, item in zip(raw_texts(batch, text), batch.column("item_id").to_pylist(), strict=True):
                w = words(raw)
                mine = {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ()
                found.extend(mine)
                ids.extend([item] * len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(ids, pa.string())], ["window", "item_id"])

    items = benchmark.select(F.col(text), F.col(item_id).cast("string").alias("item_id"))
    return items.mapInArrow(tidy(run), "window binary, item_id string").distinct()


def shingle_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = ids[:n].astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(1, k):
            h = (h + np.uint64(1)) * MULTIPLIER + ids[j : j + n]
        return h * MULTIPLIER ^ (h >> np.uint64(29))


class Block:
    """Windows with their tokens; once the tokens are counted, postings of the prefix tokens."""

    def __init__(self, windows: list[bytes], items: list[list[str]]):
        self.items = items
        split = [w.split(b" ") for w in windows]
        self.vocab = {w: i for i, w in enumerate(sorted({x for w in split for x in w}), 1)}
        self.windows = [np.array([self.vocab[x] for x in w], np.uint64) for w in split]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in self.windows})
        self.tokens = {k: np.unique(np.concatenate([shingle_hashes(w, k) for w in self.windows if min(SHINGLE, len(w)) == k])) for k in self.sizes}
        self.use({k: t for k, t in self.tokens.items()})

    def use(self, tokens: dict[int, np.ndarray]) -> None:
        """From now on scan for these tokens."""
        self.looked = tokens
        self.filters = {}
        for k, t in tokens.items():
            self.filters[k] = np.zeros(1 << FILTER_BITS, bool)
            self.filters[k][t >> np.uint64(64 - FILTER_BITS)] = True

    def rank(self, counts: dict[tuple[int, int], int]) -> None:
        """The rarest token of each window becomes its prefix."""
        self.postings: dict[int, dict[int, list[tuple[int, int]]]] = {k: {} for k in self.sizes}
        for n, w in enumerate(self.windows):
            k = min(SHINGLE, len(w))
            own = shingle_hashes(w, k).tolist()
            at = min(range(len(own)), key=lambda i: (counts.get((k, own[i]), 0), own[i]))
            self.postings[k].setdefault(own[at], []).append((n, at))
        self.use({k: np.array(sorted(p), np.uint64) for k, p in self.postings.items()})

    def numbers(self, w: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, w, repeat(0)), np.uint64, len(w))

    def found(self, ids: np.ndarray):
        """(size, places, tokens) where looked-for tokens occur."""
        for k in self.sizes:
            h = shingle_hashes(ids, k)
            at = np.flatnonzero(self.filters[k][h >> np.uint64(64 - FILTER_BITS)])
            if len(at):
                h, t = h[at], self.looked[k]
                same = t[np.minimum(np.searchsorted(t, h), len(t) - 1)] == h
                if same.any():
                    yield k, at[same], h[same]

    def matches(self, ids: np.ndarray):
        """(start, window number) of each verified occurrence."""
        for k, places, tokens in self.found(ids):
            for p, token in zip(places.tolist(), tokens.tolist(), strict=True):
                for n, offset in self.postings[k][token]:
                    start, w = p - offset, self.windows[n]
                    if start >= 0 and start + len(w) <= len(ids) and np.array_equal(ids[start : start + len(w)], w):
                        yield start, n


def token_counts(docs: DataFrame, sent, text: str) -> dict[tuple[int, int], int]:
    """How often each token of the block occurs in all documents."""

    def run(batches):
        block = sent()
        counts = {k: np.zeros(len(t), np.int64) for k, t in block.tokens.items()}
        for batch in batches:
            for raw in raw_texts(batch, text):
                for k, _, tokens in block.found(block.numbers(words(raw))):
                    np.add.at(counts[k], np.searchsorted(block.tokens[k], tokens), 1)
        import pyarrow as pa

        for k, c in counts.items():
            at = np.flatnonzero(c)
            yield as_batch([pa.array(np.full(len(at), k, np.int32)), pa.array(block.tokens[k][at].view(np.int64)), pa.array(c[at])], ["k", "token", "n"], {})

    rows = docs.select(text).mapInArrow(tidy(run), "k int, token long, n long").groupBy("k", "token").agg(F.sum("n").alias("n")).collect()
    return {(r.k, r.token % (1 << 64)): r.n for r in rows}


def merged(spans: Iterable[tuple[int, int]]) -> list[int]:
    """Spans as flat starts and ends, those that overlap or touch as one."""
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += (a, b)
    return flat


def hits_of(block: Block, ids: np.ndarray) -> tuple[list[int], list[str]]:
    """Merged word spans and sorted items of a text."""
    spans, items = [], set()
    for start, n in block.matches(ids):
        spans.append((start, start + len(block.windows[n])))
        items.update(block.items[n])
    return merged(spans), sorted(items)


def scan(docs: DataFrame, sent, text: str) -> DataFrame:
    """docs with n_words, and the hits (start, end of merged word spans, flat) and items of the only block."""
    kept = [c for c in docs.columns if c not in ("n_words", "_hits", "_items")]
    schema = T.StructType([*docs.select(*kept).schema, *T._parse_datatype_string("n_words long, _hits array<int>, _items array<string>")])

    def run(batches):
        import pyarrow as pa

        block = sent()
        for batch in batches:
            n_words, hits, items = [], [], []
            for raw in raw_texts(batch, text):
                ids = block.numbers(words(raw))
                spans, mine = hits_of(block, ids)
                n_words.append(len(ids))
                hits.append(spans)
                items.append(mine)
            columns = [batch.column(c) for c in kept] + [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_words", "_hits", "_items"])

    small_batches(docs.sparkSession)
    return docs.select(*kept).mapInArrow(tidy(run), schema)


def scan_texts(docs: DataFrame, sent, text: str) -> DataFrame:
    """(_op1_text, hits, items) of the texts in which one of several blocks occurs; of a text's copies a task tells one."""

    def run(batches):
        import pyarrow as pa

        block, seen = sent(), set()
        for batch in batches:
            rows = []
            for raw in raw_texts(batch, text):
                spans, items = hits_of(block, block.numbers(words(raw)))
                if spans and (h := xxhash.xxh3_128_digest(raw)) not in seen:
                    seen.add(h)
                    rows.append((h, spans, items))
            if len(seen) > SEEN:
                seen.clear()
            h, hits, items = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.binary()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["_op1_text", "hits", "items"])

    small_batches(docs.sparkSession)
    return docs.select(text).mapInArrow(tidy(run), "_op1_text binary, hits array<int>, items array<string>")


def joined(docs: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """docs with n_words, and what all blocks found in their texts."""
    kept = [c for c in docs.columns if c not in ("n_words", "_hits", "_items")]

    def whole(batches):
        import pyarrow as pa

        for batch in batches:
            spans = [merged(zip(x[::2], x[1::2], strict=True)) for x in batch.column("hits").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_op1_text"), pa.array(spans, pa.list_(pa.int32())), batch.column("items")], ["_op1_text", "_hits", "_items"])

    def marked(batches):
        import pyarrow as pa

        for batch in batches:
            raws = list(raw_texts(batch, text))
            own = [pa.array([len(words(x)) for x in raws], pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for x in raws], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *own], [*kept, "n_words", "_op1_text"])

    every = found.distinct().groupBy("_op1_text").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # Written, so that Spark knows its size, and can split the rows of a text that is repeated a lot.
    every = Stored(docs.sparkSession)(every.mapInArrow(whole, "_op1_text binary, _hits array<int>, _items array<string>"))
    rows = docs.select(*kept).mapInArrow(tidy(marked), T.StructType([*docs.select(*kept).schema, *T._parse_datatype_string("n_words long, _op1_text binary")]))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return rows.join(every, "_op1_text", "left").select(*kept, "n_words", none("_hits", "int"), none("_items", "string"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs with n_words, hits (spans of hit words), items (ids, sorted) and contaminated."""
    spark = docs.sparkSession
    pairs = cut(windows_of(benchmark, item_text, item_id, window))
    blocks = max(1, -(-pairs.count() // block))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64("window", "item_id"), F.lit(blocks)))
    mine = docs.select(*[c for c in docs.columns if c not in ("n_words", "hits", "items", "contaminated")])
    parts = []
    for b in range(blocks):
        by: dict[bytes, list[str]] = {}
        for r in pairs.where(F.col("block") == b).collect():
            by.setdefault(bytes(r.window), []).extend([r.item_id] if r.item_id is not None else [])
        found = Block(list(by), list(by.values()))
        found.rank(token_counts(mine, send(spark, found), text) if by else {})
        parts.append(cut(scan_texts(mine, send(spark, found), text)) if blocks > 1 else scan(mine, send(spark, found), text))
    out = joined(mine, reduce(DataFrame.union, parts), text) if blocks > 1 else parts[0]
    spans = F.transform(F.sequence(F.lit(0), F.size("_hits") - 2, F.lit(2)), lambda i: F.struct(F.element_at("_hits", i + 1).alias("first"), F.element_at("_hits", i + 2).alias("end")))
    out = out.withColumn("hits", F.when(F.size("_hits") > 0, spans).otherwise(F.array().cast("array<struct<first:int,end:int>>")))
    hit = n_hit()
    return out.select(*mine.columns, "n_words", "hits", F.col("_items").alias("items"), ((hit > 0) & (hit >= SHARE * F.col("n_words"))).alias("contaminated"))


def n_hit():
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["first"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item FROM grams JOIN windows USING (n, s)),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated FROM d LEFT JOIN covered c USING (r) LEFT JOIN items i USING (r)
"""
