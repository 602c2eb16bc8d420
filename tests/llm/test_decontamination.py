import hashlib
import random
import re

import duckdb
from pyspark.sql import functions as F

from fieldlab.llm import op1_decontamination as op

from fieldlab.llm.common import cut

from .common_cases import docs, odd, saved

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=13):
    found = {}
    for i, t in items:
        w = plain_words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            found.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = {}
    for i, t in enumerate(texts):
        w, hit, ids = plain_words(t), set(), set()
        for own, names in found.items():
            for k in range(len(w) - len(own) + 1):
                if tuple(w[k : k + len(own)]) == own:
                    hit.update(range(k, k + len(own)))
                    ids |= names
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: rng.choice("alpha beta gamma delta École naïve 7 x-y The the".split())
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((40, 13, 12, 3, 1, 20, 0))] + [(9, None), (10, "École"), (11, "beta " * 30)]
    texts = []
    for _ in range(60):
        t = [word() for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.5:
            item = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(t) + 1)
            t[at:at] = item[rng.randrange(3) :]
        texts.append(", ".join(t) if rng.random() < 0.2 else " ".join(t).upper() if rng.random() < 0.2 else " ".join(t))
    return texts, items


def rows(df):
    got = df.select("doc_id", "n_words", op.n_hit().alias("h"), F.size("items").alias("k"), F.sha2(F.array_join("items", ","), 256).alias("s"), "contaminated")
    return {r.doc_id: tuple(r)[1:] for r in got.collect()}


def test_equals_brute_force_for_any_number_of_blocks(spark):
    texts, items = corpus()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(texts, items)
    for block in (op.BLOCK, 7):
        assert rows(op.decontaminate(docs(spark, texts), benchmark, block=block)) == expected


def test_query_equals_brute_force(spark, tmp_path):
    texts, items = corpus()
    folder = saved(docs(spark, texts), tmp_path, "documents")
    saved(spark.createDataFrame(items, "item_id long, text string"), tmp_path, "benchmark")
    assert {r.doc_id: tuple(r)[1:] for r in op.query(spark, folder).collect()} == brute(texts, items)


def test_odd_rows_and_clashing_columns(spark):
    benchmark = spark.createDataFrame([(1, "same row twice"), (None, "no id here"), (2, None), (3, "")], "item_id long, text string")
    for block in (op.BLOCK, 1):
        got = op.decontaminate(odd(spark, hits="mine", n_words=7), benchmark, block=block).collect()
        assert len(got) == 8
        assert [r.items for r in got if r.doc_id == 5] == [["1"], ["1"]] and [r.contaminated for r in got if r.doc_id is None] == [True]
        assert [(r.n_words, r.contaminated) for r in got if r.doc_id in (1, 2, 3)] == [(0, False)] * 3


def test_blocks_write_what_they_found_only(spark, monkeypatch):
    """Copies of a text come once from each task, and no text is written; spans of several blocks are merged."""
    texts = ["clean words only"] * 50 + ["one two three four five six"] * 200
    benchmark = spark.createDataFrame([(i, " ".join("one two three four five six".split()[i : i + 3])) for i in range(4)], "item_id long, text string")
    cuts = []
    monkeypatch.setattr(op, "cut", lambda df: cuts.append(df.columns) or cut(df))
    out = op.decontaminate(docs(spark, texts).repartition(3), benchmark, block=1)
    got = sorted((r.doc_id, [tuple(h) for h in r.hits], r.items) for r in out.collect())
    assert got == [(i, [], []) for i in range(50)] + [(i, [(0, 6)], ["0", "1", "2", "3"]) for i in range(50, 250)]
    assert len(cuts) > 2 and all(c == ["_op1_text", "hits", "items"] for c in cuts[1:])
    block = op.Block([b"one two three"], [["0"]])
    block.rank({})
    found = op.scan_texts(docs(spark, texts).repartition(3), op.send(spark, block), "text")
    assert found.count() <= 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert op.decontaminate(docs(spark, ["a b"]), none).first().contaminated is False
    assert op.decontaminate(docs(spark, ["a"]).limit(0), none).count() == 0


def test_query_equals_its_sql(spark):
    folder, duck = "/root/testdata/sf0.001", duckdb.connect()
    for name in "documents benchmark".split():
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got = op.query(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(op.ORACLE).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall())
