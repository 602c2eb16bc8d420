import random

import duckdb
import numpy as np
import pytest

from fieldlab.llm import op6_jaccard as op
from fieldlab.llm.components import components

from .common_cases import docs, odd, saved


def brute(texts, shingle, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, groups, copies, n_words, edits):
    """Groups of copies with a few words changed each: chains of links, and pairs just below the threshold."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [None, "", " \n ", "one", "One", "one two", "ONE two", "a b c", "A b C"]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice(n_words))]
        for _ in range(copies):
            t = base.copy()
            for _ in range(rng.randrange(edits)):
                t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed, groups, copies, n_words, edits, shingle, percent", [(1, 12, 6, (10, 30, 80, 300), 5, 3, 90), (2, 2, 60, (150,), 9, 3, 90), (3, 10, 6, (12, 40, 120), 4, 5, 80), (4, 8, 6, (8, 9, 10, 11, 12, 13), 2, 2, 70)])
def test_equals_brute_force(spark, monkeypatch, seed, groups, copies, n_words, edits, shingle, percent):
    monkeypatch.setattr(op, "PART", 8)
    monkeypatch.setattr(op, "HOT", 2)
    texts = corpus(seed, groups, copies, n_words, edits)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op.jaccard_components(docs(spark, texts), shingle=shingle, percent=percent).collect()}
    assert got == brute(texts, shingle, percent)


@pytest.mark.parametrize("percent", [70, 80, 90])
def test_similar_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    buckets = op.Buckets(percent)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            most = (100 - percent) * n // percent  # added only, or replaced
            out = rng.integers(0, most // 2 + 1)
            add = rng.integers(0, most + 1)
            t = np.unique(np.concatenate([s[out:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
            k = len(np.intersect1d(s, t))
            if 100 * k >= percent * (len(s) + len(t) - k) and not np.array_equal(s, t):
                assert len(np.intersect1d(buckets.signatures(s), buckets.signatures(t))) >= op.SURE


def test_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op.jaccard_components(odd(spark, component_id=4)).collect()), key=str)
    assert len(got) == 8 and (1, 0, 1) in got and got.count((5, 1, 5)) == 2 and (None, 1, None) in got
    assert op.jaccard_components(docs(spark, ["a"]).limit(0)).count() == 0
    assert op.jaccard_components(docs(spark, [None, "", " "])).count() == 3


def test_one_row_of_each_group_stays(spark):
    same, close, far = "a b c d e f g h i j k l", "a b c d e f g h i j k l m", "x y z u v w p q r s t o"
    rows = [(5, same, "u"), (5, same, "u"), (2, close, "v"), (5, far, "w"), (None, same, None), (None, far, "x"), (7, None, None), (7, None, None), (8, "", None), (9, "only once", "y"), (9, "only once", "z")]
    kept = op.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, h string"), shingle=3, percent=80)
    assert kept.columns == ["doc_id", "text", "h"]
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(2, close), (5, far), (7, None), (7, None), (8, ""), (9, "only once")], key=str)
    assert op.drop_near_duplicates(docs(spark, ["a"]).limit(0)).count() == 0


def test_matrix_rules_out_no_link(spark):
    rng = np.random.default_rng(2)
    for percent in (60, 80, 90):
        for n in (1, 5, 40, 63, 64, 65, 300, 3000):
            s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            for out in range(0, n // 2, max(1, n // 20)):
                t = np.unique(np.concatenate([s[out:], rng.integers(0, 1 << 63, rng.integers(0, n // 2 + 1), dtype=np.uint64)]))
                k = len(np.intersect1d(s, t))
                if 100 * k >= percent * (len(s) + len(t) - k):
                    assert op.may_link(op.token_bits(s)[None], np.array([len(s)]), op.token_bits(t)[None], np.array([len(t)]), percent).all()
            u = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            assert n < 40 or not op.may_link(op.token_bits(s)[None], np.array([len(s)]), op.token_bits(u)[None], np.array([len(u)]), percent).any()


def test_query(spark, tmp_path):
    texts = corpus(7, 4, 5, (40, 90), 4)
    got = {r.doc_id: tuple(r)[1:] for r in op.query(spark, saved(docs(spark, texts), tmp_path, "documents")).collect()}
    assert got == brute(texts, 3, 90)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 6)]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_its_sql(spark):
    folder, duck = "/root/testdata/sf0.001", duckdb.connect()
    for name in "documents".split():
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    got = op.query(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(op.ORACLE).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall())
