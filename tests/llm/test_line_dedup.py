
import duckdb
import pytest

from fieldlab.llm import op7_line_dedup as op

from .common_cases import docs, odd

BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(texts, least):
    key = lambda x: lower(x.strip(BLANKS))
    held = {}
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        stay = [x for x in lines if not key(x) or len(held[key(x)]) < least]
        out[i] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


TEXTS = ["Header\nbody 1\n\nFooter", "header \r\nbody 2\nfooter", "\tHEADER\nÉ\né", "only", "Header\nHeader\nHeader", None, "", "\n\n", "É\nbody 1", "body 1 ", "footer"]


@pytest.mark.parametrize("least", [2, 3, 4])
@pytest.mark.parametrize("parts, most", [(1, 10), (5, 10), (5, 0)])
def test_equals_brute_force(spark, least, parts, most):
    df = docs(spark, TEXTS, n_lines="mine")
    batches = [df.where(f"doc_id % {parts} = {i}") for i in range(parts)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in op.dedup_lines(df, batches, least, most=most).collect()}
    assert got == brute(TEXTS, least)


def test_runs_are_compacted_and_dropped(spark):
    runs = op.LineRuns(spark, 2, 3)
    for i in range(7):
        runs.add(docs(spark, [f"a\nline {i}", "b"]))
    assert [len(x) for x in runs.levels] == [1, 2]
    assert runs.frequent().count() == 2
    runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_odd_rows(spark):
    got = op.dedup_lines(odd(spark), min_docs=2).collect()
    assert len(got) == 8 and [r.text for r in got if r.doc_id == 5] == ["", ""] and [r.n_lines for r in got if r.doc_id in (1, 2)] == [1, 1]
    assert op.dedup_lines(docs(spark, ["a"]).limit(0)).count() == 0


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = op.query(spark, folder)
    assert sorted(map(tuple, got.collect())) == sorted(duckdb.sql(op.ORACLE).select(*[duckdb.ColumnExpression(c) for c in got.columns]).fetchall())
