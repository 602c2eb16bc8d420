"""Order MinHash fingerprints, in DataFrame functions only.

The units of a text are its runs without white space; of a run of more than LONG_RUN characters (a script
without blanks, a code, an address) the units are all its windows of WINDOW characters, so that a change
touches few of them there too. A k-mer is K units in a row. The o-th occurrence of a k-mer has a hash of its
own, so repeated k-mers count as often as they occur. The hash space is cut into SKETCHES ranges, which stand
for as many independent hashes; in each, the TUPLE occurrence-numbered k-mers of smallest hash are selected,
put back into their order in the text, and hashed as a tuple. Two texts agree in a sketch only if they select
the same k-mers in the same order, so likeness, the share of agreeing sketches among those that either text
has, falls with edit distance and not just with the set of k-mers.

A text of fewer than K units is one k-mer, also the empty text and null. Positions beyond 2^24 units count
as 2^24. Equal texts have equal fingerprints. Repeated rows are fingerprinted alike. The query returns no extra
columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldlab.llm.common import table

K = 2
TUPLE = 2
#: Longest run that is one unit, and the characters of a unit of longer ones.
LONG_RUN, WINDOW = 32, 8
#: A power of two.
SKETCHES = 64
#: Documents of a run of neighbours, about, and most runs.
RUN, RUNS = 2_000, 10_000

POSITION_BITS = 24
SHIFT = 63 - (SKETCHES.bit_length() - 1)


def packed(hash_sql: str, position_sql: str) -> str:
    """39 bits of a hash above 24 bits of a position, never negative."""
    return f"((shiftrightunsigned({hash_sql}, 1) & {-(1 << POSITION_BITS)}L) | {position_sql})"


def with_sketch(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with `to`, an array of (number of the sketch << 32 | hash of its tuple), ascending."""
    t, v, dup, starts, every, chosen = (f"_{to}_{x}" for x in ("units", "kmers", "dup", "starts", "every", "chosen"))
    low, same = (1 << POSITION_BITS) - 1, lambda a, b: f"shiftright({a}, {POSITION_BITS}) = shiftright({b}, {POSITION_BITS})"
    kmer = "xxhash64(" + ", ".join(f"get({t}, i + {j})" for j in range(K)) + ")"
    occurrence = packed(f"xxhash64(shiftright(get({dup}, i), {POSITION_BITS}), i - s + 1)", f"(get({dup}, i) & {low}L)")
    plain = f"split(coalesce(`{text}`, ''), '\\\\s+')"
    windows = "transform(sequence(0, size(c) - " + str(WINDOW) + "), j -> concat(" + ", ".join(f"get(c, j + {j})" for j in range(WINDOW)) + "))"
    cut = f"flatten(transform({plain}, u -> if(char_length(u) > {LONG_RUN}, transform(array(split(u, '')), c -> {windows})[0], array(u))))"
    steps = [
        (t, F.expr(f"if(`{text}` RLIKE '(?<!\\\\S)\\\\S{{{LONG_RUN + 1}}}', {cut}, {plain})")),
        (v, F.expr(f"sort_array(transform(sequence(0, greatest(size({t}) - {K}, 0)), i -> {packed(kmer, f'least(i, {low})')}))")),
        # Later occurrences of a k-mer stand behind the first one in hash order.
        (dup, F.expr(f"filter({v}, (x, i) -> i > 0 AND {same('x', f'get({v}, i - 1)')})")),
        (starts, F.expr(f"CASE WHEN size({dup}) > 0 THEN filter(sequence(0, size({dup}) - 1), i -> i = 0 OR NOT {same(f'get({dup}, i)', f'get({dup}, i - 1)')}) END")),
        (every, F.expr(f"CASE WHEN size({dup}) = 0 THEN {v} ELSE sort_array(concat(filter({v}, (x, i) -> i = 0 OR NOT {same('x', f'get({v}, i - 1)')}), flatten(transform({starts}, (s, r) -> transform(sequence(s, coalesce(get({starts}, r + 1), size({dup})) - 1), i -> {occurrence}))))) END")),
        (chosen, F.expr(f"filter({every}, (x, i) -> i < {TUPLE} OR shiftright(get({every}, i - {TUPLE}), {SHIFT}) <> shiftright(x, {SHIFT}))")),
        (to, F.expr(f"transform(filter(sequence(0, size({chosen}) - 1), i -> i = 0 OR shiftright(get({chosen}, i - 1), {SHIFT}) <> shiftright(get({chosen}, i), {SHIFT})), i -> {tuple_sql(chosen)})")),
    ]
    for name, column in steps:
        df = df.withColumn(name, column)
    return df.drop(t, v, dup, starts, every, chosen)


def tuple_sql(chosen: str) -> str:
    """Number and hash of the tuple that begins at place i: its k-mers in text order."""
    low = (1 << POSITION_BITS) - 1
    own = f"filter(slice({chosen}, i + 1, {TUPLE}), x -> shiftright(x, {SHIFT}) = shiftright(get({chosen}, i), {SHIFT}))"
    in_order = f"array_sort({own}, (a, b) -> CAST(sign((a & {low}L) - (b & {low}L)) AS INT))"
    return f"(shiftleft(shiftright(get({chosen}, i), {SHIFT}), 32) | (xxhash64(transform({in_order}, x -> shiftright(x, {POSITION_BITS}))) & 4294967295L))"


def likeness(a: str, b: str) -> Column:
    """Agreeing sketches by sketches that either has."""
    number = lambda x: F.shiftright(x, 32)
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(F.transform(a, number), F.transform(b, number)))


def fingerprint(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def in_runs(docs: DataFrame, doc_id: str) -> DataFrame:
    """docs with _run, _late and _key: runs of neighbours by doc_id, cut at its quantiles.

    The first row of a run also stands at the end of the run before (the first of all: of the last), with
    _late = 1, so that in a window over a run each row has its next row.
    """
    key = F.coalesce(F.col(doc_id), F.lit(-(1 << 63)))
    n = docs.count()
    runs = max(1, min(RUNS, n // RUN))
    at = [i / runs for i in range(runs)]
    cuts = sorted(set(docs.agg(F.percentile_approx(key, at, 10 * RUNS)).first()[0])) if n else [0]
    wide = int(len(cuts) ** 0.5) + 1
    literal = lambda x: "array(" + ", ".join(f"{v}L" if v > -(1 << 63) else f"({v + 1}L - 1L)" for v in x) + ")"
    rows = docs.withColumn("_key", key).withColumn("_c", F.expr(f"(size(filter({literal(cuts[::wide])}, x -> x <= _key)) - 1) * {wide}"))
    rows = rows.withColumn("_run", F.expr(f"_c + size(filter(slice({literal(cuts)}, _c + 1, {wide}), x -> x <= _key)) - 1"))
    own = F.struct(F.col("_run").alias("run"), F.lit(0).alias("late"))
    before = F.struct(F.pmod(F.col("_run") - 1, F.lit(len(cuts))).alias("run"), F.lit(1).alias("late"))
    first = F.expr(f"get({literal(cuts)}, _run)") == F.col("_key")
    rows = rows.withColumn("_place", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    return rows.withColumn("_run", F.col("_place.run")).withColumn("_late", F.col("_place.late")).drop("_c", "_place")


def next_in_run(column: str, *ties: str) -> Column:
    return F.lead(column).over(Window.partitionBy("_run").orderBy("_late", "_key", *ties))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = in_runs(docs, "doc_id").withColumn("next", next_in_run("text", "text"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.expr("CAST(n_chars DIV 2 AS INT)"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, CAST(n_chars AS INT) - half)"), F.expr("substring(coalesce(next, ''), 1, half)")))
    rows = rows.drop("next", "half").withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_sketch(with_sketch(rows, "text", "own"), "edited", "changed").drop("edited")
    rows = rows.withColumn("following", next_in_run("own", "text")).where("_late = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint("own").alias("fingerprint"), fingerprint("changed").alias("edited_fingerprint"), likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"))
