import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from fieldlab.llm import op9_order_minhash as op

from .common_cases import docs, odd, saved


def sketches(spark, texts):
    df = op.with_sketch(docs(spark, texts), "text", "s")
    return {r.doc_id: r.s for r in df.select("doc_id", "s").collect()}


def like(a, b):
    return len(set(a) & set(b)) / len({x >> 32 for x in a} | {x >> 32 for x in b})


def test_likeness_falls_with_edits_and_reordering(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    few, many, turned = base.copy(), base.copy(), base[300:] + base[:300]
    for t, n in ((few, 10), (many, 150)):
        for _ in range(n):
            t[rng.randrange(600)] = f"x{rng.randrange(10**6)}"
    s = sketches(spark, [" ".join(t) for t in (base, few, many, turned, base, [f"z{i}" for i in range(600)])])
    near = [like(s[0], s[i]) for i in range(6)]
    assert near[0] == near[4] == 1 > near[1] > near[2] and near[3] < near[1] and near[5] < 0.05


def test_occurrences_count(spark):
    s = sketches(spark, ["a b " * 3, "a b " * 300, "a b " * 3, "a b", "a", "", None, " "])
    assert s[0] == s[2] != s[1] and len(s[1]) == op.SKETCHES and all(len(x) >= 1 for x in s.values()) and s[5] == s[6]


def plain_sketch(text):
    """The same sketch with loops, from the text on."""
    xx = lambda data, seed: xxhash.xxh64_intdigest(data, seed)
    units = []
    for u in re.split(r"\s+", text or "", flags=re.ASCII):
        units += [u[j : j + op.WINDOW] for j in range(len(u) - op.WINDOW + 1)] if len(u) > op.LONG_RUN else [u]
    seen, items = {}, []
    for at in range(max(1, len(units) - op.K + 1)):
        h = 42
        for u in units[at : at + op.K]:
            h = xx(u.encode(), h)
        h = (h >> 1) >> op.POSITION_BITS
        seen[h] = seen.get(h, 0) + 1
        if seen[h] > 1:  # a hash of its own: of the hash and the number of the occurrence
            h = xx((seen[h] - 1).to_bytes(4, "little"), xx(h.to_bytes(8, "little"), 42)) >> 1 >> op.POSITION_BITS
        items.append((h, at))
    out = []
    for number in sorted({h >> (op.SHIFT - op.POSITION_BITS) for h, _ in items}):
        least = sorted(x for x in items if x[0] >> (op.SHIFT - op.POSITION_BITS) == number)[: op.TUPLE]
        tuple_ = 42
        for h, _ in sorted(least, key=lambda x: x[1]):
            tuple_ = xx(h.to_bytes(8, "little"), tuple_)
        out.append(number << 32 | tuple_ & 0xFFFFFFFF)
    return out


def test_equals_a_plain_version(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(200)), " ".join(f"w{rng.randrange(300)}" for _ in range(900)), "one", "", None, " a  b\n", "x" * 32, "x" * 33, "".join(rng.choice("漢字かなカナ仮名交文") for _ in range(300)), "some words " + "".join(rng.choice("abcdef0123") for _ in range(200)) + " and more"]
    s = sketches(spark, texts)
    for i, t in enumerate(texts):
        assert s[i] == plain_sketch(t)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_likeness_follows_edit_distance(spark):
    """More edits, less likeness: for words, and for characters of a text without blanks."""
    rng = random.Random(8)
    for unit, joined in (([f"w{i}" for i in range(400)], " "), (list("漢字仮名交文言語学習機械翻訳大規模"), "")):
        base = [rng.choice(unit) for _ in range(300)]
        versions = []
        for n in (0, 1, 3, 10, 40, 150):
            t = base.copy()
            for _ in range(n):
                k = rng.randrange(len(t))
                rng.choice([lambda: t.insert(k, rng.choice(unit)), lambda: t.pop(k), lambda: t.__setitem__(k, rng.choice(unit))])()  # noqa: B023
            versions.append(t)
        s = sketches(spark, [joined.join(t) for t in versions])
        far, near = [edit_distance(base, t) for t in versions], [like(s[0], s[i]) for i in range(6)]
        assert far == sorted(far) and near == sorted(near, reverse=True) and near[0] == 1 and near[1] > 0.75 and near[5] < 0.25


def test_query_and_neighbours(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "RUN", 3)
    texts = ["", "a", "héllo wörld", "x y z " * 50, "x y z " * 50, "漢字かな", "last one here"] * 2
    rows = docs(spark, texts).withColumn("doc_id", F.col("doc_id") * 7 - 20)
    got = op.query(spark, saved(rows, tmp_path, "documents")).orderBy("doc_id").collect()
    assert len(got) == 14
    for i, r in enumerate(got):
        mine, following = texts[i], texts[(i + 1) % 14]
        edited = mine[: len(mine) - len(mine) // 2] + following[: len(mine) // 2]
        assert r.n_chars == len(mine) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= r.near_edited <= 1
        assert (r.near_next == 1) == (mine == following) and (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1)


def test_odd_rows(spark, tmp_path):
    got = op.query(spark, saved(odd(spark, fingerprint="mine"), tmp_path, "documents")).collect()
    assert len(got) == 8 and len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1
    assert op.query(spark, saved(docs(spark, ["one"]), tmp_path / "one", "documents")).first().near_next == 1
    assert op.query(spark, saved(docs(spark, ["a"]).limit(0), tmp_path / "none", "documents")).count() == 0


def test_plan_has_no_python(spark):
    df = op.query(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
