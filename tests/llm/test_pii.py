import re

from fieldlab.llm import op2_pii as op

from .common_cases import docs, odd

TEXT = "Write to Anna.B@Mail.example.com or call +1 (212) 555-0147. Card 4111 1111 1111 1111, host 10.20.30.40. SSN 123-45-6789; key 0123456789abcdef0123456789ABCDEF!"


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def test_format_type_and_validity(spark):
    r = op.surrogates(docs(spark, [TEXT])).first()
    assert r.n_entities == 6
    old = ["Anna.B", "555-0147", "4111 1111", "10.20.30.40", "123-45-6789", "0123456789abcdef"]
    assert not any(x in r.text for x in old)
    assert re.search(r"to [A-Z][a-z]{3}\.[A-Z]@[A-Z][a-z]{3}\.[a-z]{7}\.example or", r.text) and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.", r.text)
    card = re.search(r"Card (4\d{3} \d{4} \d{4} \d{4}),", r.text)[1]
    assert luhn(card) and re.search(r"SSN \d{3}-\d{2}-\d{4};", r.text) and re.search(r"key [0-9a-fA-F]{32}!", r.text)
    assert all(0 <= int(x) < 256 for x in re.search(r"host ([\d.]+)\. ", r.text)[1].split("."))


def test_coreference_gender_and_script(spark):
    texts = ["Mrs. Anna Smith met Mr. Smith.", "Frau Smith wrote; Herr Иванов answered.", "x@y.org", "X@Y.ORG and x@y.org", "Mrs. Anna Jones", "Mr. Anna Jones", "жук@почта.рф 张伟@例子.中国", "0049 30 12345678 is +49 30 12345678"]
    got = [r.text for r in op.surrogates(docs(spark, texts)).orderBy("doc_id").collect()]
    first, family = re.match(r"Mrs\. (\w+) (\w+) met Mr\. (?:\w+)\.", got[0]).groups()
    assert first.endswith(tuple(op.ENDINGS["f"])) and got[0].count(family) == 2 and f"Frau {family}" in got[1]
    assert f"Mrs. {first} " in got[4] and re.match(r"Mr\. \w+(us|on|ald|rik) ", got[5])
    assert re.search("Herr [А-ЯЁ][а-яё]{5} ", got[1])
    assert got[3] == f"{got[2].upper()} and {got[2]}"
    assert re.fullmatch(r"[а-яё]{3}@[а-яё]{5}\.испытание [一-龥]{2}@[一-龥]{2}\.测试", got[6]) and not {"张", "伟"} & set(got[6])
    a, b = got[7].split(" is +")
    assert a == f"00{b}"


def people(spark, n_given, n_family):
    return docs(spark, [f"Mr {g} {f} wrote." for g in ["Adam", "Bob", "Carl", "Dan", "Eric", "Fred", "Gus", "Hal", "Ian", "Jim", "Karl", "Leo", "Max", "Ned", "Otto", "Pat", "Ray", "Sam", "Tom", "Udo"][:n_given] for f in ["Smith", "Smyth", "Lee"][:n_family]])


def test_people_stay_different(spark):
    got = [r.text for r in op.surrogates(people(spark, 20, 3)).collect()]
    assert len(set(got)) == 60 and len({x.split()[2] for x in got}) == 3 and len({x.split()[1] for x in got}) == 20


def test_secrets_keep_case(spark):
    a, b = "ghp_aB3" + "x" * 33, "ghp_Ab3" + "x" * 33
    got = [r.text for r in op.surrogates(docs(spark, [a, b])).collect()]
    assert len(set(got)) == 2 and all(re.fullmatch("ghp_[A-Za-z0-9]{36}", x) for x in got) and got[0][5].isupper() and got[1][4].isupper()


def test_long_texts_cost_their_length(spark):
    import time

    texts = ["a" * 1_000_000 + "1", "a." * 500_000 + "1", "1" * 1_000_000, "0a" * 500_000, "@" * 1_000_000, "a@" * 300_000, "a@b" + ".c" * 300_000 + ".1", "Mr Aa" + "a" * 1_000_000]
    began = time.time()
    got = op.surrogates(docs(spark, texts)).collect()
    assert len(got) == len(texts) and time.time() - began < 60


def permutation(spark, texts, *key):
    from pyspark.sql import functions as F

    return [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.expr(op.permuted("t", *map(repr, key))).alias("p")).collect()]


def brute_permutation(text, *key):
    import hashlib

    size = lambda c: next((len(a) for a in op.ALPHABETS if c in a), 1)
    sizes, v = [size(c) for c in text], [next((a.index(c) for a in op.ALPHABETS if c in a), 0) for c in text]
    for r in range(op.ROUNDS):
        rest = ",".join(f"{x}/{n}" for i, (x, n) in enumerate(zip(v, sizes, strict=True)) if i % 2 != r % 2)
        h = hashlib.sha512("\x1f".join([op.KEY, *key, str(2 * r), rest]).encode()).hexdigest()
        v = [(x + int(h[i * 3 % 120 : i * 3 % 120 + 6], 16)) % n if i % 2 == r % 2 else x for i, (x, n) in enumerate(zip(v, sizes, strict=True))]
    return "".join(next((a[x] for a in op.ALPHABETS if c in a), c) for c, x in zip(text, v, strict=True))


def test_permutation_against_plain_version(spark):
    texts = ["7", "Smith", "Иванов", "a.b-c", "Ünïcödé x9", "1234567890" * 6]
    assert permutation(spark, texts, "k", "1") == [brute_permutation(t, "k", "1") for t in texts]
    every = [f"{a}{b}{c}" for a in "aeiou" for b in "0123456789" for c in "AEIOU"]
    got = permutation(spark, every, "k")
    assert sorted(got) == sorted(every) and got != every
    assert permutation(spark, every, "other") != got


def test_surrogates_are_distinct_and_nobodys(spark):
    """Many names in a small space: collisions have to be resolved, and lengthen what has no room."""
    rows = [("ssn", f"{i:03d}") for i in range(700)] + [("ssn", f"{i:02d}") for i in range(100)] + [("email", f"{c}@x.org") for c in "abcdefghijklmnopqrstuvwxyz"] + [("family", c) for c in "абвгдежзиклмнопрстуфхцчшщыэюя"] + [("phone", str(i)) for i in range(1, 10)] + [("card", f"4{i:02d}") for i in range(100)] + [("given-m", x) for x in ("Al", "Bo", "Cy")]
    got = op.dictionary(spark.createDataFrame(rows, "kind string, norm string")).collect()
    real = set(rows)
    assert len(got) == len(rows) == len({(r.kind, r.core) for r in got}) and not any((r.kind, r.core) in real for r in got)
    made = {r.norm: r.core for r in got if r.kind == "ssn"}
    cores = spark.createDataFrame(list(made.items()), "entity string, core string")
    from pyspark.sql import functions as F

    text = {r.entity: r.text for r in cores.select("entity", op.written(F.col("entity"), F.lit("ssn"), F.col("core"), F.lit(None).cast("string")).alias("text")).collect()}
    assert text == made
    emails = spark.createDataFrame([(f"user {i}@a.com",) for i in range(3)], "t string")
    assert op.surrogates(emails, "t").select("t").distinct().count() == 3


def test_same_entity_same_surrogate_everywhere(spark):
    got = [r.text for r in op.surrogates(docs(spark, ["a 8.8.4.4 b", "8.8.4.4", "c 8.8.4.4", "c 9.8.4.4"])).orderBy("doc_id").collect()]
    ip = got[1]
    assert got[0] == f"a {ip} b" and got[2] == f"c {ip}" and ip not in got[3]


def test_odd_rows(spark):
    got = op.surrogates(odd(spark, n_entities="mine")).collect()
    assert len(got) == 8 and all(r.n_entities == 0 for r in got)
    assert {r.doc_id: r.text for r in got if r.doc_id in (1, 2, 3)} == {1: None, 2: "", 3: " \n\t "}
    assert op.surrogates(docs(spark, ["a@b.com"]).limit(0)).count() == 0
    twice = op.surrogates(docs(spark, ["a@b.com"]).union(docs(spark, ["a@b.com"]))).collect()
    assert len(twice) == 2 and twice[0].text == twice[1].text
    assert op.surrogates(docs(spark, ["x﷐a@b.com"])).first().text.startswith("x�")


def test_query_leaves_nothing(spark):
    folder = "/root/testdata/sf0.001"
    before = {x for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect() for x in re.findall(r"[\w.]+@[\w.]+\w|\b\d{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}", r.text)}
    after = op.query(spark, folder).collect()
    assert before and len(after) == 200 and not any(x in r.text for r in after for x in before)


def test_local_and_european_phones(spark):
    phones = ["(555) 123-4567", "555-123-4567", "555 123 4567", "+49 30 12345678", "+49 (0)30 1234 5678", "+33 1 23 45 67 89", "0033 1 23 45 67 89", "+34 612 345 678", "+4930123456", "01 23 45 67 89", "030 12345678", "(030) 12345678", "030/1234567", "+1 (017) 555-7713"]
    rows = op.surrogates(docs(spark, [f"Call {p}, or write." for p in phones])).orderBy("doc_id").collect()
    for p, r in zip(phones, rows, strict=True):
        assert r.n_entities == 1 and p not in r.text
        assert re.sub("[0-9]", "0", r.text) == re.sub("[0-9]", "0", f"Call {p}, or write.")
    plain = ["on 01.02.2024 and 2024-11-05 at 12:30", "1 234 567 people, 12 345 678 others", "3.14159265, 5.0012345678 and +12.5", "1990-2020, 12-555-1234"]
    assert all(r.n_entities == 0 and r.text == plain[r.doc_id] for r in op.surrogates(docs(spark, plain)).collect())


def test_clashing_columns(spark):
    got = op.surrogates(docs(spark, ["a@b.com", "plain"], _h=1, _parts=2, _own=3, _map=4, entity=5, core=6)).collect()
    assert {(r._h, r._parts, r._own, r._map, r.entity, r.core) for r in got} == {(1, 2, 3, 4, 5, 6)} and sum(r.n_entities for r in got) == 1


def iban_valid(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_ibans(spark):
    texts = ["IBAN DE89370400440532013000 or DE89 3704 0044 0532 0130 00.", "GB82 WEST 1234 5698 7654 32", "wrong: DE00370400440532013000", "US20 THIS MUST STAY HERE"]
    got = [r.text for r in op.surrogates(docs(spark, texts)).orderBy("doc_id").collect()]
    a, b = re.fullmatch(r"IBAN (DE\d{20}) or (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d)\.", got[0]).groups()
    assert a == b.replace(" ", "") != "DE89370400440532013000" and iban_valid(a) and iban_valid("GB82 WEST 1234 5698 7654 32")
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", got[1]) and iban_valid(got[1]) and "WEST" not in got[1]
    assert re.fullmatch(r"wrong: DE\d{20}", got[2]) and got[2] != texts[2] and got[3] == texts[3]
    many = [f"DE89{i:018d}" for i in range(10_000_000, 10_000_300)]
    assert len({r.text for r in op.surrogates(docs(spark, many)).collect()} - set(many)) == 300


def test_what_only_looks_like_an_entity(spark):
    stay = ["In 2019 2020 2021 2022 it rained", "version 1.2.3.4 and v10.20.30.40", "commit " + "0a1b" * 10, "SHA-256: " + "0a1b" * 16]
    go = ["call 13812345678 now", "host 1.2.3.4", "key " + "0a1b" * 10, "2019 2020 2021 2022 2"]
    got = [r.text for r in op.surrogates(docs(spark, stay + go)).orderBy("doc_id").collect()]
    assert got[:4] == stay and re.fullmatch(r"call 1\d{10} now", got[4]) and not any(a == b for a, b in zip(got[4:7], go, strict=False))


def test_copies_of_a_text_can_be_split(spark):
    """The join that gives texts their surrogates back has a shuffle, not an aggregate, on both sides."""
    rows = op.surrogates(docs(spark, ["Mr Smith"] * 500 + ["Mrs Jones, a@b.org"] * 3))
    assert rows.groupBy("text").count().count() == 2
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan
