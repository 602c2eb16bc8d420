import re

from fieldlab.llm import op3_license as op

from .common_cases import docs, odd

TEXTS = ["Released under the MIT License.", "under the  mit\nlicense, under the MIT-License; Apache License, Version 2.0", "Licensed under CC BY-NC 4.0.", "mit license under the", "plain words", "This work is licensed under the GNU General Public License, version 3.", "the MIT license " * 400]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall((text or "").lower())
    at = [(k, label) for p, label in op.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    return len(w), sorted(k for k, _ in at), sorted({x for _, x in at})


def test_base_equals_brute_force(spark):
    for r in op.scan_licenses(docs(spark, TEXTS)).collect():
        assert (r.n_words, r.places, r.base_labels) == brute(r.text) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1


def test_method_adds_labels_with_key_phrases(spark):
    filler = ["nothing of the kind here"] * 40
    got = {r.doc_id: r for r in op.scan_licenses(docs(spark, TEXTS + filler)).collect()}
    assert got[5].labels == ["gpl-3"] and got[5].score > 0.9
    assert got[4].labels == [] and got[4].score < 0.5 and got[0].score == 1.0


def test_odd_rows(spark):
    got = op.scan_licenses(odd(spark, labels="mine", score=3)).collect()
    assert len(got) == 8 and all(r.labels == [] and r.places == [] for r in got)
    assert op.scan_licenses(docs(spark, ["a"]).limit(0)).count() == 0


def test_every_licence_of_a_long_text(spark):
    """The notice of 16 rare words must not keep the others from being looked up."""
    notices = [n for _, n, _ in op.NOTICES]
    texts = [f"{notices[1]}. Also licensed under the GNU General Public License, version 3.", " and ".join(notices)]
    filler = ["nothing of the kind here"] * 80 + ["gnu general public license version 3 mozilla"] * 2
    got = {r.doc_id: r for r in op.scan_licenses(docs(spark, texts + filler)).collect()}
    assert got[0].labels == ["gpl-3", "mit"] and got[0].score == 1.0
    assert got[1].labels == sorted({label for label, _, _ in op.NOTICES})


def test_matches_equal_brute_force(monkeypatch):
    """Every place where a notice holds its share, also where a file has more places than a block."""
    monkeypatch.setattr(op, "BLOCK", 3)
    index = op.Index()
    index.weigh({i: i % 5 for i in range(len(index.vocab))}, 1000)
    text = "the gnu general public license x version 3 " * 3 + "copyright all rights reserved licensed under cc by sa 4 0 mozilla public license 2 0 " * 2
    ids = index.numbers([w.encode() for w in text.split()])
    got = index.matches(ids)
    for t, (_, notice, _) in enumerate(index.notices):
        whole = index.idf[notice].sum()
        fits = {s: sum(index.idf[w] for k, w in enumerate(notice) if 0 <= s + k < len(ids) and ids[s + k] == w) / whole for s in range(-len(notice), len(ids))}
        want = {s: x for s, x in fits.items() if x >= op.SHARE - op.TINY}
        at, shares = got.get(t, ([], []))
        assert list(at) == sorted(want) and all(abs(x - want[s]) < 1e-9 for s, x in zip(at, shares, strict=True))


def test_frequent_notices_keep_their_labels(spark):
    """A table of one document, and one where a third of the rows carry the same notice."""
    gpl = "This work is licensed under the GNU General Public License, version 3."
    one = op.scan_licenses(docs(spark, [gpl])).first()
    assert one.labels == ["gpl-3"] and one.score > 0.999
    for notice, label in [(gpl, "gpl-3"), ("Copyright. All rights reserved.", "proprietary"), ("Licensed under CC BY-SA 4.0.", "cc-by-sa")]:
        got = op.scan_licenses(docs(spark, [notice, "nothing of the kind", "plain words"] * 20)).collect()
        assert all(r.labels == ([label] if r.doc_id % 3 == 0 else []) for r in got)


def brute_scan(index, text):
    """Labels and score by trying every notice at every place."""
    w = WORD.findall((text or "").lower())
    weight = lambda x: index.idf[index.vocab[x.encode()]]
    starts = lambda p: [k for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    labels = {label for p, label in op.BASE.items() if starts(p)}
    score, held = 1.0 if labels else 0.0, []
    for label, notice, keys in op.NOTICES:
        n, places, here, lacking = notice.split(), [starts(k) for k in keys], [], 0.0
        for s in range(-len(n), len(w)):
            share = sum(weight(x) for k, x in enumerate(n) if 0 <= s + k < len(w) and w[s + k] == x) / sum(map(weight, n))
            if share >= op.SHARE - op.TINY:
                if all(any(s - op.NEAR <= k and k + len(key.split()) <= s + len(n) + op.NEAR for k in ks) for key, ks in zip(keys, places, strict=True)):
                    here.append((label, s, s + len(n), share))
                lacking = max(lacking, share)
        held += here
        score = max(score, 0.0 if here else lacking / 2)
    for label, s, e, share in held:
        if not any(a <= s and e <= b and b - a > e - s for _, a, b, _ in held):
            labels.add(label)
            score = max(score, share)
    return sorted(labels), min(1.0, score)


def test_all_labels_equal_brute_force(spark):
    """Notices whole, cut, changed and mixed."""
    notices = [n for _, n, _ in op.NOTICES]
    long = [n for n in notices if len(n.split()) > 15]
    cut = [" ".join(n.split()[len(n.split()) // k :]) for n in long for k in (3, 5)]
    changed = [" ".join("other" if i % k == 2 else x for i, x in enumerate(n.split())) for n in long for k in (4, 9)]
    mixed = [f"{a} {b}" for a, b in zip(notices, notices[7:], strict=False)] + [f"words of {a} in {b[: len(b) // 2]}" for a, b in zip(notices[3::5], long, strict=False)]
    texts = ["", None, "plain words only", *notices, *cut, *changed, *mixed, "Intro. " + long[5].replace(" the ", " THE, ", 5) + " and more"]
    df = docs(spark, texts)
    index = op.Index()
    index.weigh(*op.word_frequencies(df, op.Index(), "text"))
    for r in op.scan_licenses(df).collect():
        labels, score = brute_scan(index, r.text)
        assert r.labels == labels and abs(r.score - score) < 1e-9


def test_labels_need_their_share_and_versions(spark):
    bsd = "Copyright (c) 2020, X. All rights reserved. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    cases = {
        "the word cc0 appears": "",
        "an MIT license yesterday, and all rights reserved": "",
        bsd: "bsd",
        "Copyright (c) 2020 X. All rights reserved.": "proprietary",
        "Copyright 2020. All rights reserved. None of the licences is meant here, and words of other kinds follow. " + bsd: "bsd,proprietary",
        "GPL-3.0-or-later": "gpl-3",
        "the GNU Lesser General Public License, version 2.1": "lgpl-2",
        "under the GNU General Public License v3": "gpl-3",
        "under the GNU Lesser General Public License v3": "lgpl-3",
        "GNU Library General Public License, version 2": "lgpl-2",
        "// SPDX-License-Identifier: MIT": "mit",
        "SPDX-License-Identifier: AGPL-3.0-only": "agpl-3",
        "CC BY-NC-SA 4.0": "cc-by-nc,cc-by-nc-sa",
    }
    got = op.scan_licenses(docs(spark, list(cases) + ["nothing of the kind here"] * 200)).where("doc_id < 13").collect()
    assert {r.text: ",".join(r.labels) for r in got} == cases
