import zlib

import numpy as np
import pytest

from fieldlab.llm import op5_packing as op

from .common_cases import docs, odd


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op.tokenizer_path())


def check(rows, ids_of, length):
    by, windows = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
    for i, own in by.items():
        ids, at = ids_of[i], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    assert set(by) == set(ids_of)
    return windows


TEXTS = ["Hello, WORLD!", "it's a dog's life 2024", "", None, "naïve Ünïcode 漢字   wide　space", "word " * 500, "\x1c odd \x85 blanks", "a" * 300, "'s 'll <|endoftext|> #!?"]


@pytest.mark.parametrize("length, group", [(4096, 20000), (16, 3), (7, 1)])
def test_exact_round_trip(spark, tokenizer, length, group):
    expected = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(TEXTS)}
    check(op.pack(docs(spark, TEXTS, sequence_id="mine"), op.tokenizer_path(), length=length, group=group).collect(), expected, length)


def test_best_fit_takes_the_tightest_window():
    window, offset = op.best_fit(np.array([6, 5, 4, 4, 3, 1]), 10)
    assert window.tolist() == [0, 1, 0, 1, 2, 1] and offset.tolist() == [0, 0, 6, 5, 0, 9]
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 4096, 2000)
    window, offset = op.best_fit(lengths)
    used = np.bincount(window, lengths)
    assert used.max() <= 4096 and len(used) * 4096 < 1.05 * lengths.sum()
    brute, rooms = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(room, w) for w, room in enumerate(rooms) if room >= lengths[i]]
        if not fits:
            rooms.append(4096)
            fits = [(4096, len(rooms) - 1)]
        room, w = min(fits)
        rooms[w] -= lengths[i]
        brute.append(room - lengths[i])
    mine = 4096 - offset[np.argsort(-lengths, kind="stable")] - np.sort(lengths)[::-1]
    assert brute == mine.tolist()


def test_odd_rows(spark, tokenizer):
    rows = op.pack(odd(spark), op.tokenizer_path()).collect()
    assert sum(r.start == 0 for r in rows) == 8 and sum(r.doc_id is None for r in rows) == 1
    assert op.pack(docs(spark, ["a"]).limit(0), op.tokenizer_path()).count() == 0


def test_full_table_of_known_runs(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(op, "KNOWN", 2)
    e = op.Encoder(op.tokenizer_path())
    for _ in range(2):
        got = e.encode([b"one two three four", b"two five"])
        assert got == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in ("one two three four", "two five")]


def test_signs_are_encoded_apart(tokenizer):
    """A word is encoded once, whatever signs follow it; where signs may belong to what is before them, they stay with it."""
    e = op.Encoder(op.tokenizer_path())
    e.encode([b"wordy, wordy! (wordy) Wordy?!", b"wordy."])
    assert set(e.known) - {b""} == {b"wordy", b",", b"!", b")", b"(wordy", b"?!", b"."}
    bits = ["a", "Wordy", "É", "ÿ", "×", "÷", "ª", "ß", "'", "'s", "'LL", "7", "½", "漢", "Ⅷ", "e\u0301", "E\u0300", "\u0327", "I\u0307", "İ", "K", "_", "<", "<|endoftext|>", " ", "\n", "\t", "\x1c", "\x85", "\u3000", "\u200b", "\0", *op.SIGNS, "..", "--"]
    rng = np.random.default_rng(5)
    texts = ["", " ", "!", "\u0301.", " a ", *("".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(3000))]
    expected = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode([t.encode() for t in texts]) == expected and e.encode([b"", b" "]) == [b"", b""] and e.encode([]) == []
    assert op.encoder(op.tokenizer_path()) is op.encoder(op.tokenizer_path())
