"""Packing by best-fit decreasing.

A document's ids (with the end id) are cut into full windows of LENGTH first; what remains, shorter than a
window, is packed. Remainders are dealt by a hash into groups of about GROUP rows; in each group they go,
longest first, into the open window with the tightest fit, found by a segment tree over remaining
capacities. Groups are independent, so any number of tasks packs any number of documents, and only the last
windows of a group stay part empty.

Tokenizing uses that white space separates ids, and so do signs after a letter or a digit: each part between them is
encoded once per batch and looked up afterwards; a worker keeps a bounded table of parts from one batch, and one task,
to the next.
Null or empty text is the end id alone. Repeated rows are packed as often as they occur; a null doc_id is kept. Extra columns aren't returned.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import cut, raw_texts, small_batches, table, tidy

LENGTH = 4096
END_ID = 2
#: Remainders of a group, about.
GROUP = 20_000
#: Entries of a worker's look-up table.
KNOWN = 600_000

#: A word of Latin letters, normal already but for the case.
WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Signs that have ids of their own after a letter or a digit.
SIGNS = ".,!?;:#$%&*|\"()-"
#: First bytes of the marks that may be composed with an ASCII letter; such texts aren't lower-cased before.
MARKS = (b"\xcc", b"\xcd")
#: ASCII letters and digits among bytes.
ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
WORD_END = "</w>"


class Encoder:
    """Ids of texts as little-endian bytes.

    Words of Latin letters, most of what is new in a batch, and signs go to the tokenizer's model joined by spaces:
    they are normal already and need no pattern, and as the last id of each says so, the ids are cut apart again.
    Everything else is encoded by the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.ascii, self.latin = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        spaces = pre_tokenizers.CharDelimiterSplit(" ")
        self.ascii.pre_tokenizer = spaces  # the model's own characters
        self.latin.pre_tokenizer = pre_tokenizers.Sequence([spaces, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def whole(self, parts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([x.decode() for x in parts], add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def apart(self, parts: list[bytes], plain) -> list[bytes]:
        """Of words and groups of signs."""
        text = b" ".join(parts).decode().lower()
        ids = np.array(plain.encode_batch_fast([text], add_special_tokens=False)[0].ids if parts else [], "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(parts):
            return self.whole(parts)
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def learn(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of parts that the table doesn't hold."""
        signs, plain, latin, other = SIGNS.encode(), [], [], []
        for x in parts:
            if x.isalpha() or not x.strip(signs):  # bytes: ASCII letters
                plain.append(x)
            else:
                (latin if WORD.fullmatch(x.decode()) else other).append(x)
        plain = [x for x in plain if x]
        ids = chain(self.apart(plain, self.ascii), self.apart(latin, self.latin), self.whole(other))
        return {b"": b""} | dict(zip([*plain, *latin, *other], ids, strict=True))

    def ids_of(self, parts: list[bytes]) -> list[bytes]:
        """Ids of a batch's distinct parts."""
        ids = list(map(self.known.get, parts))
        new = [x for x, own in zip(parts, ids, strict=True) if own is None]
        if not new:
            return ids
        found = self.learn(new)
        ids = [found[x] if own is None else own for x, own in zip(parts, ids, strict=True)]
        if len(self.known) + len(new) > KNOWN:
            self.known, found = {}, zip(parts, ids, strict=True)
        self.known.update(found)
        return ids

    def encode(self, raws: list[bytes]) -> list[bytes]:
        """Texts are cut at white space, and runs before the signs at their ends; each distinct part is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pa.array([raw if any(m in raw for m in MARKS) else raw.lower() for raw in raws], pa.binary()).view(pa.string())
        split = pc.ascii_split_whitespace(texts)
        runs = split.flatten()
        if not len(runs):
            return [b""] * len(raws)
        offsets, data = np.frombuffer(runs.buffers()[1], np.int32)[: len(runs) + 1], runs.buffers()[2] or pa.py_buffer(b"")
        size = pc.binary_length(pc.ascii_rtrim(runs, characters=SIGNS)).to_numpy()
        chars, end = np.frombuffer(b"\0\0" + data.to_pybytes(), np.uint8), offsets[:-1] + size
        last, before = chars[end + 1], chars[end]
        letter = ALNUM[last] | ((before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        cuts = np.empty(2 * len(runs) + 1, np.int32)
        cuts[::2], cuts[1::2] = offsets, np.where(letter | (size == 0), end, offsets[1:])
        coded = pa.BinaryArray.from_buffers(pa.binary(), 2 * len(runs), [None, pa.py_buffer(cuts), data]).dictionary_encode()
        one = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
        parts = pc.binary_join(one, b" ")[0].as_py().split(b" ")  # quicker than to_pylist
        joined = pa.array(self.ids_of(parts), pa.large_binary()).take(coded.indices)
        at = np.frombuffer(joined.buffers()[1], np.int64)[2 * split.offsets.to_numpy()].tolist()
        ids = memoryview(joined.buffers()[2] or b"")
        return [bytes(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


@functools.cache
def encoder(path: str) -> Encoder:
    """The worker's own: its table stays from one task to the next."""
    return Encoder(path)


def pieces_of(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Full windows and the remainder of each document, with the ids' checksum."""
    small_batches(docs.sparkSession)
    end = array("I", [end_id]).tobytes()

    def run(batches):
        import pyarrow as pa

        encode = encoder(tokenizer).encode
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            rows = []
            for i, raw in zip(batch.column(doc_id).to_pylist(), encode(raw_texts(batch, text)), strict=True):
                ids = raw + end
                n = len(ids) // 4
                for start in range(0, n, length):
                    own = ids[4 * start : 4 * (start + length)]
                    rows.append((i, start, len(own) // 4, zlib.crc32(own), n))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 5)], names)

    rows = docs.select(F.col(doc_id).cast("long").alias(doc_id), text)
    return rows.mapInArrow(tidy(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def best_fit(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each length, longest first into the tightest open window."""
    size = 1 << capacity.bit_length()
    tree = [0] * (2 * size)  # windows with each remaining capacity, and sums above
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    window, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    n = 0

    def change(c: int, by: int) -> None:
        c += size
        while c:
            tree[c] += by
            c >>= 1

    def tightest(c: int) -> int:
        """The least remaining capacity of at least c that a window has, or -1."""
        c += size
        if tree[c]:
            return c - size
        while c > 1 and (c & 1 or not tree[c + 1]):
            c >>= 1
        if c <= 1:
            return -1
        c += 1
        while c < size:
            c *= 2
            c += not tree[c]
        return c - size

    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = tightest(need)
        if room < 0:
            room, w, n = capacity, n, n + 1
        else:
            w = waiting[room].pop()
            change(room, -1)
        window[i], offset[i] = w, capacity - room
        if room > need:
            waiting[room - need].append(w)
            change(room - need, 1)
    return window, offset


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = cut(pieces_of(docs, tokenizer, doc_id, text, length, end_id).withColumn("_row", F.monotonically_increasing_id()))
    full, rest = pieces.where(F.col("length") == length), pieces.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", ignore_index=True)
        window, offset = best_fit(rows["length"].to_numpy(), length)
        return rows.assign(sequence_id=2 * (rows["_group"] * (1 << 32) + window), offset=offset)[list(names)]

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    dealt = rest.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    fitted = dealt.groupBy("_group").applyInPandas(packed, ", ".join(f"{n} long" for n in names))
    whole = full.select(*names[:5], (F.col("_row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return fitted.unionByName(whole)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
