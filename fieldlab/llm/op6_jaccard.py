"""Exact Jaccard self-join of n-gram sets with a token-group matrix.

Equal sets are one class, found by a hash of the sorted set, and only classes take part.

Candidates, without loss: two sets of sizes n and m that reach the threshold differ in at most
(n + m)(1 - t) / (1 + t) tokens. Sets of a size class are cut by token hash into more buckets than that,
leaving room for empty ones (five more for small sets, taken in pairs), so two similar sets have SURE equal
buckets that aren't empty, and their hashes are signatures that both emit. A set near the upper end of its size
class also emits those of the next. Of the signatures that more than HOT classes emit, such as a bucket that
holds a word of a passage found in many documents, each class leaves out its SURE - 1 hottest: of the SURE that
two similar sets share, the coldest stays in both.

Groups: the pivot of a signature is its most central class (whose signatures have the most classes), and
each class belongs to the pivot that it shares most signatures with. It is verified against that pivot;
verified links make the first groups of similar documents, so a group of near copies costs its size, not its
square. Where a signature still holds classes of different groups, those classes are cut into parts of similar
documents, of bounded size: a class joins the most popular of its KEYS smallest hashes.

Token-group matrix: every class carries the token groups that it has, as bits, about two for each of its
tokens. A token group that x has and y hasn't is a token of x outside y, so the bits bound the overlap of two
sets. Token sets are fetched only for pairs that the matrix doesn't rule out; then, for each pair of parts that
is left, the token union of one bounds the overlap of the other's members, and only for members that reach the
threshold by this bound the part is opened and its intersections counted. Rows of the plan are pairs of parts,
never pairs of documents. So every pair that shares a signature is linked, compared, ruled out by a bound, or
inside one component already: no link between components is lost.

Shingles, sets and classes are told apart by 64-bit hashes. Null or empty texts (or texts of white space)
have an empty set and are linked with nothing. Repeated rows are copies; rows that share a doc_id count as
one document. A null doc_id takes part but never names a component (the component_id of an unlinked one is
null). Extra columns aren't returned.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldlab.llm.common import Stored, cut, raw_texts, small_batches, table, tidy
from fieldlab.llm.components import components
from fieldlab.llm.text import spaced_words

SHINGLE = 3
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Classes of a part of a group, and its tokens, about.
PART, PART_TOKENS = 256, 200_000
#: Smallest hashes of a set that may name its family.
KEYS = 4
#: Signatures that similar sets share at least, and classes of a signature from which on it may be left out.
SURE, HOT = 8, 32
#: Rows of small intermediate results that a task reads, about.
ROWS = 20_000
#: Ratio of the bounds of a size class, at least.
RATIO = 1.25
#: Up to this upper bound, signatures are pairs of buckets, of so many more than may differ (10 pairs of five are equal).
PAIRED, PAIR_ROOM = 42, 5
#: Most bits of the filter that tells which documents' sets are fetched (16 MB); it has 16 for each document, if that is less.
FILTER = 1 << 27
#: Words whose hash a task remembers, and sets that it has seen.
WORDS, SEEN = 50_000, 100_000

A, B, C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def mixed(h):
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * C
        h = (h ^ (h >> np.uint64(29))) * B
        return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    def __missing__(self, word):
        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def token_set(raw: bytes, shingle: int, hashes: WordHashes) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    w = spaced_words(raw)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    size = min(shingle, len(w))
    if not size:
        return h
    n = len(w) - size + 1
    with np.errstate(over="ignore"):
        t = h[:n].copy()
        for j in range(1, size):
            t = (t ^ (t >> np.uint64(31))) * A + h[j : j + n]
        return np.unique(mixed(t + np.uint64(size)))


def class_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


class Buckets:
    """Size classes and the signatures of a set."""

    def __init__(self, percent: int):
        self.counts: dict[int, int] = {}
        self.percent, self.ratio = percent, max(RATIO, (100 / percent) ** 2)
        bound = 1
        while self.differ(2 * (bound + 1) - 1) == 0:
            bound += 1
        self.upper = [bound]  # sets up to it are linked only if equal

    def differ(self, total: int) -> int:
        """The most tokens in which two sets of `total` tokens together may differ."""
        return total * (100 - self.percent) // (100 + self.percent)

    def schemes(self, n: int):
        while self.upper[-1] < n * 2 + 2:
            u = self.upper[-1]
            self.upper.append(max(u + 1, int(u * self.ratio), u * 100 // self.percent))  # no set links beyond the next class
        c = int(np.searchsorted(self.upper, n))
        if c > 0:
            yield c
        if 100 * n >= self.percent * (self.upper[c] + 1):
            yield c + 1

    def count(self, c: int) -> int:
        """Buckets of a size class: so many that those that aren't empty outnumber the tokens that may differ, by SURE."""
        if c not in self.counts:
            d, least = self.differ(2 * self.upper[c]) + SURE - 1, self.percent * (self.upper[c - 1] + 1) / 100
            k = np.arange(d + 1, 2 * d + 12)
            empty = np.exp(-least / k)
            full = k * (1 - empty) - 3.5 * np.sqrt(k * empty * (1 - empty))
            self.counts[c] = int(k[np.argmax(full >= d + 1)] if (full >= d + 1).any() else k[np.argmax(full)])
        return self.counts[c]

    def signatures(self, t: np.ndarray) -> np.ndarray:
        out = [np.empty(0, np.uint64)]
        for c in self.schemes(len(t)):
            d, paired = self.differ(2 * self.upper[c]), self.upper[c] <= PAIRED
            k = d + PAIR_ROOM if paired else self.count(c)
            sums, full = bucket_sums(t, k)
            names = mixed(np.arange(k, dtype=np.uint64) + np.uint64(c << 32))
            with np.errstate(over="ignore"):
                if paired:
                    i, j = np.triu_indices(k, 1)
                    out.append(mixed(sums[i] + sums[j] + mixed(names[i] * A + names[j])))
                else:
                    out.append(mixed(sums + names)[full])
                    if full.sum() < d + SURE:  # empty buckets may be all that is equal: each with the buckets of another cut
                        again, _ = bucket_sums(np.sort(mixed(t)), k)
                        for e in np.flatnonzero(~full):
                            out.append(mixed(again + mixed(names * B + names[e])))
        return np.unique(np.concatenate(out))


def bucket_sums(t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each bucket's tokens and whether it has any; t is sorted."""
    bucket = ((t >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    edges = np.searchsorted(bucket, np.arange(k + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(t ^ A), dtype=np.uint64)])
        return total[edges[1:]] - total[edges[:-1]], edges[1:] > edges[:-1]


def token_bits(t: np.ndarray) -> np.ndarray:
    """A bit for each group of tokens that the set has: a power of two of groups, two for each token at least."""
    groups = max(64, 1 << (2 * len(t) - 1).bit_length())
    out = np.zeros(groups, np.uint8)
    out[(t >> np.uint64(20)) % np.uint64(groups)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bits (in rows) of fewer groups."""
    return np.bitwise_or.reduce(bits.reshape(*bits.shape[:-1], -1, words), axis=-2)


def set_rows(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, h, node, n, keys, bits) of every row; node names the class, keys are the KEYS smallest hashes of its set."""

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            sets = [token_set(raw, shingle, hashes) for raw in raw_texts(batch, "text")]
            own = {"node": pa.array([class_of(t) for t in sets], pa.int64()), "n": pa.array([len(t) for t in sets], pa.int64()), "keys": pa.array([t[:KEYS].view(np.int64).tolist() for t in sets], pa.list_(pa.int64())), "bits": pa.array([token_bits(t).tobytes() if len(t) else None for t in sets], pa.binary())}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), *own.values()], ["doc_id", "h", *own])

    return docs.withColumn("h", F.xxhash64("text")).mapInArrow(tidy(run), "doc_id long, h long, node long, n long, keys array<long>, bits binary")


def signature_rows(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(sig, node, n): a class once in each task that meets it."""

    def run(batches):
        import pyarrow as pa

        hashes, buckets, seen = WordHashes(), Buckets(percent), set()
        for batch in batches:
            sigs, nodes, sizes, lengths = [], [], [], []
            for raw in raw_texts(batch, "text"):
                t = token_set(raw, shingle, hashes)
                node = class_of(t)
                if len(t) and node not in seen:
                    seen.add(node)
                    sigs.append(buckets.signatures(t))
                    nodes.append(node)
                    sizes.append(len(t))
                    lengths.append(len(sigs[-1]))
            if len(seen) > SEEN:
                seen.clear()
            if sigs:
                sig = np.concatenate(sigs).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.repeat(np.array(nodes, np.int64), lengths)), pa.array(np.repeat(np.array(sizes, np.int64), lengths))], ["sig", "node", "n"])

    return docs.select("text").mapInArrow(tidy(run), "sig long, node long, n long")


def shared_signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(sig, node, n, times) of the signatures that several classes emit, with their number; a class may stand twice."""
    by = Window.partitionBy("sig")
    rows = signature_rows(docs, shingle, percent)
    rows = rows.withColumn("least", F.min("node").over(by)).withColumn("most", F.max("node").over(by)).withColumn("times", F.count("*").over(by))
    return rows.where("least <> most").select("sig", "node", "n", "times")


def without_hottest(shared: DataFrame) -> DataFrame:
    """Without the SURE - 1 hottest signatures of each class, as far as they have more than HOT classes."""
    place = F.dense_rank().over(Window.partitionBy("node").orderBy(F.desc("times"), "sig"))
    hot = shared.where(F.col("times") > HOT).withColumn("place", place).where(F.col("place") >= SURE).drop("place")
    return shared.where(F.col("times") <= HOT).union(hot)


class Sets:
    """Fetches the token sets of named classes from the documents."""

    def __init__(self, docs: DataFrame, classes: DataFrame, shingle: int):
        self.docs, self.classes, self.shingle = docs, classes, shingle

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, tokens): tokens are the sorted 64-bit hashes. A filter of bounded size goes to the scan first."""
        needed = cut(nodes.distinct().join(self.classes.select("node", F.col("least").alias("doc_id")), "node"), ROWS)
        size = min(FILTER, 1 << max(16, (16 * needed.count()).bit_length()))
        spot = F.pmod(F.xxhash64("doc_id"), F.lit(size))
        bits = needed.select((spot + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")).collect()
        whole = np.zeros(size // 8, np.uint8)
        for r in bits:
            own = np.frombuffer(bytes(r.bits), np.uint8)[: len(whole)]
            whole[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(own)] |= own
        sent, shingle = self.docs.sparkSession.sparkContext.broadcast(whole.tobytes()), self.shingle

        def run(batches):
            import pyarrow as pa

            hashes, marks, seen = WordHashes(), np.frombuffer(sent.value, np.uint8), set()
            for batch in batches:
                x = batch.column("x").to_numpy()
                batch = batch.filter(pa.array((marks[x >> 3] >> (x & 7) & 1).astype(bool)))
                ids, nodes, tokens = [], [], []
                for i, raw in zip(batch.column("doc_id").to_pylist(), raw_texts(batch, "text"), strict=True):
                    t = token_set(raw, shingle, hashes)
                    if (own := (i, class_of(t))) not in seen:  # a row that is repeated a lot would be sent as often
                        seen.add(own)
                        ids.append(i)
                        nodes.append(own[1])
                        tokens.append(t.tobytes())
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], ["doc_id", "node", "tokens"])

        found = self.docs.withColumn("x", spot).mapInArrow(tidy(run), "doc_id long, node long, tokens binary")
        found = found.join(needed, (found["node"] == needed["node"]) & found["doc_id"].eqNullSafe(needed["doc_id"])).select(found["node"], "tokens")
        return found.groupBy("node").agg(F.first("tokens").alias("tokens"))


def bounded_sizes(n, m, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def overlaps(pairs: DataFrame, keep, columns: str) -> DataFrame:
    """The rows of pairs whose token sets x and y pass keep(intersection, |x|, |y|)."""
    names = [c.split()[0] for c in columns.split(",")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yes = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(s) > len(t):
                    found = s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t
                else:
                    found = t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s
                yes.append(bool(keep(int(found.sum()), len(s), len(t))))
            yield batch.select(names).filter(pa.array(yes, pa.bool_()))

    return pairs.mapInArrow(tidy(run), columns)


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of classes those that the matrix doesn't rule out."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("n", "x", "m", "y")]
            yes = [bool(may_link(np.frombuffer(x, np.uint64)[None], np.array([n]), np.frombuffer(y, np.uint64)[None], np.array([m]), percent)[0, 0]) for n, x, m, y in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    mine = classes.select(F.col("node").alias("a"), "n", F.col("bits").alias("x"))
    other = classes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    return pairs.join(mine, "a").join(other, "b").where(bounded_sizes(F.col("n"), F.col("m"), percent)).mapInArrow(tidy(run), "a long, b long")


def verified(pairs: DataFrame, sets: Sets, percent: int, stored: Stored) -> DataFrame:
    """Of the distinct pairs (a, b) of classes those that are linked."""
    pairs = cut(possible(pairs, sets.classes, percent), ROWS)
    # Stored, so Spark can split the pairs of a pivot that has many.
    tokens = stored(sets.of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))))
    full = pairs.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("x")), "a").join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("y")), "b")
    return overlaps(full, lambda i, n, m: 100 * i >= percent * (n + m - i), "a long, b long").distinct()


def compared(a: dict, b: dict | None, percent: int) -> list[tuple[int, int]]:
    """Links between the members of two parts (or within one) that join different groups, a forest of them.

    A member of a is compared with b's members only if b's token union covers enough of it; then its
    intersections with all of them are counted at once, over the sorted tokens of b with their owners.
    """
    other = b or a
    sizes = np.array([len(t) for t in other["tokens"]])
    owner, tokens = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(other["tokens"])
    order = np.argsort(tokens, kind="stable")
    owner, tokens = owner[order], tokens[order]
    union, first = np.unique(tokens, return_index=True)
    ends = np.append(first[1:], len(tokens))
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for i, (node, group, t) in enumerate(zip(a["node"], a["grp"], a["tokens"], strict=True)):
        at = np.minimum(np.searchsorted(union, t), len(union) - 1)
        at = at[union[at] == t]
        if 100 * len(at) < percent * len(t):
            continue
        lengths = ends[at] - first[at]
        spots = np.repeat(first[at] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        both = np.bincount(owner[spots], minlength=len(sizes))
        for j in np.flatnonzero(100 * both >= percent * (len(t) + sizes - both)).tolist():
            x, y = find(group), find(other["grp"][j])
            if x != y and (b is not None or j != i):
                root[x] = y
                out.append((node, other["node"][j]))
    return out


def families(shared: DataFrame) -> DataFrame:
    """(node, family): the pivot that a class shares most signatures with.

    The pivot of a signature is its most central class: the one whose signatures have the most classes.
    """
    central = shared.groupBy("node").agg((F.sum("times") / F.max("n")).alias("central"))
    best = F.max(F.struct("central", "node", "n")).over(Window.partitionBy("sig"))
    rows = shared.join(central, "node").withColumn("p", best)
    times = rows.groupBy("node", "n", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n")).agg(F.count("*").alias("k"))
    mine = F.max_by(F.struct("pivot", "pivot_n"), F.struct((F.col("node") == F.col("pivot")).alias("own"), "k", "pivot"))
    return times.groupBy("node", "n").agg(mine.alias("p")).select("node", "n", F.col("p.pivot").alias("family"), F.col("p.pivot_n").alias("family_n"))


def links(docs: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between classes that give the components of all links."""
    sets = Sets(docs, classes, shingle)
    stored = Stored(docs.sparkSession)
    try:
        shared = stored(without_hottest(stored(shared_signatures(docs, shingle, percent))))
        family = families(shared)
        near = family.where((F.col("node") != F.col("family")) & bounded_sizes(F.col("n"), F.col("family_n"), percent))
        first = cut(verified(near.select(F.col("family").alias("a"), F.col("node").alias("b")), sets, percent, stored), ROWS)

        # What is left: signatures whose classes are in different groups.
        group = components(first).withColumnRenamed("component", "grp")
        placed = shared.select("sig", "node").join(group, "node", "left").withColumn("grp", F.coalesce("grp", "node"))
        left = placed.groupBy("sig").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo <> hi").select("sig")
        placed = stored(placed.join(left, "sig"))

        members = cut(placed.select("node", "grp").distinct().join(classes.select("node", "n", "keys"), "node"), ROWS)
        named = members.select("node", F.explode("keys").alias("key"))
        popular = cut(named.groupBy("key").agg(F.count("*").alias("k")), ROWS)
        home = named.join(popular, "key").groupBy("node").agg(F.max_by("key", F.struct("k", "key")).alias("family"))
        members = cut(members.drop("keys").join(home, "node"), ROWS)
        sizes = cut(members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("n") / PART_TOKENS)).alias("parts")), ROWS)
        members = cut(members.join(sizes, "family").select("node", "grp", F.xxhash64("family", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("part")), ROWS)
        weights = cut(members.groupBy("part").agg(F.count("*").alias("w")), ROWS)
        by_sig = placed.select("sig", "node").join(members.join(weights, "part"), "node").groupBy("sig", "part").agg(F.first("w").alias("w"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        other = by_sig.select("sig", F.col("part").alias("other"), F.col("w").alias("other_w"), F.col("lo").alias("other_lo"), F.col("hi").alias("other_hi"))
        # The smaller part comes first: the joins below send it to the larger one.
        mixed_ = (F.least("lo", "other_lo") < F.greatest("hi", "other_hi")) & (F.struct("w", "part") <= F.struct(F.col("other_w").alias("w"), F.col("other").alias("part")))
        pairs = cut(by_sig.join(other, "sig").where(mixed_).select("part", "other").distinct(), ROWS)

        candidates = cut(bounded(pairs, members, classes, percent, stored), ROWS)
        open_ = cut(candidates.select(F.explode("nodes").alias("node")).distinct(), ROWS)
        member = F.struct("node", "grp", "tokens")
        tokens = stored(members.join(open_, "node").join(sets.of(open_), "node").groupBy("part").agg(F.collect_list(member).alias("m")))
        both = candidates.select("part", "other").join(tokens, "part").join(tokens.select(F.col("part").alias("other"), F.col("m").alias("om")), "other")
        return first.union(cut(opened(both, percent), ROWS))
    finally:
        stored.remove()


def may_link(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows of bits x and y, of sets with n and m tokens, aren't ruled out."""
    words = min(x.shape[1], y.shape[1])
    x, y, n, m = folded(x, words), folded(y, words), n[:, None], m[None, :]
    outside = np.array([np.bitwise_count(row & ~y).sum(1, dtype=np.int64) for row in x])
    back = np.array([np.bitwise_count(~row & y).sum(1, dtype=np.int64) for row in x])
    most = np.minimum(n - outside, m - back)
    return 100 * most >= percent * (n + m - most)


def survivors(a: dict, b: dict, percent: int, same: bool) -> set[int]:
    """Members of two parts that the matrix leaves with a partner of another group."""
    out: set[int] = set()
    for x, n, grp, nodes in a["rows"]:
        for y, m, other_grp, other in b["rows"]:
            if 100 * n.max() < percent * m.min() or 100 * m.max() < percent * n.min():
                continue
            yes = may_link(x, n, y, m, percent) & (grp[:, None] != other_grp[None, :])
            out.update(nodes[yes.any(1)].tolist())
            if not same:
                out.update(other[yes.any(0)].tolist())
    return out


def bounded(pairs: DataFrame, members: DataFrame, classes: DataFrame, percent: int, stored: Stored) -> DataFrame:
    """(part, other, nodes): pairs of parts with the members that the matrix doesn't rule out."""

    def read(rows) -> dict:
        by: dict[int, list] = {}
        for r in rows:
            by.setdefault(len(r["bits"]), []).append(r)
        return {"rows": [(np.array([np.frombuffer(r["bits"], np.uint64) for r in own]), *(np.array([r[c] for r in own], np.int64) for c in ("n", "grp", "node"))) for own in by.values()]}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            nodes = []
            for i in range(batch.num_rows):
                same = batch.column("part")[i].as_py() == batch.column("other")[i].as_py()
                mine = read(batch.column("m")[i].as_py())
                nodes.append(sorted(survivors(mine, mine if same else read(batch.column("om")[i].as_py()), percent, same)))
            kept = pa.array([bool(x) for x in nodes], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("part"), batch.column("other"), pa.array(nodes, pa.list_(pa.int64()))], ["part", "other", "nodes"])
            yield out.filter(kept)

    bits = stored(members.join(classes.select("node", "n", "bits"), "node").groupBy("part").agg(F.collect_list(F.struct("node", "grp", "n", "bits")).alias("m")))
    both = pairs.join(bits, "part").join(bits.select(F.col("part").alias("other"), F.col("m").alias("om")), "other")
    return both.select("part", "other", "m", "om").mapInArrow(tidy(run), "part long, other long, nodes array<long>")


def opened(pairs: DataFrame, percent: int) -> DataFrame:
    """Links of the pairs of parts; a part has at most a bounded number of tokens."""

    def read(rows) -> dict:
        return {"node": [r["node"] for r in rows], "grp": [r["grp"] for r in rows], "tokens": [np.frombuffer(r["tokens"], np.uint64) for r in rows]}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                same = batch.column("part")[i].as_py() == batch.column("other")[i].as_py()
                out += compared(read(batch.column("m")[i].as_py()), None if same else read(batch.column("om")[i].as_py()), percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return pairs.select("part", "other", "m", "om").mapInArrow(tidy(run), "a long, b long").distinct()


def jaccard_rows(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(doc_id, h, node, n_shingles, component_id, first) of every row. h: a hash of its text; node: of its set.

    first: whether the row's (doc_id, h) is the one of its component that comes first.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = cut(set_rows(docs, shingle))
    some = rows.where("n > 0")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    classes = cut(some.groupBy("node").agg(F.min(one).alias("one"), F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    grouped = components(links(docs, classes, shingle, percent))
    placed = cut(classes.select("node", "one", "least").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node")))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.min("one").alias("one"))
    linked = cut(placed.drop("one", "least").join(named, "component").select("node", "component_id", "one"))
    is_first = F.col("doc_id").eqNullSafe(F.col("one.doc_id")) & (F.col("h") == F.col("one.h"))
    out = some.join(linked, "node").select("doc_id", "h", "node", F.col("n").alias("n_shingles"), "component_id", is_first.alias("first"))
    alone = rows.where("n = 0").select("doc_id", "h", "node", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return out.unionByName(alone)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    return jaccard_rows(docs, doc_id, text, shingle, percent).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (a null one comes last), once.

    Rows without words are in no component and stay. Of rows with the same doc_id but different texts, each is
    judged by its own text.
    """
    told = jaccard_rows(docs, doc_id, text, shingle, percent).where("n_shingles > 0").groupBy("doc_id", "h").agg(F.first("first").alias("first"), F.count("*").alias("times"))
    told = cut(told.where("NOT first OR times > 1").select(F.col("doc_id").alias("_own_id"), F.col("h").alias("_own_h"), F.col("first").alias("_own_first")))
    mine = docs.withColumn("_own_text", F.xxhash64(text))
    joined = mine.join(told, F.col(doc_id).cast("long").eqNullSafe(F.col("_own_id")) & (F.col("_own_text") == F.col("_own_h")), "left")
    kept = joined.where("_own_first IS NULL")
    if not told.where("_own_first").isEmpty():  # rows that are repeated
        kept = kept.union(joined.where("_own_first").dropDuplicates(["_own_id", "_own_h"]))
    return kept.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT r, array_to_string(w[i + 1 : i + least(3, len(w))], ' ') AS s FROM (SELECT r, w, unnest(range(0, len(w) - least(3, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
links AS (SELECT a.r AS a, b.r AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.r <> b.r JOIN sizes x ON x.r = a.r JOIN sizes y ON y.r = b.r GROUP BY a.r, b.r, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN sizes USING (r)
JOIN (SELECT reach.a AS r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.b GROUP BY 1) c USING (r)
"""
