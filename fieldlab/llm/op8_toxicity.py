"""Toxicity: a weighted lexicon matched by Aho-Corasick.

Folding first: compatibility forms and homoglyphs become plain letters, digits and signs between letters
become the letters that they stand for. The lexicon holds beginnings of words (and whole words) with
weights, the log-odds of toxic against clean documents, learned from labelled rows; exception phrases are
longer entries of weight 0, and as the longest match at a place counts, they silence what they hold. They are
learned too: an entry's word with the word before or after it, where such pairs stand in clean documents. The
weights of a text's matches are normalised by its length, and a logistic curve over weight, weight by
length and number of different entries gives the score.

Learning takes at most FIT_ROWS labelled documents (by the hash of their id), which is its only bound: every
term of them that has the least documents and log-odds becomes an entry. Scoring is narrow. Null or empty texts get the score of a text without matches. Labels
that are null are ignored; of several labels of a document the highest counts. Repeated rows are scored
alike. Columns named score are replaced; others pass through.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import add_columns, raw_texts, send, small_batches, table, tidy

#: Labelled documents that are learned from, at most.
FIT_ROWS = 20_000
#: Lengths of beginnings of words that may be entries; whole words of any length may be too.
SHORTEST, LONGEST = 3, 12
#: Toxic documents that an entry needs, and its least log-odds; an exception needs as many clean ones, and as low log-odds.
LEAST_DOCS, LEAST_WEIGHT = 4, 2.0
#: Distinct terms that a task counts before it passes them on.
TASK_TERMS = 60_000

# Harmless phrases that hold an insult.
EXCEPTIONS = ("clown fish", "clownfish", "clown school", "trash can", "trash bin", "trash talk show", "scum line", "pond scum", "sore loser rule", "worthless check", "idiot proof", "idiot-proof")
# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһкмтвгпαεορυικνтοɑɡıⅼ", "aeopcyxijsdhkmtbrnaeopuiknt" + "oagil")
# Digits and signs used for letters.
SUBSTITUTES = str.maketrans("013457@$!", "oieastasi")

BEYOND_LATIN = re.compile("[^\x00-ɏ]")
OTHER_DIGIT = re.compile("[2689]")
DIGIT_IN_WORD = re.compile(r"[0-9@$!]")
MIXED = re.compile(r"(?<![^\W_])(?=[0134578@$!]*[^\W\d_])(?=[^\W\d_]*[0134578@$!]+[^\W\d_]|[0134578@$]+[^\W\d_])[\w@$!]+")
WORD = re.compile(r"[^\W\d_]{%d,}" % SHORTEST)
WORD_END, WORD_AFTER = re.compile(r"[^\W\d_]*"), re.compile(r" [^\W\d_]+(?![^\W_])")


def fold(text: str) -> str:
    """Lower-cased, homoglyphs and substituted digits made letters."""
    if BEYOND_LATIN.search(text):
        text = unicodedata.normalize("NFKC", text).lower().translate(HOMOGLYPHS)
    else:
        text = text.lower()
    if DIGIT_IN_WORD.search(text):
        text = MIXED.sub(unmasked, text)
    return text


def unmasked(m: re.Match) -> str:
    """A word with digits or signs for letters; signs at its end are punctuation. Mixes of mostly digits, or with
    digits inside that stand for no letter, are codes."""
    word = m[0].rstrip("@$!")
    if OTHER_DIGIT.search(word.rstrip("0123456789")) or sum(c.isdigit() for c in word) * 3 > 2 * len(word):
        return m[0]
    return word.translate(SUBSTITUTES) + m[0][len(word) :]


def terms(text: str) -> set[str]:
    """Beginnings of a folded text's words, and the words themselves."""
    own = set(WORD.findall(fold(text)))
    return own | {w[:n] for w in own for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def term_counts(sample: DataFrame, text: str, label: str, start=lambda: terms) -> DataFrame:
    """(term, toxic, clean): documents of each label that hold a term. start() gives the function from a text to its terms."""
    small_batches(sample.sparkSession)

    def run(batches):
        import pyarrow as pa

        counts: dict[str, list[int]] = {}
        of = start()

        def pour():
            both = list(counts.values())
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([x[1] for x in both], pa.int64()), pa.array([x[0] for x in both], pa.int64())], ["term", "toxic", "clean"])
            counts.clear()
            return out

        for batch in batches:
            for raw, y in zip(raw_texts(batch, text), batch.column(label).to_pylist(), strict=True):
                for t in of(raw.decode()):
                    c = counts.get(t)
                    if c is None:
                        c = counts[t] = [0, 0]
                    c[1 if y else 0] += 1
                if len(counts) > TASK_TERMS:
                    yield pour()
        yield pour()

    return sample.select(text, label).mapInArrow(tidy(run), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


class Lexicon:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights = weights | {fold(x): 0.0 for x in exceptions}
        self.curve = (np.array([-2.0, 1.0, 0.0, 0.0, 0.0]), np.zeros(4), np.ones(4))
        self.automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "curve": self.curve, "automaton": None}

    def built(self):
        if self.automaton is None and self.weights:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for t, w in self.weights.items():
                self.automaton.add_word(t, (len(t), w, t))
            self.automaton.make_automaton()
        return self.automaton

    def matches(self, folded: str):
        """(end, length, weight, entry) of the longest entries that begin a word."""
        if self.weights:
            for end, (n, w, t) in self.built().iter_long(folded):
                if w and (end == n - 1 or not folded[end - n].isalnum()):
                    yield end, n, w, t

    def phrases(self, text: str) -> set[str]:
        """The words of a text's matches, each with the word before it and with the word after it."""
        text, out = fold(text), set()
        for end, n, _, _ in self.matches(text):
            start, here = end - n + 1, WORD_END.match(text, end + 1).end()
            first = start - 1
            if first > 0 and text[first] == " ":
                while first and text[first - 1].isalpha():
                    first -= 1
                if first < start - 1 and not (first and text[first - 1].isalnum()):
                    out.add(text[first:here])
            after = WORD_AFTER.match(text, here)
            if after:
                out.add(text[start:here] + after[0])
        return out

    def features(self, text: str) -> list[float]:
        """Total weight, weight by length, different entries and length, damped."""
        text, total, own = fold(text), 0.0, set()
        for _, _, w, t in self.matches(text):
            total += w
            own.add(t)
        n_words = text.count(" ") + text.count("\n") + 1
        return [float(np.log1p(total)), total / (n_words**0.5), float(np.log1p(len(own))), float(np.log(n_words))]

    def scores(self, features: np.ndarray) -> np.ndarray:
        b, mean, std = self.curve
        return 1 / (1 + np.exp(-np.clip(b[0] + (features - mean) / std @ b[1:], -30, 30)))


def log_odds(n_toxic: int, n_clean: int) -> Column:
    return F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n_clean + 1.0))


def entries(counts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weights of the entries: terms with the least documents and log-odds, but none that says the same as a longer one."""
    rows = counts.withColumn("w", log_odds(n_toxic, n_clean)).where((F.col("toxic") >= LEAST_DOCS) & (F.col("w") >= LEAST_WEIGHT)).collect()
    extended = {(r.term[: min(len(r.term) - 1, LONGEST)], r.toxic, r.clean) for r in rows}
    return {r.term: r.w for r in rows if (r.term, r.toxic, r.clean) not in extended}


def exceptions(counts: DataFrame, n_toxic: int, n_clean: int) -> tuple[str, ...]:
    """Phrases of clean documents."""
    rows = counts.where((F.col("clean") >= LEAST_DOCS) & (log_odds(n_toxic, n_clean) <= -LEAST_WEIGHT)).collect()
    return tuple(sorted(r.term for r in rows))


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's steps on standardised features."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / std])
    b, damp = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    damp[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + damp, z.T @ (y - p) - damp @ b)
        b = b + step
        if abs(step).max() < 1e-8:
            break
    return b, mean, std


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS, folds: int = 2) -> Lexicon:
    """The lexicon and its curve, from at most `rows` labelled documents.

    Weights come from one half of the documents and the curve from the other, so that the curve sees
    the lexicon as it does on new texts; then the weights are learned again from all.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("_y"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(1_000_000)) < int(950_000 * rows / n))
    known = known.orderBy(F.xxhash64(doc_id, F.lit(7)), doc_id).limit(rows)
    sample = docs.select(doc_id, text).join(F.broadcast(known), doc_id).select(text, F.col("_y").alias("_y"), F.pmod(F.xxhash64(doc_id, F.lit(11)), F.lit(folds)).alias("_fold")).persist()
    sizes = {(r._fold, r.y): r.n for r in sample.groupBy("_fold", (F.col("_y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}

    def lexicon(part: DataFrame, of: list[int]) -> Lexicon:
        n = [sum(sizes.get((f, y), 0) for f in of) for y in (1, 0)]
        plain = Lexicon(entries(term_counts(part, text, "_y"), *n))
        plainly = send(spark, plain)
        return Lexicon(plain.weights, (*EXCEPTIONS, *exceptions(term_counts(part, text, "_y", lambda: plainly().phrases), *n)))

    half = lexicon(sample.where("_fold = 0"), [0])
    sent = send(spark, half)
    rest = sample.where("_fold > 0")

    def start():
        mine = sent()
        return lambda raws: [[mine.features(x.decode()) for x in raws]]

    got = add_columns(rest, text, "_f array<double>", start).select("_y", "_f").collect()
    out = lexicon(sample, list(range(folds)))
    y = np.array([r._y > 0 for r in got], float)
    if 0 < y.sum() < len(y):
        out.curve = fitted(np.array([r._f for r in got]), y)
    sample.unpersist()
    return out


def score_toxicity(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """docs with score, 0 to 1."""
    sent = send(docs.sparkSession, lexicon)

    def start():
        mine = sent()
        return lambda raws: [mine.scores(np.array([mine.features(x.decode()) for x in raws]).reshape(-1, 4)).tolist()]

    return add_columns(docs, text, "score double", start)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def scored(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs scored by what the labels that aren't held out teach."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return score_toxicity(docs, learn(table(spark, sf_dir, "documents"), labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), sf_dir)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
