"""Language identification by error-correcting output codes (operator 12).

Each language has a codeword of bits; for each bit a binary classifier tells from a text's n-grams on which side of a
split of the languages it stands. A text's language is the one whose codeword is nearest to all the answers, so a few
wrong bits are borne with.

* Codes: with up to ``EXHAUSTIVE`` languages every split of them is a bit (any two codewords differ in half of them);
  with more, random halves, of which the set with the largest least distance is taken.
* N-grams: runs of letters, lower case, with one blank between runs and at the ends; every 1, 2 and 3 neighbouring
  places, hashed to ``HASH_BITS`` bits and counted over the whole text, in slices of ``SLICE`` characters.
* Classifiers: a bit's answer is the mean logarithm of (how frequent its n-grams are on one side over how frequent on
  the other), each language of a side weighing the same; times the root of the number of n-grams; scaled to a
  log-odds by logistic regression on rows that the frequencies have not seen.
* Decoding: a language's loss is the sum of the logistic losses of its bits, each weighed by how often that bit is right
  for that language on the same rows. The least loss wins (of equal ones the language first in order). The
  score is the share of exp(-loss) that it has; a text is ``ambiguous`` if that is below ``SURE`` or if the bits, rounded, are
  nearer to another codeword or beyond half of the least distance.

Learning takes at most ``ROWS`` ids of each language (a parameter), by a hash of the id; Spark chooses them by a share
of each language's count and then by rank, sums their n-grams by language, and the driver holds one vector a language
and the answers of a fifth of these rows. Classifying runs over every text, in one pass without a shuffle.

Rows whose crc32(doc_id as text) mod 5 is 0 are held out. Language, source and id are never inputs of a prediction.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 (letters as Unicode has them); so is every
text if nothing could be learned; rows without a language or without letters teach nothing; with one language every
text with a letter is of it. A null id is not held out. Rows that repeat an id teach once a language, by their least
text, and are classified each by its own. A text of any length is read whole. An empty table gives no rows. Other columns are kept by ``identified`` whatever
their names.
"""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

ROWS, HASH_BITS, SLICE, EXHAUSTIVE, SEED = 4000, 15, 1 << 18, 6, 5
#: Bits for each doubling of the number of languages, in random codes, and how many of these are drawn.
PER_DOUBLING, DRAWS = 12, 50
#: Added to each n-gram's share, and the score below which a text is ambiguous.
SMOOTH, SURE = 0.5, 0.8
UNKNOWN = "und"
GRAMS = 1 << HASH_BITS


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - HASH_BITS)


def places_of(codes: np.ndarray) -> np.ndarray:
    """Hashed n-grams of characters of which blanks are zeros and stand alone."""
    c = codes.astype(np.uint64)
    out = [c[c > 0]]
    if len(c) > 1:
        out.append(c[:-1] << np.uint64(21) | c[1:])
    if len(c) > 2:
        out.append(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])
    return np.concatenate([_mixed(x + np.uint64(n)) for n, x in enumerate(out)]).astype(np.int64)


def grams(text: str | None) -> np.ndarray | None:
    """How often each hashed n-gram stands in a text; None for a text without a letter."""
    counts, before, size = None, np.zeros(1, np.uint32), len(text or "")
    for lo in range(0, size, SLICE):
        codes = np.frombuffer(text[lo : lo + SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(0))
        if lo + SLICE >= size:
            codes = np.append(codes, np.uint32(0))
        both = np.append(before, codes)
        # Of several blanks one stays; two places go over to the next slice.
        both = both[np.append(True, (both[1:] > 0) | (both[:-1] > 0))]
        if counts is None and both.any():
            counts = np.zeros(GRAMS, np.int64)
        if counts is not None:
            # A 1-gram or 2-gram of the places that came before was counted with them.
            counts += np.bincount(places_of(both), minlength=GRAMS)
            if lo:
                counts -= np.bincount(places_of(before), minlength=GRAMS)
        before = both[-2:]
    return counts


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= EXHAUSTIVE:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    rng, best, bits = np.random.default_rng(SEED), None, int(np.ceil(PER_DOUBLING * np.log2(n)))
    for _ in range(DRAWS):
        code = np.where(np.argsort(rng.random((n, bits)), axis=0) < n // 2, 1, -1).astype(np.int8)
        if best is None or least_distance(code) > least_distance(best):
            best = code
    return best


def least_distance(code: np.ndarray) -> int:
    """The least number of bits in which two codewords differ."""
    apart = (code.shape[1] - code.astype(np.int32) @ code.T.astype(np.int32)) // 2
    return int(apart[~np.eye(len(code), dtype=bool)].min())


class Model:
    """Languages, their codewords, the bits' weights for each n-gram, scales, and the trust in each bit."""

    def __init__(self, languages: list[str], sums: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (sums + SMOOTH) / (sums + SMOOTH).sum(1, keepdims=True)
        sides = [[np.log(share[self.code[:, b] == s].mean(0)) for s in (1, -1)] for b in range(self.code.shape[1])]
        self.weights = np.stack([p - q for p, q in sides], 1).astype(np.float32) if sides else np.zeros((GRAMS, 0), np.float32)
        self.scale, self.shift = np.ones(self.code.shape[1]), np.zeros(self.code.shape[1])
        self.trust = np.ones(self.code.shape)
        self.radius = (least_distance(self.code) - 1) // 2 if len(languages) > 1 else 0

    def answers(self, counts: np.ndarray) -> np.ndarray:
        used = np.flatnonzero(counts)
        n = counts[used]
        return n @ self.weights[used].astype(np.float64) / np.sqrt(n.sum())

    def calibrate(self, answers: np.ndarray, language: np.ndarray) -> None:
        """Scales and trusts from answers to rows whose languages are known."""
        for b in range(self.code.shape[1]):
            side = self.code[language, b]
            if len(set(side.tolist())) == 2:
                self.scale[b], self.shift[b] = logistic(answers[:, b], side > 0)
        right = np.where((answers * self.scale + self.shift > 0) == (self.code[language] > 0), 1.0, 0.0)
        for k in range(len(self.languages)):
            own = right[language == k]
            self.trust[k] = (own.sum(0) + 1) / (len(own) + 2)
        # Each language's trusts have the mean 1, so no codeword is favoured.
        if self.code.shape[1]:
            self.trust /= self.trust.mean(1, keepdims=True)

    def decided(self, answers: np.ndarray) -> tuple[str, float, bool]:
        bits = answers * self.scale + self.shift
        loss = (self.trust * np.logaddexp(0, -self.code * bits)).sum(1)
        k = int(np.argmin(loss))
        score = float(1 / np.exp(loss[k] - loss).sum())
        apart = (np.where(bits > 0, 1, -1) != self.code).sum(1)
        return self.languages[k], score, score < SURE or bool(apart[k] > min(self.radius, apart.min()))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25) -> tuple[float, float]:
    """Scale and shift of log-odds, by Newton steps on the loss with a little weight on a small scale."""
    unit = max(float(np.abs(x).max()), 1e-9)
    z, w = np.stack([x / unit, np.ones(len(x))], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2), z.T @ (y - p) - 0.01 * w)
        w = w + step * min(1.0, 5 / max(float(np.abs(step).max()), 1e-12))
    return max(float(w[0]), 1e-6) / unit, float(w[1])


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sampled(docs: DataFrame, rows: int) -> DataFrame:
    """``lang, text, tried``: of each language at most ``rows`` ids; a fifth of them are for trial."""
    known = docs.where("lang is not null").where(~held_out("doc_id")).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # A share that leaves about 1.5 x ``rows`` ids of each language, so that ranking sees no more than those.
    counts = known.select("lang", "doc_id").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("c"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    # A row for each language, of which the driver holds a whole vector later: so rows need not be dealt by language.
    low = known.withColumn("place", place).join(F.broadcast(counts), "lang").where(F.col("place") * F.col("c").cast("double") < F.lit(1.5 * rows * (1 << 40)))
    once = low.groupBy("lang", "place", "doc_id").agg(F.min("text").alias("text"))
    first = once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))).where(F.col("rank") <= rows)
    return first.select("lang", "text", (F.col("rank") % 5 == 0).alias("tried"))


def train(docs: DataFrame, rows: int = ROWS) -> Model | None:
    """A model fitted on documents (doc_id, text, lang) that are not held out; None if there are none to learn from."""
    spark, sample = docs.sparkSession, scratch.written(_sampled(docs, rows), "op12-sample")

    def summed(frames):
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                found = grams(text)
                if found is not None:
                    sums[lang] = sums.get(lang, 0) + found
        yield pd.DataFrame({"lang": list(sums), "sums": [s.astype(np.int64).tobytes() for s in sums.values()]}, dtype=object)

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, np.int64) for s in frame["sums"])
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "sums": [total.tobytes()]})

    total = lambda of: of.mapInPandas(summed, "lang string, sums binary").groupBy("lang").applyInPandas(added, "lang string, sums binary")
    got = sorted((r["lang"], r["sums"]) for r in total(sample.where("not tried")).collect())  # one vector a language
    if not got:
        return None
    model = Model([lang for lang, _ in got], np.stack([np.frombuffer(s, np.int64) for _, s in got]).astype(np.float64))
    if len(got) > 1:
        shared = spark.sparkContext.broadcast(model)

        @F.pandas_udf("array<double>")
        def answers(text: pd.Series) -> pd.Series:
            found = (grams(t) for t in text)
            return pd.Series([None if c is None else shared.value.answers(c) for c in found], dtype=object)

        tried = sample.where("tried").select("lang", answers("text").alias("a")).where("a is not null").collect()  # a fifth of the sample, a number a bit
        tried = [r for r in tried if r["lang"] in model.languages]
        if tried:
            model.calibrate(np.array([r["a"] for r in tried]), np.array([model.languages.index(r["lang"]) for r in tried]))
    scratch.dropped(sample)
    return model


def identified(docs: DataFrame, model: Model | None, name: str = "__ls_language") -> DataFrame:
    """``docs`` with ``name``: lang, score, ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def run(text: pd.Series) -> pd.DataFrame:
        m, rows = shared.value, []
        for t in text:
            found = grams(t) if m is not None else None
            rows.append((UNKNOWN, 0.0, True) if found is None else m.decided(m.answers(found)))
        lang, score, ambiguous = zip(*rows) if rows else ((), (), ())
        return pd.DataFrame({"lang": pd.Series(lang, dtype=object), "score": pd.Series(score, dtype=float), "ambiguous": pd.Series(ambiguous, dtype=bool)})

    return docs.withColumn(name, run(F.col("text").cast("string")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identified(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), *[F.col(f"__ls_language.{c}").alias(n) for c, n in (("lang", "lang_pred"), ("score", "score"), ("ambiguous", "ambiguous"))])
