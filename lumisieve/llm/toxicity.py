"""Toxicity by a factorization machine over hashed words (operator 8).

A document is the set of its words' hashes (whole text, lower case, letters only: presence, not frequency, so that a
few words in a long text weigh as in a short one). Its score is the logistic of ``w0 + sum w_i + sum_{i<j} <v_i, v_j>``,
with the pair term found in linear time as ``(|sum v_i|^2 - sum |v_i|^2) / 2``.

Fitting takes a bounded sample of labelled rows (``TRAIN_ROWS``, by a hash of the id, all labelled rows if fewer). A
machine over all of their words learns the sample's noise (measured on the check tables: 0.70 of the held-out toxic
documents found instead of 0.98), so features are chosen by two tests: words that separate the labels (``MIN_Z`` by the
two-proportion test, at least ``MIN_ROWS`` rows, the strongest ``MAX_TERMS``), and pairs whose interaction does
(``PAIR_Z`` standard errors of the contrast of the four shares), of the strongest and the most frequent words,
``PAIR_TERMS`` together. So words that say nothing alone, as an insult and a group's name of which only both are toxic,
are features too. All other words score nothing; the limits are parameters of ``train`` and can be lifted. Spark counts the terms; the driver holds the sample's features only.
Scoring runs over every document, in one pass without a shuffle.

Rows whose crc32(doc_id as text) mod 4 is 2 are held out. Labels, language, source and id are never inputs.

Defined cases: a null or empty text has no words and scores the base rate; null labels and labels without a document
teach nothing; a document labelled twice counts once with the larger label, and each of a repeated id's texts once.
Without any labelled row, or any document, all scores are ``0``. Other columns are kept by ``scored`` whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch

TRAIN_ROWS, MIN_ROWS, MIN_Z, MAX_TERMS, HASH_BITS = 30_000, 3, 4.0, 4_096, 22
#: Words whose pairs are tested, the test's bound, and the rows that each of the four cases must have.
PAIR_TERMS, PAIR_Z, PAIR_ROWS = 1024, 8.0, 10
#: Terms on either side of a block of pairs that is tested at once.
PAIR_BLOCK = 1024
RANK, EPOCHS, BATCH, RATE, DECAY, START, SEED, THRESHOLD = 8, 30, 256, 0.05, 1e-4, 0.1, 7, 0.3
#: Letters of a word that are a term of their own.
PREFIX = 5
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct words, and of the first PREFIX letters of longer ones (for inflections)."""
    words = set(_WORD.findall(text.lower())) if text else set()
    words |= {w[:PREFIX] + "-" for w in words if len(w) > PREFIX}
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) & ((1 << HASH_BITS) - 1))


class Machine:
    """w0, linear weights and factors over the chosen terms."""

    def __init__(self, chosen: np.ndarray, w0: float = 0.0):
        self.chosen, self.w0 = chosen, w0
        self.w = np.zeros(len(chosen))
        self.v = np.random.default_rng(SEED).normal(0, START, (len(chosen), RANK))

    def places(self, found: np.ndarray) -> np.ndarray:
        """Where a document's terms are among the chosen ones."""
        if not len(self.chosen) or not len(found):
            return np.zeros(0, np.int64)
        at = np.searchsorted(self.chosen, found)
        at[at == len(self.chosen)] = 0
        return at[self.chosen[at] == found]

    def raw(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
        some, starts = sizes > 0, np.cumsum(sizes) - sizes
        sums, rest = np.zeros((len(docs), RANK)), np.zeros(len(docs))
        if some.any():
            own = self.v[flat]
            sums[some] = np.add.reduceat(own, starts[some])
            rest[some] = np.add.reduceat(self.w[flat] - 0.5 * (own**2).sum(1), starts[some])
        return self.w0 + rest + 0.5 * (sums**2).sum(1), flat, np.repeat(np.arange(len(docs)), sizes), sums

    def score(self, docs: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(docs)[0], -30, 30)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray) -> None:
        """Adagrad on the logistic loss, from the labels' own rate."""
        rng, n = np.random.default_rng(SEED), len(docs)
        share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
        self.w0 = float(np.log(share / (1 - share)))
        gw, gv, g0 = np.full_like(self.w, 1e-8), np.full_like(self.v, 1e-8), 1e-8
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for lo in range(0, n, BATCH):
                own = order[lo : lo + BATCH]
                raw, flat, row, sums = self.raw([docs[i] for i in own])
                slope = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]
                step = slope.sum() / len(own)
                g0 += step**2
                self.w0 -= RATE * step / np.sqrt(g0)
                if not len(flat):
                    continue
                by_term = np.argsort(flat, kind="stable")
                row, flat = row[by_term], flat[by_term]
                first = np.flatnonzero(np.diff(flat, prepend=-1))
                used = flat[first]
                dw = np.add.reduceat(slope[row], first) / len(own) + DECAY * self.w[used]
                dv = np.add.reduceat(slope[row, None] * (sums[row] - self.v[flat]), first) / len(own) + DECAY * self.v[used]
                gw[used] += dw**2
                gv[used] += dv**2
                self.w[used] -= RATE * dw / np.sqrt(gw[used])
                self.v[used] -= RATE * dv / np.sqrt(gv[used])


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def candidate_terms(labelled: DataFrame, min_z: float = MIN_Z, max_terms: int | None = MAX_TERMS, pair_terms: int | None = PAIR_TERMS) -> tuple[np.ndarray, np.ndarray]:
    """Of all labelled rows' terms (toxic, terms), counted in Spark: those whose shares of the two labels' rows differ by
    at least ``min_z`` standard errors, the strongest ``max_terms`` at most; and those whose pairs are tested, at most
    ``pair_terms``. Both limits may be None: then all terms that pass the tests are taken, whose number the bounded
    sample of labelled rows limits."""
    n, n_toxic = labelled.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not n_toxic or n == n_toxic:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = labelled.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    p, gap = F.col("n") / n, F.col("bad") / n_toxic - (F.col("n") - F.col("bad")) / (n - n_toxic)
    z = gap / F.sqrt(F.greatest(p * (1 - p) * (1 / n_toxic + 1 / (n - n_toxic)), F.lit(1e-12)))
    tested = counts.where(F.col("n") >= MIN_ROWS).select("term", "n", F.abs(z).alias("z"))
    first = lambda rows, k: rows if k is None else rows.limit(k)
    strong = [r["term"] for r in first(tested.where(F.col("z") >= min_z).orderBy(F.desc("z"), "term"), max_terms).collect()]
    # A word in nearly all or nearly no rows leaves one of the four cases empty.
    often = tested.where((F.col("n") >= 4 * PAIR_ROWS) & (F.col("n") <= n - 4 * PAIR_ROWS))
    often = [r["term"] for r in first(often.orderBy(F.desc("n"), "term"), pair_terms).collect()]
    paired = list(dict.fromkeys([*strong[: None if pair_terms is None else pair_terms // 2], *often]))[:pair_terms]
    return np.array(sorted(strong), np.int64), np.array(sorted(paired), np.int64)


def interacting(docs: list[np.ndarray], labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Places of terms that interact with another one: the share of label 1 with both, less those with either alone,
    plus that with none, is PAIR_Z standard errors from zero. ``docs`` holds places below ``n_terms``."""
    flat = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    alone, bad_alone = np.bincount(flat, minlength=n_terms), np.bincount(flat, labels[row], n_terms)
    found = np.zeros(n_terms, bool)
    for a in range(0, n_terms, PAIR_BLOCK):
        for b in range(a, n_terms, PAIR_BLOCK):
            hi, to = min(n_terms, a + PAIR_BLOCK), min(n_terms, b + PAIR_BLOCK)
            own = [((flat >= x) & (flat < y)) for x, y in ((a, hi), (b, to))]
            both, bad = np.zeros((hi - a, to - b)), np.zeros((hi - a, to - b))
            for lo in range(0, len(docs), 2048):
                use = (row >= lo) & (row < lo + 2048)
                x, y = (np.zeros((min(2048, len(docs) - lo), n), np.float32) for n in (hi - a, to - b))
                for m, keep, begin in ((x, own[0], a), (y, own[1], b)):
                    m[row[use & keep] - lo, flat[use & keep] - begin] = 1
                toxic = labels[lo : lo + 2048] == 1
                both += x.T @ y
                bad += x[toxic].T @ y[toxic]
            strong = _contrast(both, bad, (alone[a:hi], alone[b:to]), (bad_alone[a:hi], bad_alone[b:to]), len(docs), labels.sum())
            if a == b:
                np.fill_diagonal(strong, False)
            found[a:hi] |= strong.any(1)
            found[b:to] |= strong.any(0)
    return np.flatnonzero(found)


def _contrast(both, bad, alone, bad_alone, n_rows: float, n_bad: float) -> np.ndarray:
    """Which pairs of terms (rows, columns) interact."""
    def cases(m: np.ndarray, one: tuple, total: float):
        return m, one[0][:, None] - m, one[1][None, :] - m, total - one[0][:, None] - one[1][None, :] + m

    contrast, spread, enough = 0.0, 0.0, True
    for n, b, sign in zip(cases(both, alone, n_rows), cases(bad, bad_alone, n_bad), (1, -1, -1, 1)):
        share = (b + 0.5) / (n + 1)
        contrast, spread, enough = contrast + sign * share, spread + share * (1 - share) / (n + 1), enough & (n >= PAIR_ROWS)
    return enough & (np.abs(contrast) >= PAIR_Z * np.sqrt(spread))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, min_z: float = MIN_Z, max_terms: int | None = MAX_TERMS, pair_terms: int | None = PAIR_TERMS) -> Machine | None:
    """A machine fitted on labelled documents that are not held out: at most ``rows`` of them, by a hash of the id and,
    where ids repeat, of the text. ``min_z``, ``max_terms`` and ``pair_terms`` choose the terms; None lifts a limit, and with
    ``min_z`` 0 every term of at least MIN_ROWS rows is a feature."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    @F.pandas_udf("array<int>")
    def features(text: pd.Series) -> pd.Series:
        return text.map(terms)

    # ``known`` is bounded by ``rows``, so every task can hold it and no text is shuffled; a text counts once.
    labelled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("doc_id", "toxic", F.xxhash64("text").alias("mark"), features("text").alias("terms"))
    labelled = labelled.dropDuplicates(["doc_id", "mark"]).orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(rows)
    labelled = scratch.written(labelled, "op8-terms")
    strong, paired = candidate_terms(labelled, min_z, max_terms, pair_terms)
    every = docs.sparkSession.sparkContext.broadcast(Machine(np.union1d(strong, paired)))

    @F.pandas_udf("binary")
    def places(found: pd.Series) -> pd.Series:
        return found.map(lambda t: every.value.places(np.asarray(t, np.int64)).astype(np.int32).tobytes())

    got = labelled.select("doc_id", "toxic", places("terms").alias("at")).orderBy("doc_id", "at").collect()  # at most ``rows`` short lists
    scratch.dropped(labelled)
    if not got:
        return None
    found, toxic = [np.frombuffer(r["at"], np.int32).astype(np.int64) for r in got], np.array([r["toxic"] for r in got], np.float64)
    names = every.value.chosen
    where = np.full(len(names), -1)
    where[np.searchsorted(names, paired)] = np.arange(len(paired))
    mutual = paired[interacting([w[w >= 0] for w in (where[d] for d in found)], toxic, len(paired))]
    machine = Machine(np.union1d(strong, mutual))
    machine.fit([machine.places(names[d]) for d in found], toxic)
    return machine


def scored(docs: DataFrame, machine: Machine | None, name: str = "__ls_score") -> DataFrame:
    """``docs`` with a score between 0 and 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        m = shared.value
        if m is None:
            return pd.Series(np.zeros(len(text)))
        return pd.Series(m.score([m.places(terms(t)) for t in text]))

    return docs.withColumn(name, score(F.col("text")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), F.col("__ls_score").alias("score"), (F.col("__ls_score") >= THRESHOLD).cast("int").alias("predicted"))
