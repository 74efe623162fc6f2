"""Toxicity by weak supervision.

Voters are two seed lexicons, lexicons mined from labelled training rows, and patterns that look at no lexicon: shares of
exclamation marks and of words in capitals, repeated address, masked or stretched words. Each voter fires or not on a
document. A generative label model with one latent class estimates, from how often each combination of votes occurs
over all documents, every voter's accuracy on both classes and the correlations of voters that fire together more than
the class explains; with fifteen voters its normaliser is summed exactly over all combinations. A linear classifier is
then trained on the posterior labels of bounded samples of labelled and of other documents, with the words behind the
voters as its features. Labels given for training rows choose the mined terms and fix the class of those rows in the
label model, where they say which class is which; they are no targets.

Bounds (parameters): `sample` labelled training rows for mining, and as many rows each of labelled and of other documents
for the classifier; `terms` mined terms. Votes and their counts cover all documents. Rows of the held-out fold never
lend their labels.

Defined results: null text is empty; an empty text gets the score of a text without hits; repeated rows get
equal scores; without labels the seed lexicon alone votes; an empty table gives an empty result; other columns are
not read, but for those named in `keep`, which are handed on.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, bucket_of

#: Seed lexicon: fixed values.
SEEDS = ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
_TOKEN = re.compile(r"\w+")
PREFIXES = range(3, 8)
MINED_VOTERS = 9
#: Patterns that look at one whole text: masked words, and words with one letter stretched.
MASKED = re.compile(r"[^\W\d_][*#@$%]{2,}[^\W\d_]")
MARKS, FOURFOLD = re.compile(r"[*#@$%]{2}"), re.compile(r"(.)\1\1\1")  # cheap to look for; most texts have neither
STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
ADDRESS = frozenset(("you", "your", "youre", "yourself", "u", "ur"))
PATTERNS = 4


def terms_of(word: str) -> list[str]:
    """A word stands for itself and for its beginnings."""
    return [word, *(f"{word[:n]}^" for n in PREFIXES if len(word) >= n)]


def _mine(sample: DataFrame, terms: int) -> list[str]:
    """The terms most typical of toxic training rows, by log odds weighed with their frequency; texts count once."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words = set(map(str.lower, _TOKEN.findall(text.as_py() or "")))
                for t in {t for w in words for t in terms_of(w)}:
                    seen[t, toxic] += 1
                seen["", toxic] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["term", "toxic", "n"])

    once = sample.dropDuplicates(["digest"]).select("text", "toxic")
    counts = once.mapInArrow(run, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good")
    )
    totals = counts.filter("term = ''").first()
    if totals is None or not totals["bad"] or not totals["good"]:
        return []
    odds = F.log((F.col("bad") + 0.5) / (totals["bad"] + 1.0)) - F.log((F.col("good") + 0.5) / (totals["good"] + 1.0))
    best = counts.filter("term <> '' AND bad >= 4").withColumn("score", odds * F.sqrt("bad")).filter(odds > 2)
    return [r["term"] for r in best.orderBy(F.desc("score"), "term").limit(terms).collect()]


def pattern_votes(raw: str, words: list[str], lower: list[str]) -> list[bool]:
    """Votes of the patterns on a text and its words: exclamations, capitals, address, masked or stretched words."""
    n = len(words)
    shouts = sum(map(str.isupper, words)) * 3 > n > 2 and sum(w.isupper() and len(w) > 1 for w in words) * 3 > n
    odd = (MARKS.search(raw) and MASKED.search(raw)) or (FOURFOLD.search(raw) and STRETCHED.search(raw))
    return [raw.count("!") * 4 > n > 0, shouts, sum(map(ADDRESS.__contains__, lower)) * 20 > n > 0, bool(odd)]


def _hits(docs: DataFrame, vocabulary: list[str], keep: tuple[str, ...]) -> DataFrame:
    """doc_id, words, ids and counts of the vocabulary's terms in each whole text, the votes as bits, `keep`."""
    index = {t: k for k, t in enumerate(vocabulary)}
    voter = voters_of(vocabulary)

    class Known(dict):
        def __missing__(self, word):
            found = tuple(index[t] for t in terms_of(word) if t in index)
            if len(self) > 200_000:
                self.clear()
            self[word] = found
            return found

    def run(batches):
        known = Known()
        for batch in batches:
            n, ids, counts, votes = [], [], [], []
            for text in batch.column(1):
                raw = text.as_py() or ""
                words = _TOKEN.findall(raw)
                seen: Counter = Counter()
                lower = list(map(str.lower, words))
                for f in map(known.__getitem__, lower):
                    if f:
                        seen.update(f)
                n.append(len(words))
                ids.append(sorted(seen))
                counts.append([seen[k] for k in ids[-1]])
                bits = 0
                for k in seen:
                    bits |= 1 << int(voter[k])
                for k, vote in enumerate(pattern_votes(raw, words, lower)):
                    bits |= vote << (2 + MINED_VOTERS + k)
                votes.append(bits)
            cols = [batch.column(0), pa.array(n, pa.int32()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(votes, pa.int32()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "words", "ids", "counts", "votes", *keep])

    extra = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep).mapInArrow(run, "doc_id long, words int, ids array<int>, counts array<int>, votes int" + extra)


VOTERS = 2 + MINED_VOTERS + PATTERNS


def voters_of(vocabulary: list[str]) -> np.ndarray:
    """The voter of each term: seeds 0 and 1, mined terms dealt over the lexicons in order of their evidence."""
    return np.array([k % 2 if k < len(SEEDS) else 2 + k % MINED_VOTERS for k in range(len(vocabulary))], int)


class LabelModel:
    """p(votes, y) over all combinations: log-linear with class, voter-by-class and voter-pair terms."""

    def __init__(self, voters: int = VOTERS):
        self.lam = ((np.arange(1 << voters)[:, None] >> np.arange(voters)) & 1).astype(float)
        self.prior, self.fire = 0.0, np.zeros((2, voters))
        self.join([])

    def join(self, edges: list[tuple[int, int]]) -> None:
        """Pairs of voters that the model lets fire together."""
        self.edges, self.pair = edges, np.zeros(len(edges))
        self.both = self.lam[:, [a for a, _ in edges]] * self.lam[:, [b for _, b in edges]]

    def _log_joint(self) -> np.ndarray:
        e = self.lam @ self.fire.T + np.array([0.0, self.prior]) + (self.both @ self.pair)[:, None]
        return e - np.logaddexp.reduce(e.ravel())

    def posterior(self) -> np.ndarray:
        """p(toxic | votes) for each combination."""
        lj = self._log_joint()
        return 1 / (1 + np.exp(lj[:, 0] - lj[:, 1]))

    def accuracies(self) -> np.ndarray:
        """p(voter fires | class) by class and voter."""
        p = np.exp(self._log_joint())
        return (p.T @ self.lam) / p.sum(0)[:, None]

    def _climb(self, counts: np.ndarray, steps: int) -> None:
        """Adam on the mean log likelihood; counts by combination: unlabelled, labelled 0, labelled 1."""
        total = counts.sum()
        m = v = 0.0
        for t in range(1, steps + 1):
            p, post = np.exp(self._log_joint()), self.posterior()
            seen = np.stack([counts[:, 0] * (1 - post) + counts[:, 1], counts[:, 0] * post + counts[:, 2]], 1) / total
            gap = seen - p
            g = np.concatenate([[gap[:, 1].sum()], (gap.T @ self.lam).ravel(), gap.sum(1) @ self.both])
            theta = np.concatenate([[self.prior], self.fire.ravel(), self.pair])
            g = g - 1e-4 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
            k = self.fire.size
            self.prior, self.fire, self.pair = theta[0], theta[1 : 1 + k].reshape(self.fire.shape), theta[1 + k :]

    def fit(self, counts: np.ndarray, steps: int = 300) -> LabelModel:
        """Labelled rows, where there are any, weigh as much as the unlabelled ones together: they say which class is which."""
        counts = counts.astype(float)
        if (known := counts[:, 1:].sum()) and (free := counts[:, 0].sum()):
            counts[:, 1:] *= free / known
        self.prior, self.fire[0], self.fire[1] = -2.0, -2.5, 0.5
        self._climb(counts, steps)
        post = self.posterior()
        w = np.stack([counts[:, 0] * (1 - post) + counts[:, 1], counts[:, 0] * post + counts[:, 2]], 1)
        excess = 0.0
        for y in (0, 1):  # what is left of the voters' covariance once the class is known
            mean = (w[:, y] @ self.lam) / max(w[:, y].sum(), 1e-9)
            d = self.lam - mean
            excess = excess + (d.T * w[:, y]) @ d
        sd = np.sqrt(np.maximum(np.diag(excess), 1e-12))
        rho = excess / sd / sd[:, None]
        n = len(rho)
        self.join([(a, b) for a in range(n) for b in range(a + 1, n) if abs(rho[a, b]) > 0.15])
        self._climb(counts, steps)
        return self


def fit_linear(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Logistic regression on soft labels, by Adam; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    m = v = 0.0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) / weight.sum() + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return w


def _below(share: float, *seed) -> Column:
    """True for about that share of rows, by a hash of doc_id."""
    return F.pmod(F.xxhash64("doc_id", *map(F.lit, seed)), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)) + 1


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 12_000, terms: int = 300, folds: int = 5, held_out: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, `keep`: one row per input row."""
    spark = docs.sparkSession
    tables = SharedTables(spark, "toxicity")
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), folds) != held_out))
    known = tables.save(known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    chosen = known.filter(_below(sample / max(known.count(), 1), 5))  # about `sample` rows: a proven bound
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.join(F.broadcast(chosen), "doc_id").withColumn("digest", F.xxhash64("text"))
    vocabulary = [*SEEDS, *(t for t in _mine(rows, terms) if t not in SEEDS)]
    hits = tables.save(_hits(docs, vocabulary, keep))

    fold = bucket_of(F.col("doc_id"), folds) == held_out
    counts = np.zeros((1 << VOTERS, 3))
    # Rows of a repeated label are joined before they are counted; at most 3 rows a combination come back.
    for r in hits.join(known, "doc_id", "left").groupBy("votes", "toxic").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r["votes"], 0 if r["toxic"] is None else 1 + r["toxic"]] += r["n"]
    if not counts.sum():
        return hits.select("doc_id", F.lit(False).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *keep)
    posterior = LabelModel().fit(counts).posterior()

    same = F.xxhash64("ids", "counts", "words").alias("same")
    rest = hits.filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left_anti")  # documents without a label to learn
    own = hits.join(F.broadcast(chosen), "doc_id").unionByName(rest.filter(_below(sample / counts.sum(), 6)), allowMissingColumns=True)
    w = train_classifier(own.select("ids", "counts", "votes", same).toPandas(), posterior, len(vocabulary))

    def run(batches):
        for batch in batches:
            score = []
            for ids, cs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                z = w[-1] + (float(w[ids] @ np.log1p(cs)) if ids else 0.0)
                score.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            s = np.array(score, float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), *batch.columns[4:]], ["doc_id", "held_out", "score", "predicted", *keep])

    extra = "".join(f", {k} {docs.schema[k].dataType.simpleString()}" for k in keep)
    return hits.select("doc_id", fold.alias("held_out"), "ids", "counts", *keep).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int" + extra)


def train_classifier(got, posterior: np.ndarray, terms: int) -> np.ndarray:
    """Weights of the terms and the intercept, from ids, counts and votes of sampled documents; equal ones weigh one together."""
    got = got.sort_values(["same", "votes"], ignore_index=True)  # sums do not depend on the order of arrival
    x = np.zeros((len(got), terms), np.float32)
    for i, (ids, cs) in enumerate(zip(got["ids"], got["counts"])):
        x[i, ids] = np.log1p(cs)
    y = posterior[got["votes"].to_numpy()]  # the posterior alone: given labels shape the label model, never the targets
    return fit_linear(x, y, 1 / got.groupby("same")["same"].transform("size").to_numpy())
