"""Quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are byte-class shares of itself and of its neighbours; chain weights favour runs
of equal lines. Forward-backward gives each line's marginal, and a document's quality follows from the
length-weighted mean of its lines' marginals. Only documents are labelled, so training alternates: lines of bad documents
start as bad, a line classifier finds those that look like lines of good documents, then the field is trained on
the labels so cleaned, and the last step calibrates the weighted mean against document labels.

Bounds (parameters): `sample` labelled training rows, of `sample_mb` of text in all (fewer rows are drawn where texts are
long). Lines weigh by their length, in training as in scoring. Every document's whole text is scored. Rows of the
held-out fold never lend their labels.

Defined results: null text is empty, and an empty text is one empty line; repeated rows get equal scores; without
labels every score is 0.5; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, bucket_of, text_chunks
from .toxicity import fit_linear

#: Byte classes whose shares of a line are features.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b".,;:'", b"!?", b"|", b"#$%&*", b"<>{}[]()=_/\\~^@+-\"`", bytes(range(128, 256)))
_TABLE = np.zeros(256, np.int64)
for _k, _c in enumerate(CLASSES):
    _TABLE[list(_c)] = _k + 1
OWN = len(CLASSES) + 5
FEATURES = 3 * OWN


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte lengths of all lines, and the number of lines of each text."""
    lines = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    flat = [x for own in lines for x in own]
    length = np.array([len(x) for x in flat])
    kinds = _TABLE[np.frombuffer(b"".join(flat), np.uint8)]
    ends = np.cumsum(length)
    starts = ends - length
    own = np.zeros((len(flat), OWN), np.float32)
    for k in range(len(CLASSES)):
        sums = np.concatenate([[0], np.cumsum(kinds == k + 1)])
        own[:, k] = (sums[ends] - sums[starts]) / np.maximum(length, 1)
    at = len(CLASSES)
    own[:, at] = np.log1p(length) / 8
    own[:, at + 1] = length == 0
    repeated, distinct = [], []
    for x in lines:
        seen: dict[bytes, int] = {}
        for line in x:
            seen[line] = seen.get(line, 0) + 1
        repeated += [seen[line] > 1 and bool(line) for line in x]
    for line in flat:
        words = line.split()
        distinct.append(len(set(words)) / len(words) if words else 1.0)
    own[:, at + 2] = repeated
    own[:, at + 3] = distinct
    own[:, at + 4] = own[:, 0] > 0.5
    last = np.cumsum(counts) - 1
    before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
    before[np.concatenate([[0], last[:-1] + 1])] = 0
    after[last] = 0
    return np.hstack([own, before, after]), length, counts


def marginals(unary: np.ndarray, counts: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p(line is good) for chains of `counts` lines, and the expected transitions. unary: score of good over bad."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    size = counts[order]
    score = np.stack([np.zeros_like(unary), unary], 1)
    forward, backward = np.zeros_like(score), np.zeros_like(score)
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")  # chains with more than t lines
    for t in range(steps):
        i = starts[: alive[t]] + t
        forward[i] = score[i] if t == 0 else score[i] + np.logaddexp(forward[i - 1][:, :1] + chain[0], forward[i - 1][:, 1:] + chain[1])
    for t in range(steps - 2, -1, -1):
        i = starts[: alive[t + 1]] + t
        ahead = score[i + 1] + backward[i + 1]
        backward[i] = np.logaddexp(chain[:, 0] + ahead[:, :1], chain[:, 1] + ahead[:, 1:])
    both = forward + backward
    norm = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - norm)
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(counts) - counts] = False
    j = np.flatnonzero(inner)
    moves = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            moves[a, b] = np.exp(forward[j - 1, a] + chain[a, b] + score[j, b] + backward[j, b] - norm[j]).sum()
    return good, moves


def train_field(x: np.ndarray, length: np.ndarray, counts: np.ndarray, label: np.ndarray, steps: int = 120) -> dict[str, np.ndarray]:
    """Weights of lines and chain, and the calibration of the document's mean."""
    doc = np.repeat(np.arange(len(counts)), counts)
    weight = length + 1.0
    y = label[doc].astype(float)
    for _ in range(2):  # lines of bad documents that look good become good; the worst line stays bad
        balance = np.where(y > 0.5, 1 / max((y > 0.5).sum(), 1), 1 / max((y <= 0.5).sum(), 1))
        w = fit_linear(x, y, balance * weight / weight.mean(), steps=250)
        z = x @ w[:-1] + w[-1]
        worst = np.full(len(counts), np.inf)
        np.minimum.at(worst, doc, z)
        y = np.where(label[doc] == 1, 1.0, np.where((z > 0) & (z > worst[doc]), 1.0, 0.0))
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    chain = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - counts] = False
    j = np.flatnonzero(inner)
    seen = np.array([[((y[j - 1] == a) & (y[j] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
    m = v = 0.0
    for t in range(1, steps + 1):
        good, moves = marginals(x1 @ w, counts, chain)
        g = np.concatenate([x1.T @ (y - good), (seen - moves).ravel()]) / len(y) - 1e-4 * np.concatenate([w, chain.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, chain = w + step[: len(w)], chain + step[len(w) :].reshape(2, 2)
    mean = weighted(marginals(x1 @ w, counts, chain)[0], length, counts)
    return {"w": w, "chain": chain, "scale": fit_linear(np.stack([mean, mean**8], 1), label.astype(float), l2=1e-4, steps=1500)}


def weighted(good: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, by document."""
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(good * (length + 1.0), starts) / np.add.reduceat(length + 1.0, starts)


def field_scores(texts: list[bytes], model: dict[str, np.ndarray]) -> np.ndarray:
    x, length, counts = line_features(texts)
    mean = weighted(marginals(x @ model["w"][:-1] + model["w"][-1], counts, model["chain"])[0], length, counts)
    a, b, c = model["scale"]
    return 1 / (1 + np.exp(-np.clip(a * mean + b * mean**8 + c, -30, 30)))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = 5_000, sample_mb: int = 64, folds: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row."""
    tables = SharedTables(docs.sparkSession, "quality")
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (bucket_of(F.col("doc_id"), folds) != held_out))
    known = known.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    share = min(1.0, sample / max(known.count(), 1))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20))
    chosen = known.filter(draw < int(share * (1 << 20)) + 1)  # about `sample` rows: a proven bound

    def features(batches):
        for batch in batches:
            for first, held in text_chunks(batch.column(0)):
                x, length, counts = line_features(held)
                ends = np.cumsum(counts)
                part = [slice(e - c, e) for e, c in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(first, len(held)), pa.array([x[s].tobytes() for s in part], pa.binary()), pa.array([length[s].astype(np.int32).tobytes() for s in part], pa.binary())], ["quality", "x", "length"]
                )

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = tables.save(docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").dropDuplicates(["text"]))
    held = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / (sample_mb << 20)
    rows = rows.filter(draw < int(share * min(1.0, 1 / max(held, 1e-9)) * (1 << 20)) + 1)
    got = rows.select("text", "quality").mapInArrow(features, "quality int, x binary, length binary").toPandas()
    model = None
    if got["quality"].nunique() == 2:
        got = got.sort_values(["x", "length"], ignore_index=True)  # reruns agree
        length = [np.frombuffer(b, np.int32) for b in got["length"]]
        x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, FEATURES)
        model = train_field(x, np.concatenate(length), np.array([len(n) for n in length]), got["quality"].to_numpy())

    def run(batches):
        for batch in batches:
            for first, held in text_chunks(batch.column(2)):
                s = field_scores(held, model) if model else np.full(len(held), 0.5)
                own = batch.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    folded = docs.select(F.col("doc_id").cast("long"), (bucket_of(F.col("doc_id"), folds) == held_out).alias("held_out"), text.alias("text"))
    return folded.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
