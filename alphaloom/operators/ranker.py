"""Learning to rank by date: boosted histogram trees with pairwise or NDCG gradients, trained where the rows are.

The panel becomes one block a date (binned features as bytes, grades, scores), cut off from its plan by a checkpoint. Each tree level
is one narrow pass over the blocks, for all models that are trained together, that returns gradient sums by (node, feature, bin): their
size depends on models and parameters, never on the rows. Every KEPT trees the scores so far go into the blocks by a checkpoint, so a
pass runs through fewer than KEPT trees. The sums are added up on the executors in a fixed number of slots; the driver picks the
splits. A date's block is bounded by the universe. Pairs live only inside a block, as gradient sums.

Not bit-equal to any other trainer: gradients are scaled to a mean pair weight of one a row, and bins come from approximate quantiles.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import evaluation
from .labels import relevance_grade

STRIP = 512
TILE = 64
SLOTS = 16
KEPT = 8
#: (max_depth, eta, reg_lambda, reg_alpha, min_child_weight) of the trials: fixed values.
COVERING = ((2, 0.03, 1.0, 0.0, 5), (2, 0.05, 5.0, 0.1, 10), (3, 0.03, 5.0, 0.1, 5), (3, 0.05, 1.0, 0.0, 10), (4, 0.03, 1.0, 0.1, 10), (4, 0.05, 5.0, 0.0, 5))
HIGH_REGULARIZATION = ((2, 0.03, 5.0, 0.1, 10), (2, 0.05, 10.0, 0.5, 20), (3, 0.03, 20.0, 1.0, 10), (3, 0.05, 5.0, 1.0, 20), (4, 0.03, 10.0, 0.1, 20), (4, 0.05, 20.0, 0.5, 10))


@dataclass(frozen=True)
class Params:
    """objective is `pairwise` or `ndcg`; bins is the number of value bins of a feature (at most 254, missing values have their own)."""

    objective: str = "pairwise"
    max_depth: int = 3
    eta: float = 0.05
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    min_child_weight: float = 5.0
    subsample: float = 0.8
    colsample: float = 0.8
    rounds: int = 200
    early_stopping: int = 30
    bins: int = 64
    seed: int = 42


def trials(objective: str, rounds: int = 200, high_regularization: bool = False) -> list[Params]:
    table = HIGH_REGULARIZATION if high_regularization else COVERING
    return [Params(objective, d, eta, lam, alpha, weight, rounds=rounds) for d, eta, lam, alpha, weight in table]


@dataclass
class Tree:
    """Nodes in heap order: the children of i are 2i+1 and 2i+2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, x: np.ndarray, levels: int) -> np.ndarray:
        node = np.zeros(len(x), int)
        for _ in range(levels):
            f = self.feature[node]
            v = x[np.arange(len(x)), np.maximum(f, 0)]
            right = np.where(v == 0, ~self.missing_left[node], v > self.cut[node])
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    params: Params
    trees: list[Tree] = field(default_factory=list)

    def binned(self, raw: np.ndarray) -> np.ndarray:
        """Bin 0 is missing; bin k > 0 holds values above edge k - 2 and up to edge k - 1."""
        out = np.zeros(raw.shape, np.uint8)
        for j, e in enumerate(self.edges):
            ok = np.isfinite(raw[:, j])
            out[ok, j] = np.searchsorted(e, raw[ok, j], side="left") + 1
        return out

    def scores(self, x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
        """Sums over the trees, added to `start`."""
        total = np.zeros(len(x)) if start is None else start.copy()
        for t in self.trees:
            total += t.value[t.nodes(x, self.params.max_depth)]
        return total


def _rho(gap: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(gap, -50, 50)))


def _basis(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Chebyshev nodes over the levels and the Lagrange basis (level, node), enough of them that interpolating the logistic curve is exact to rounding; None where direct sums are less work."""
    mid, half = (levels[-1] + levels[0]) / 2, (levels[-1] - levels[0]) / 2
    turn = np.pi / half  # the curve's poles lie at a distance of pi from the real line
    nodes = int(np.ceil(36 / np.log(turn + np.hypot(turn, 1)))) + 6
    if 4 * nodes > len(levels):
        return None
    angle = (2 * np.arange(nodes) + 1) * np.pi / (2 * nodes)
    c = mid + half * np.cos(angle)
    gap = levels[:, None] - c[None, :]
    hit = gap == 0
    basis = (-1.0) ** np.arange(nodes) * np.sin(angle) / np.where(hit, 1.0, gap)
    basis /= basis.sum(1, keepdims=True)
    met = hit.any(1)
    basis[met] = hit[met]
    return c, basis


def _curve_sums(levels: np.ndarray, w: np.ndarray, signed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Over the other levels (ascending): sums of rho times w and of rho (1 - rho) times w, where rho is of pairs whose better row has the own level; `signed` counts higher levels negative and leaves the own out."""
    m, q = w.shape
    got = _basis(levels) if m > 64 else None
    if got is None:
        out = np.zeros((2, m, q))
        for s in range(0, m, STRIP):
            rho = _rho(levels[s : s + STRIP, None] - levels[None, :])
            sign = np.sign(levels[s : s + STRIP, None] - levels[None, :]) if signed else 1.0
            out[0, s : s + STRIP], out[1, s : s + STRIP] = (sign * rho) @ w, (sign * rho * (1 - rho)) @ w
        return out[0], out[1]
    c, basis = got
    if not signed:
        rho, moments = _rho(c[:, None] - c[None, :]), basis.T @ w
        return basis @ (rho @ moments), basis @ ((rho * (1 - rho)) @ moments)
    # The sign breaks the curve at the own level: tiles of levels are summed directly, those before and after a tile by their moments.
    size = min(TILE, STRIP)
    tiles = -(-m // size)
    full = lambda x: np.concatenate([x, np.zeros((tiles * size - m, *x.shape[1:]))]).reshape(tiles, size, *x.shape[1:])
    x, wt = full(levels), full(w)
    moments = full(basis).transpose(0, 2, 1) @ wt
    upto = np.cumsum(moments, 0)
    others = 2 * upto - moments - upto[-1]
    sign = np.sign(np.arange(size)[:, None] - np.arange(size)[None, :])
    far, near = _rho(x[:, :, None] - c), _rho(x[:, :, None] - x[:, None, :])
    first = far @ others + (sign * near) @ wt
    second = (far * (1 - far)) @ others + (sign * near * (1 - near)) @ wt
    return first.reshape(-1, q)[:m], second.reshape(-1, q)[:m]


def _signed_sums(w: np.ndarray) -> np.ndarray:
    """Sums over the lower levels less those over the higher."""
    upto = np.cumsum(w, 0)
    return 2 * upto - w - upto[-1]


def pair_gradients(grade: np.ndarray, score: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss over pairs of unequal grade, weighted by their NDCG change for `ndcg`.

    Every pair counts, but none is formed: rows of one score and one grade are taken together, and sums over other scores go through
    the moments of the curve's interpolation, so the work grows with rows and distinct scores times grades, not with their square.
    """
    n = len(grade)
    marks, a = np.unique(grade, return_inverse=True)
    order = np.argsort(-score, kind="stable")
    starts = np.flatnonzero(np.diff(score[order], prepend=np.nan) != 0)
    sizes = np.diff(np.append(starts, n))
    k, m = len(marks), len(starts)
    if k < 2:
        return np.zeros(n), np.zeros(n)
    levels, u = score[order][starts][::-1], np.empty(n, int)
    u[order] = np.repeat(np.arange(m)[::-1], sizes)
    cells = u * k + a
    count = np.bincount(cells, minlength=m * k).reshape(m, k).astype(float)
    lower = marks[None, :] < marks[:, None]  # (own grade, other grade)
    ndcg = objective == "ndcg"
    down = np.where(lower, np.abs(marks[:, None] - marks[None, :]) if ndcg else 1.0, 0.0)
    up = down.T
    # Sums over the other rows by (their score, own grade).
    below, above = count @ down.T, count @ up.T
    if not ndcg:
        first, second = _curve_sums(levels, below + above, False)
        first = above.sum(0) - first
        g, h, weights = first[u, a], second[u, a], below.sum(0)[a].sum()
    else:
        place = np.empty(n)
        place[order] = 1 / np.log2(np.arange(n) + 2.0)
        # Weights are differences of places, so there are sums of weights and of weights times place; of other scores only, with the sign that makes the differences positive.
        placed = np.bincount(cells, place, m * k).reshape(m, k)
        below, above = np.hstack([below, placed @ down.T]), np.hstack([above, placed @ up.T])
        first, second = _curve_sums(levels, below + above, True)
        first = _signed_sums(above) - first
        own = lambda x: x[u, a] * place - x[u, k + a]
        g, h, weights = own(first), own(second), own(_signed_sums(below)).sum()
        # Pairs of one score: rows in order of place, those of a grade before and after a row within its score.
        many = sizes > 1
        if many.any():
            rows, lengths = order[np.repeat(many, sizes)], sizes[many]
            heads, mark, at = np.cumsum(lengths) - lengths, a[rows], place[rows]
            low, high = np.zeros(len(rows)), np.zeros(len(rows))
            step = max(1, 2**17 // len(rows))
            for s in range(0, k, step):
                other = np.arange(s, min(s + step, k))[:, None]
                mine = (mark == other).astype(float)
                parts = []
                for x in (mine, mine * at):
                    upto = np.cumsum(x, 1)
                    before = upto - np.repeat(upto[:, heads] - x[:, heads], lengths, 1)
                    parts.append((before, np.repeat(np.add.reduceat(x, heads, 1), lengths, 1)))
                (c, c_all), (p, p_all) = parts
                gap = (p - c * at) + ((c_all - c) * at - (p_all - p))  # sum of |differences of places|
                low += (gap * down[mark, other]).sum(0)
                high += (gap * up[mark, other]).sum(0)
            g[rows] += 0.5 * (high - low)
            h[rows] += 0.25 * (high + low)
            weights += low.sum()
    scale = n / weights if weights else 0.0
    return g * scale, np.maximum(h, 0.0) * scale


def block_ndcg(grade: np.ndarray, score: np.ndarray) -> float:
    discount = 1 / np.log2(np.arange(len(grade)) + 2.0)
    best = np.sort(grade)[::-1] @ discount
    return float(grade[np.argsort(-score, kind="stable")] @ discount / best) if best > 0 else 0.0


def cut(df: DataFrame) -> DataFrame:
    """The rows written and read again, without their plan: worth it for what every trial reads."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp())
    return df.checkpoint()


def _uncut(df: DataFrame) -> None:
    """Removes the files of a `cut` that nothing reads any more."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
    path.getFileSystem(df._jdf.sparkSession().sessionState().newHadoopConf()).delete(path, True)


def bin_edges(panel: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Distinct approximate quantiles of each feature, from one aggregation."""
    cuts = [k / bins for k in range(1, bins)]
    row = panel.agg(*(F.percentile_approx(f, cuts, 10_000).alias(f) for f in features)).first()  # bins values a feature
    return [np.unique(np.array(row[f] or [], float)) for f in features]


def blocks(panel: DataFrame, model: Model, target: str, least: int = 50) -> DataFrame:
    """One row a date of at least `least` rows with a target, in order of ticker; `split` tells train from val."""
    names = model.features
    kept = relevance_grade(panel.filter(F.col(target).isNotNull()).select("date", "ticker", "split", target, *names), target)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame(columns=["date", "split", "n", "x", "grade", "score"])
        pdf = pdf.sort_values("ticker", kind="stable")
        x = model.binned(pdf[names].to_numpy(float))
        return pd.DataFrame({"date": [pdf["date"].iloc[0]], "split": [pdf["split"].iloc[0]], "n": [len(pdf)], "x": [x.tobytes()], "grade": [pdf["grade"].to_numpy(np.uint8).tobytes()], "score": [b""]})

    kind = kept.schema["date"].dataType.simpleString()
    packed = kept.groupBy("date").applyInPandas(pack, f"date {kind}, split string, n int, x binary, grade binary, score binary")
    # A block is few bytes and much work: dealt by number, as partitions of many bytes leave cores idle, and one task a core, as each costs a pass some 0.2 s.
    return cut(packed.repartition(panel.sparkSession.sparkContext.defaultParallelism))


@dataclass
class _Trial:
    """What a pass must know of a model: its columns of the blocks, its place among the scores kept there, the trees since, and the growing tree."""

    model: Model
    columns: np.ndarray
    place: int | None
    use: np.ndarray
    tree: Tree

    def score(self, x: np.ndarray, kept: np.ndarray) -> np.ndarray:
        return self.model.scores(x, None if self.place is None else kept[self.place])


def _scored(data: DataFrame, trials: list[_Trial]) -> DataFrame:
    """The blocks with the scores of these trials, one row of the matrix each."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            scores = []
            for n, xb, sb in zip(pdf["n"], pdf["x"], pdf["score"]):
                x, kept = np.frombuffer(xb, np.uint8).reshape(n, -1), np.frombuffer(sb).reshape(-1, n)
                scores.append(np.stack([t.score(x[:, t.columns], kept) for t in trials]).tobytes())
            pdf["score"] = scores
            yield pdf

    return cut(data.mapInPandas(run, data.schema))


def _pass(data: DataFrame, trials: list[_Trial], round_no: int, level: int) -> tuple[list[np.ndarray], np.ndarray, int]:
    """For each trial, gradient sums (node of the level, used feature, bin, 2) over train blocks; at the first level NDCG sums over val blocks and their count."""
    first, count = 2**level - 1, 2**level
    shapes = [(count, len(t.use), t.model.params.bins + 1, 2) for t in trials]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hists, ndcg, days = [np.zeros((2, int(np.prod(s[:3])))) for s in shapes], np.zeros(len(trials)), 0
        for pdf in parts:
            for date, split, n, xb, gb, sb in pdf[["date", "split", "n", "x", "grade", "score"]].itertuples(index=False):
                if split != "train" and level:
                    continue
                x, grade, kept = np.frombuffer(xb, np.uint8).reshape(n, -1), np.frombuffer(gb, np.uint8).astype(float), np.frombuffer(sb).reshape(-1, n)
                days += split != "train"
                for k, t in enumerate(trials):
                    p, own = t.model.params, x[:, t.columns]
                    score = t.score(own, kept)
                    if split != "train":
                        ndcg[k] += block_ndcg(grade, score)
                        continue
                    node = t.tree.nodes(own, level) - first
                    keep = np.random.default_rng([p.seed, round_no, pd.Timestamp(date).toordinal()]).random(n) < p.subsample
                    keep &= node >= 0
                    width, nf = p.bins + 1, len(t.use)
                    cell = ((node[keep, None] * nf + np.arange(nf)) * width + own[keep][:, t.use]).ravel()
                    for m, v in enumerate(pair_gradients(grade, score, p.objective)):
                        hists[k][m] += np.bincount(cell, np.repeat(v[keep], nf), count * nf * width)
        part = TaskContext.get().partitionId()
        yield pd.DataFrame({"slot": [part % SLOTS], "part": [part], "hist": [np.concatenate([h.T.ravel() for h in hists]).tobytes()], "ndcg": [ndcg.tobytes()], "days": [days]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")  # one order of summing, whatever task ends first
        sums = {c: [sum(np.frombuffer(b) for b in pdf[c]).tobytes()] for c in ("hist", "ndcg")}
        return pd.DataFrame({"slot": [pdf["slot"].iloc[0]], "part": [0], **sums, "days": [pdf["days"].sum()]})

    schema = "slot int, part int, hist binary, ndcg binary, days long"
    sums = data.mapInPandas(run, schema)
    if data.rdd.getNumPartitions() > 2 * SLOTS:  # few are added up by the driver itself
        sums = sums.groupBy("slot").applyInPandas(add, schema)
    rows = sorted(sums.collect(), key=lambda r: (r["slot"], r["part"]))  # at most 2 * SLOTS rows
    total = sum((np.frombuffer(r["hist"]) for r in rows), np.zeros(ends[-1]))
    ndcg = sum((np.frombuffer(r["ndcg"]) for r in rows), np.zeros(len(trials)))
    return [h.reshape(s) for h, s in zip(np.split(total, ends[:-1]), shapes)], ndcg, sum(r["days"] for r in rows)


def _shrunk(g: np.ndarray, p: Params) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - p.reg_alpha, 0.0)


def _grow(tree: Tree, hist: np.ndarray, use: np.ndarray, level: int, p: Params) -> None:
    """Splits the nodes of a level where that gains, and sets the values of what it makes."""
    quality = lambda g, h: _shrunk(g, p) ** 2 / (h + p.reg_lambda)
    value = lambda g, h: -p.eta * _shrunk(g, p) / (h + p.reg_lambda)
    first = 2**level - 1
    for k in range(len(hist)):
        i = first + k
        if i and tree.feature[(i - 1) // 2] < 0:
            continue
        total = hist[k, 0].sum(0)  # every row lies in some bin of each feature
        if i == 0:
            tree.value[0] = value(*total)
        missing, left = hist[k, :, :1], np.cumsum(hist[k, :, 1:-1], 1)
        options = np.stack([left, left + missing])  # missing values to the right, to the left
        right = total - options
        ok = (options[..., 1] >= p.min_child_weight) & (right[..., 1] >= p.min_child_weight)
        gain = np.where(ok, quality(options[..., 0], options[..., 1]) + quality(right[..., 0], right[..., 1]) - quality(*total), -np.inf)
        best = np.unravel_index(np.argmax(gain), gain.shape)
        if not gain[best] > 1e-9:
            continue
        tree.feature[i], tree.cut[i], tree.missing_left[i], tree.gain[i], tree.cover[i] = use[best[1]], best[2] + 1, bool(best[0]), gain[best], total[1]
        tree.value[2 * i + 1], tree.value[2 * i + 2] = value(*options[best]), value(*right[best])


def train(data: DataFrame, model: Model) -> tuple[Model, list[float]]:
    """The model with the trees of the round of the best validation NDCG (the last without val blocks), and the NDCG after each round."""
    return train_all(data, [model], model.features)[0]


def train_all(data: DataFrame, models: list[Model], names: list[str]) -> list[tuple[Model, list[float]]]:
    """`train` for several models in one go: a pass serves a level of all of them that have not stopped. `names` are the features of the blocks."""
    trees, history, best = [[] for _ in models], [[] for _ in models], [None] * len(models)
    columns = [np.array([names.index(f) for f in m.features]) for m in models]
    held, kept, scored, round_no = {}, 0, None, 0

    def trial(k: int, tree: Tree | None = None, use: np.ndarray | None = None) -> _Trial:
        return _Trial(Model([], [], models[k].params, trees[k][kept:]), columns[k], held.get(k), use, tree)

    while None in best:
        active = [k for k in range(len(models)) if best[k] is None]
        if round_no - kept == KEPT:
            new = _scored(data, [trial(k) for k in active])
            if scored is not None:
                _uncut(scored)
            data = scored = new
            held, kept = {k: place for place, k in enumerate(active)}, round_no
        grown = {}
        for k in active:
            p, nf = models[k].params, len(models[k].features)
            use = np.sort(np.random.default_rng([p.seed, round_no]).permutation(nf)[: max(1, round(p.colsample * nf))])
            grown[k] = trial(k, Tree.empty(p.max_depth), use)
        growing = active
        for level in range(max(models[k].params.max_depth for k in active)):
            growing = [k for k in growing if level < models[k].params.max_depth]
            if not growing:
                break
            hists, ndcg, days = _pass(data, [grown[k] for k in growing], round_no, level)
            split = []
            for k, hist, gained in zip(growing, hists, ndcg):
                p, tree = models[k].params, grown[k].tree
                if level == 0:
                    if days:
                        history[k].append(float(gained / days))
                    top = int(np.argmax(history[k])) if history[k] else round_no
                    if round_no == p.rounds or (days and round_no - top >= p.early_stopping):
                        best[k] = top
                        continue
                _grow(tree, hist, grown[k].use, level, p)
                if (tree.feature[2**level - 1 :] >= 0).any():
                    split.append(k)
            growing = split  # without those of which no node of this level was split
        for k in active:
            if best[k] is None:
                trees[k].append(grown[k].tree)
        round_no += 1
    if scored is not None:
        _uncut(scored)
    return [(replace(m, trees=t[:b]), h) for m, t, b, h in zip(models, trees, best, history)]


def predict(panel: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep` and `prediction`, row by row."""
    rows = panel.select(*keep, *(F.col(f).alias(f"_x{j}") for j, f in enumerate(model.features)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["prediction"] = model.scores(model.binned(pdf[[f"_x{j}" for j in range(len(model.features))]].to_numpy(float)))
            yield pdf[[*keep, "prediction"]]

    return rows.mapInPandas(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", prediction double")


def mean_rank_ic(panel: DataFrame, model: Model, target: str, split: str, least: int = 50) -> float | None:
    return mean_rank_ics(panel, [model], target, split, least)[0]


def mean_rank_ics(panel: DataFrame, models: list[Model], target: str, split: str, least: int = 50) -> list[float | None]:
    """The mean daily rank IC of each model, from one pass over the rows."""
    names = sorted({f for m in models for f in m.features})
    rows = panel.filter((F.col("split") == split) & F.col(target).isNotNull()).select("date", "ticker", F.col(target).alias("_y"), *(F.col(f).alias(f"_x{j}") for j, f in enumerate(names)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            raw = pdf[[f"_x{j}" for j in range(len(names))]].to_numpy(float)
            scores = np.column_stack([m.scores(m.binned(raw[:, [names.index(f) for f in m.features]])) for m in models])
            yield pdf[["date", "ticker", "_y"]].assign(p=list(scores))

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("date", "ticker", "_y"))
    scored = rows.mapInPandas(run, f"{kinds}, p array<double>")
    pairs = scored.select("date", "ticker", F.col("_y").alias("target"), F.posexplode("p").alias("alpha", "value"))
    got = {r["alpha"]: r["ic"] for r in evaluation.daily_rank_ic(pairs, least).groupBy("alpha").agg(F.avg("ic").alias("ic")).collect()}  # one row a model
    return [got.get(k) for k in range(len(models))]


def train_best(panel: DataFrame, features: list[str], target: str, grid: list[Params], least: int = 50) -> tuple[Model, list[tuple[Params, float | None, int]]]:
    """The trial with the best mean daily rank IC on val dates, and (params, rank IC, trees) of each trial.

    The panel has date, ticker, split (train, val, test; one a date), target and features. A trial without any rank IC counts
    as worst; of equal ones the first stays.
    """
    return train_grids(panel, [(features, grid)], target, least)[0]


def train_grids(panel: DataFrame, jobs: list[tuple[list[str], list[Params]]], target: str, least: int = 50) -> list[tuple[Model, list[tuple[Params, float | None, int]]]]:
    """`train_best` for each (features, grid). All trials of one number of bins share their blocks and their passes."""
    seen, names = panel.filter(F.col("split").isin("train", "val")), sorted({f for features, _ in jobs for f in features})
    wanted = [(j, k, p) for j, (_, grid) in enumerate(jobs) for k, p in enumerate(grid)]
    got: dict[tuple[int, int], Model] = {}
    for bins in sorted({p.bins for *_, p in wanted}):
        edges = dict(zip(names, bin_edges(seen.filter((F.col("split") == "train") & F.col(target).isNotNull()), names, bins)))
        mine = [(j, k, p) for j, k, p in wanted if p.bins == bins]
        data = blocks(seen, Model(names, [edges[f] for f in names], mine[0][2]), target, least)
        models = [Model(jobs[j][0], [edges[f] for f in jobs[j][0]], p) for j, _, p in mine]
        got |= {(j, k): model for (j, k, _), (model, _) in zip(mine, train_all(data, models, names))}
        _uncut(data)
    ics = dict(zip(got, mean_rank_ics(panel, list(got.values()), target, "val", least)))
    out = []
    for j, (_, grid) in enumerate(jobs):
        best = max(range(len(grid)), key=lambda k: (ics[j, k] is not None, ics[j, k] or 0.0, -k))
        out.append((got[j, best], [(p, ics[j, k], len(got[j, k].trees)) for k, p in enumerate(grid)]))
    return out


def importance(spark, model: Model) -> DataFrame:
    """feature, gain and cover (means over its splits), weight (their number), normalized_gain, importance_rank (1 is best, ties share the least)."""
    gain, cover, weight = (dict.fromkeys(model.features, 0.0) for _ in range(3))
    for t in model.trees:
        for i in np.flatnonzero(t.feature >= 0):
            f = model.features[t.feature[i]]
            gain[f], cover[f], weight[f] = gain[f] + t.gain[i], cover[f] + t.cover[i], weight[f] + 1
    mean = {f: (gain[f] / weight[f] if weight[f] else 0.0) for f in model.features}
    total = sum(mean.values())
    rows = [
        (f, float(mean[f]), float(cover[f] / weight[f]) if weight[f] else 0.0, float(weight[f]), float(mean[f] / total) if total else 0.0, 1 + sum(bool(mean[o] > mean[f]) for o in model.features))
        for f in model.features
    ]
    return spark.createDataFrame(rows, "feature string, gain double, cover double, weight double, normalized_gain double, importance_rank int")


# ---------------------------------------------------------------- ablation


@dataclass(frozen=True)
class Experiment:
    name: str
    force: tuple[int, ...] = ()
    exclude: tuple[int, ...] = ()
    only: tuple[int, ...] = ()
    selected_only: bool = False
    high_regularization: bool = False


#: Ablation experiments and the signals that they force, leave out or keep to: fixed values.
EXPERIMENTS = (
    Experiment("baseline_current"),
    Experiment("force_include_alpha32", force=(32,)),
    Experiment("exclude_alpha55_ATR", exclude=(55,)),
    Experiment("exclude_alpha68_ADV_trend", exclude=(68,)),
    Experiment("force_alpha32_exclude_alpha55_alpha68", force=(32,), exclude=(55, 68)),
    Experiment("clean_backbone_set", force=(32, 54, 65, 30, 34, 56, 57, 66), exclude=(55, 68), selected_only=True),
    Experiment("high_regularization_baseline", high_regularization=True),
    Experiment("high_regularization_clean", force=(32,), exclude=(55, 68), high_regularization=True),
)
OPTIONAL_EXPERIMENTS = (
    Experiment("only_momentum_block", only=(30, 32, 34, 31, 33)),
    Experiment("only_volatility_liquidity_block", only=(54, 55, 56, 57, 58, 65, 66, 67)),
    Experiment("volatility_liquidity_without_ATR", only=(54, 56, 57, 58, 65, 66, 67), exclude=(55,)),
)


def experiment_ids(e: Experiment, usable: set[int], selected: set[int], present: set[int]) -> list[int]:
    """Signal ids of an experiment: the usable ones or a part of them, with the forced and without the excluded, as far as the panel has them. 35 never."""
    ids = set(e.only) if e.only else usable & selected if e.selected_only else set(usable)
    return sorted(((ids | set(e.force)) - set(e.exclude) - {35}) & present)


def run_ablation(panel: DataFrame, columns: dict[int, str], usable: set[int], selected: set[int], target: str, grids: tuple[list[Params], list[Params]], experiments=EXPERIMENTS, least: int = 50) -> DataFrame:
    """experiment, variant, objective, n_features, val_rank_ic, test_rank_ic: a model for each experiment, for `evidence.ablation_deltas`.

    `columns` names each signal's feature; `grids` are the trials of plain and of highly regularised experiments. Experiments
    left without a feature have NULL results.
    """
    sets = [tuple(columns[k] for k in experiment_ids(e, usable, selected, set(columns))) for e in experiments]
    keys = [(names, e.high_regularization) for names, e in zip(sets, experiments)]
    jobs = [key for key in dict.fromkeys(keys) if key[0]]  # experiments of equal features and grids are one model
    best = [model for model, _ in train_grids(panel, [(list(names), grids[high]) for names, high in jobs], target, least)] if jobs else []
    ics = [dict(zip(jobs, mean_rank_ics(panel, best, target, s, least))) if jobs else {} for s in ("val", "test")]
    rows = [(e.name, "value", grids[key[1]][0].objective, len(key[0]), ics[0].get(key), ics[1].get(key)) for e, key in zip(experiments, keys)]
    return panel.sparkSession.createDataFrame(rows, "experiment string, variant string, objective string, n_features int, val_rank_ic double, test_rank_ic double")
