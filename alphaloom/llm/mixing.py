"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source whose target is r times its size is taken floor(r) times, and once more with probability
p = r - floor(r). Which documents get the extra copy is drawn by the cube method: three documents at a time, the
probabilities move along the direction that keeps both the expected number of documents and the expected words,
until one of them is 0 or 1. A block of any size ends with at most two documents undecided; those of all blocks of a
source form the next, far smaller round, together with a few undrawn ones, until one block per source is left, where
the landing rounds the last ones, and exchanges single documents, so that the source's words come nearest to its target.

Blocks have bounded size, so a source with a third of all rows takes many tasks. Draws follow from a document's id,
source and text, and from its place among rows equal in all three; so reruns agree whatever the partitioning, rows
without doc_id and repeated ones are drawn each, and a group of equal rows is dealt over all blocks.

Bound: one row per source meets the driver (name, size, target), as mixtures have few sources.

Defined results: null text has size 0; null sources form one source, last; rows that repeat a document are drawn
each; an empty table gives an empty result; sources without words have target 0; other columns are not read.
"""

from __future__ import annotations

import random
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, SharedTables, placed_in_key

WEIGHTS = (5, 2, 1)
BLOCK = 2000
#: Documents that each block leaves to the next round undrawn.
RESERVE = 8


def source_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = 3) -> list[tuple[str | None, int, float]]:
    """Targets by source: shares of all words by weight, at most `most` times the source's words, excess reshared."""
    ordered = sorted((s for s in sizes if s[0] is not None), key=lambda s: s[0]) + [s for s in sizes if s[0] is None]
    open_ = {i: weights[i % len(weights)] for i in range(len(ordered))}
    target, left = [Fraction(0)] * len(ordered), Fraction(sum(n for _, n in ordered))
    while open_:
        total = sum(open_.values())
        over = [i for i, w in open_.items() if left * w / total > most * ordered[i][1]]
        if not over:
            for i, w in open_.items():
                target[i] = left * w / total
            break
        for i in over:
            target[i] = Fraction(most * ordered[i][1])
            del open_[i]
        left -= sum(target[i] for i in over)
    return [(s, n, float(t)) for (s, n), t in zip(ordered, target)]


def flight(p: list[float], x: list[int], rng: random.Random) -> list[float]:
    """Move probabilities in the null space of (count, words) until at most two are neither 0 nor 1."""
    eps, p, held = 1e-9, list(p), []
    for i in range(len(p)):
        if p[i] <= eps or p[i] >= 1 - eps:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (x[b] - x[c], x[c] - x[a], x[a] - x[b])
            if not any(u):
                u = (1, -1, 0)
            up = min((1 - p[k]) / d if d > 0 else p[k] / -d for k, d in zip(held, u) if d)
            down = min(p[k] / d if d > 0 else (1 - p[k]) / -d for k, d in zip(held, u) if d)
            step = up if rng.random() * (up + down) < down else -down
            for k, d in zip(held, u):
                p[k] += step * d
                if p[k] <= eps or p[k] >= 1 - eps:
                    p[k] = float(round(p[k]))
            held = [k for k in held if 0 < p[k] < 1]
    return p


def land(p: list[float], x: list[int], owed: float) -> list[float]:
    """Round the last undecided ones so that the words come nearest to what is owed, exchanging a few decided ones."""
    q = np.array([round(v) if v in (0.0, 1.0) else -1 for v in p], int)
    x, loose = np.array(x, float), np.flatnonzero(q < 0)
    fixed = owed - x[q == 1].sum()
    best = min(range(1 << len(loose)), key=lambda m: (abs(fixed - sum(x[i] for b, i in enumerate(loose) if m >> b & 1)), m))
    q[loose] = [best >> b & 1 for b in range(len(loose))]
    for _ in range(8):
        gap = owed - x[q == 1].sum()
        out, in_ = np.flatnonzero(q == 1), np.flatnonzero(q == 0)
        moves = [(abs(gap), -1, -1)]
        if len(out):
            i = out[np.abs(gap + x[out]).argmin()]
            moves.append((abs(gap + x[i]), i, -1))
        if len(in_):
            j = in_[np.abs(gap - x[in_]).argmin()]
            moves.append((abs(gap - x[j]), -1, j))
        if len(out) and len(in_):  # drop one, take another
            order = in_[np.argsort(x[in_], kind="stable")]
            at = np.clip(np.searchsorted(x[order], gap + x[out]), 1, len(order) - 1) if len(order) > 1 else np.zeros(len(out), int)
            for near in (order[at], order[np.maximum(at - 1, 0)]):
                rest = np.abs(gap + x[out] - x[near])
                k = int(rest.argmin())
                moves.append((rest[k], out[k], near[k]))
        rest, i, j = min(moves, key=lambda m: (m[0], m[1], m[2]))
        if rest >= abs(gap) - 1e-9:
            break
        q[[k for k in (i, j) if k >= 0]] ^= 1
    return q.astype(float).tolist()


def mix(docs: DataFrame, weights=WEIGHTS, most: int = 3, block: int = BLOCK, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (1 for a document without words), `keep`: one row per input row."""
    spark = docs.sparkSession
    tables = SharedTables(spark, "mix")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    draw = F.xxhash64(F.lit(seed), "doc_id", F.coalesce("source", F.lit("")), "text")
    sized = docs.select("doc_id", "source", *(F.col(k).alias(f"_keep_{k}") for k in keep), size.alias("size"), draw.alias("draw"), F.monotonically_increasing_id().alias("uid"))
    rows = placed_in_key(tables.save(sized), ["draw"], ["size", "uid"], tables).withColumn("draw", F.xxhash64("draw", "nth")).drop("nth")
    rows = tables.save(rows)
    by_source = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()  # one row a source
    docs_of = {r["source"]: r["n"] for r in by_source}
    plan = [
        (k, s, n, t, int(t // n) if n else 0, t / n - t // n if n else 0.0, docs_of[s])
        for k, (s, n, t) in enumerate(source_targets([(r["source"], r["size"]) for r in by_source], weights, most))
    ]
    sources = spark.createDataFrame(plan, "sid int, name string, source_size long, target double, whole long, p double, docs long")
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["name"]))
    extra = tables.save(_balanced(rows.filter("p > 0 AND size > 0").select("uid", "sid", "draw", "size", "p", "docs"), tables, block, seed))
    copies = F.col("whole") + F.coalesce("s", F.lit(0))
    return rows.join(extra.filter("s = 1").select("uid", "s"), "uid", "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), F.when(F.col("size") == 0, 1).otherwise(copies).cast("int").alias("copies"),
        *(F.col(f"_keep_{k}").alias(k) for k in keep),
    )


def _balanced(rows: DataFrame, tables: SharedTables, block: int, seed: int) -> DataFrame:
    """uid, s: 1 where a document gets its extra copy."""
    schema = T.StructType.fromDDL("uid long, sid int, draw long, size long, p double, docs long, last boolean, s int")

    def fly(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", "size"], kind="stable", ignore_index=True)
        x, p = pdf["size"].tolist(), pdf["p"].tolist()
        rng = random.Random(f"{seed} {key}")
        if pdf["last"].iloc[0]:
            q = land(flight(p, x, rng), x, sum(v * n for v, n in zip(p, x)))
        else:  # a few stay open, so that the last block has documents of many sizes to land with
            q = p[:RESERVE] + flight(p[RESERVE:], x[RESERVE:], rng)
        return pdf.assign(p=q, s=[int(v) if v in (0.0, 1.0) else -1 for v in q])[[f.name for f in schema]]

    decided, n = [], 0
    while True:
        blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / block))
        dealt = rows.select("uid", "sid", "draw", "size", "p", blocks.cast("long").alias("blocks")).withColumn("last", F.col("blocks") == 1)
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("draw", F.lit(n)), "blocks")).withColumn("docs", (2 + RESERVE) * F.col("blocks"))
        done = tables.save(dealt.groupBy("sid", "part").applyInPandas(fly, schema))
        decided.append(done.filter("s >= 0").select("uid", "s"))
        rows, n = done.filter("s < 0"), n + 1
        if rows.isEmpty():
            break
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return out
