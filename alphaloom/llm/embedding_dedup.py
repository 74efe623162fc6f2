"""Near-duplicate embeddings by NN-descent.

A forest of random hyperplanes gives every vector a first list of neighbours. Then, round by round, the vectors around
each vector (its neighbours and those that list it) are compared with each other, and each keeps the nearest it has met,
until few lists change. Edges of at least the threshold are kept. Lists that are saturated, all of whose members pass
the threshold, are enlarged: the connected component of kept edges takes the place of the list, and its members are
compared exactly in blocks, so links of a group of any size are counted without emitting its pairs. Equal vectors are
one weighted point. As a saturated list holds its own group alone, the saturated points then search again as units:
within the leaves of fresh hyperplane trees all pairs of different components are compared, and one link joins two
components. An audit compares the links of a seeded sample of vectors, drawn until enough of them have links, with brute
force; while the share of vectors with links that have all of them is below the target, rounds go on with longer lists
and other trees. Where the last round still misses it, all pairs of different
components are compared in blocks, which is exact and quadratic.

Distinct contents are the points of the graph, under keys of their own. Every cosine is taken in double precision. Bounds: in-lists are sampled to the list length within one round (other
entries meet in later rounds, in the components and under the audit); at most 15 times `audit` vectors are sampled, so
where less than about one vector in four times `audit` has links the audit may meet none and then passes.

Defined results: vectors that are null, zero, hold null or non-finite components, or have no id link with nothing;
vectors of different length are compared within their length only; every row is a vector of its own, so rows that repeat
a vec_id, with the same or other content, link like any others; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SharedTables, mix64, spread_join
from .graph import components, smallest

BLOCK = 512
#: Largest block of vectors that are compared with each other; in stripes of BLOCK rows.
EXACT_BLOCK = 4096


def unit(raw: list[bytes]) -> np.ndarray:
    """Rows of float64 components, scaled to length one."""
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _vectors(embeddings: DataFrame) -> DataFrame:
    """row, id and the components as bytes, null for vectors that cannot link."""

    def run(batches):
        for batch in batches:
            raw = []
            for i, v in zip(batch.column(1).to_pylist(), batch.column(2)):
                good = i is not None and v.is_valid and len(v) and not v.values.null_count
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if good else None
                raw.append(x.tobytes() if good and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], ["row", "id", "vec"])

    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "row long, id long, vec binary")


def _equal_vectors(rows: DataFrame, tables: SharedTables) -> DataFrame | None:
    """row, point (the first row of an equal vector), weight, for all rows that have equals; none if there are none."""
    hashed = rows.filter("vec IS NOT NULL").select("row", "vec", F.xxhash64("vec").alias("hash"))
    often = tables.save(hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"))
    if often.isEmpty():
        return None
    some = tables.save(hashed.join(often, "hash", "left_semi"))
    points = some.groupBy("hash", "vec").agg(F.min("row").alias("point"), F.count(F.lit(1)).alias("weight")).filter("weight > 1")
    return tables.save(spread_join(some, points, ["hash", "vec"], "row").select("row", "point", "weight"))


def _leaves(vectors: DataFrame, trees: int, bits: int, seed: int) -> DataFrame:
    """tree, leaf, draw, vec_id, vec: every vector in its leaf of each random hyperplane tree."""

    def keys(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw = batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                x = unit([raw[i] for i in at])
                planes = np.random.default_rng(seed).standard_normal((x.shape[1], trees * bits))
                side = (x @ planes > 0).reshape(len(at), trees, bits)
                leaf = (side * (1 << np.arange(bits))).sum(2) + (int(size) << 32)
                for t in range(trees):
                    draw = (mix64(ids[at].astype(np.uint64) + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) >> np.uint64(33)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(leaf[:, t]), pa.array(draw), batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], ["tree", "leaf", "draw", "vec_id", "vec"])

    return vectors.select("vec_id", "vec").mapInArrow(keys, "tree int, leaf long, draw long, vec_id long, vec binary")


def _first_lists(vectors: DataFrame, trees: int, bits: int, k: int, seed: int) -> DataFrame:
    """a, b, sim: nearest neighbours within the leaves of random hyperplane trees; large leaves are dealt at random."""

    def nearest(table: pa.Table) -> pa.Table:
        ids, x = table["vec_id"].to_numpy(), unit(table["vec"].to_pylist())
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        n = min(k, len(ids) - 1)
        if n < 1:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names=["a", "b", "sim"])
        top = np.argpartition(-sim, n - 1, axis=1)[:, :n]
        return pa.table([pa.array(np.repeat(ids, n)), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(sim, top, 1).ravel())], names=["a", "b", "sim"])

    dealt = _leaves(vectors, trees, bits, seed)
    parts = dealt.groupBy("tree", "leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    dealt = dealt.join(parts, ["tree", "leaf"]).withColumn("part", F.pmod("draw", "parts"))
    return dealt.groupBy("tree", "leaf", "part").applyInArrow(nearest, "a long, b long, sim double")


def _keep_nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each list; ties are broken by a hash of the pair, so no vector is everybody's choice."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    order = Window.partitionBy("a").orderBy(F.desc("sim"), F.xxhash64("a", "b"))
    return once.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= k)


def _refine(lists: DataFrame, vectors: DataFrame, k: int, turn: int) -> DataFrame:
    """One round: all pairs around each vector that would enter a list."""
    worst = lists.groupBy("a").agg(F.when(F.count(F.lit(1)) >= k, F.min("sim")).alias("worst"))
    turned = Window.partitionBy("b", F.pmod("a", F.lit(64))).orderBy(F.xxhash64("b", "a", F.lit(turn)))
    few = lists.withColumn("at", F.row_number().over(turned)).filter(F.col("at") <= k)  # first in parts, so that a hub is cut early
    again = Window.partitionBy("b").orderBy(F.xxhash64("b", "a", F.lit(turn)))
    reverse = few.withColumn("at", F.row_number().over(again)).filter(F.col("at") <= k).select(F.col("b").alias("v"), F.col("a").alias("u"))
    around = lists.select(F.col("a").alias("v"), F.col("b").alias("u")).union(reverse).distinct()
    known = vectors.join(worst, vectors["vec_id"] == worst["a"], "left").select(F.col("vec_id").alias("u"), "vec", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    gathered = around.join(known, "u").groupBy("v").agg(F.collect_list("u").alias("ids"), F.collect_list("vec").alias("vecs"), F.collect_list("worst").alias("worsts"))

    def meet(batches):
        for batch in batches:
            a, b, sims = [], [], []
            for r in range(len(batch)):
                ids = batch.column(0)[r].values.to_numpy()
                if len(ids) < 2:
                    continue
                x = unit(batch.column(1)[r].values.to_pylist())
                sim = x @ x.T
                np.fill_diagonal(sim, -3)
                i, j = np.nonzero(sim > batch.column(2)[r].values.to_numpy()[:, None])
                a.append(ids[i])
                b.append(ids[j])
                sims.append(sim[i, j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, sims)], ["a", "b", "sim"])

    return gathered.select("ids", "vecs", "worsts").mapInArrow(meet, "a long, b long, sim double")


def _bridges(points: DataFrame, labels: DataFrame, threshold: float, trees: int, bits: int, seed: int, block: int, tables: SharedTables) -> DataFrame:
    """a, b: links between different components; all such pairs within a leaf are compared, in blocks of bounded size.

    One component of more than a block has blocks of its own, which are not compared with each other. A pair of blocks
    gives a forest over its components, at most one link less than it has components. Zero bits make one leaf of all.
    """
    named = points.join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left").select("vec_id", "vec", F.coalesce("component", "vec_id").alias("component"))
    dealt = _leaves(named, trees, bits, seed).drop("draw").join(named.select("vec_id", "component"), "vec_id")
    sizes = dealt.groupBy("tree", "leaf", "component").agg(F.count(F.lit(1)).alias("n"))
    leaf = Window.partitionBy("tree", "leaf")
    small = F.ceil(F.sum(F.when(F.col("n") <= block, F.col("n"))).over(leaf) / block)
    sizes = sizes.withColumn("several", F.count(F.lit(1)).over(leaf) > 1).withColumn("parts", F.when(F.col("n") > block, F.ceil(F.col("n") / block)).otherwise(small).cast("int"))
    sizes = sizes.filter("several").withColumn("owner", F.when(F.col("n") > block, F.col("component")))
    hashed = F.when(F.col("owner").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("vec_id"))
    rows = tables.save(dealt.join(sizes.select("tree", "leaf", "component", "owner", "parts"), ["tree", "leaf", "component"]).withColumn("part", F.pmod(hashed, "parts").cast("int")))
    parts = tables.save(rows.select("tree", "leaf", "owner", "part").distinct())
    one, two = parts.withColumnsRenamed({"owner": "o1", "part": "p1"}), parts.withColumnsRenamed({"owner": "o2", "part": "p2"})
    key = lambda o, p: F.struct(F.coalesce(F.col(o), F.lit(-(1 << 63))), F.col(p))
    pairs = one.join(two, ["tree", "leaf"]).filter(key("o1", "p1") <= key("o2", "p2")).filter(F.col("o1").isNull() | F.col("o2").isNull() | (F.col("o1") != F.col("o2")))
    pairs = tables.save(pairs.withColumn("pair", F.monotonically_increasing_id()))
    first = pairs.select("tree", "leaf", F.col("o1").alias("o"), F.col("p1").alias("p"), "pair", F.lit(0).alias("side"))
    second = pairs.filter(~(F.col("o1").eqNullSafe(F.col("o2")) & (F.col("p1") == F.col("p2")))).select("tree", "leaf", F.col("o2").alias("o"), F.col("p2").alias("p"), "pair", F.lit(1).alias("side"))
    both = first.union(second).withColumnsRenamed({"tree": "t", "leaf": "l"})
    same = (rows["tree"] == both["t"]) & (rows["leaf"] == both["l"]) & rows["owner"].eqNullSafe(both["o"]) & (rows["part"] == both["p"])
    sent = rows.join(both, same).select("pair", "side", "vec_id", "component", "vec")

    def forest(table: pa.Table) -> pa.Table:
        side, ids = table["side"].to_numpy(), table["vec_id"].to_numpy()
        _, comp = np.unique(table["component"].to_numpy(), return_inverse=True)
        x = unit(table["vec"].to_pylist())
        at, to = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        to = to if len(to) else at
        root = np.arange(comp.max() + 1)

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        a, b = [], []
        for start in range(0, len(at), BLOCK):
            mine = at[start : start + BLOCK]
            i, j = np.nonzero((x[mine] @ x[to].T >= threshold) & (comp[mine][:, None] != comp[to][None, :]))
            i, j = mine[i], to[j]
            _, once = np.unique(comp[i] * len(root) + comp[j], return_index=True)
            for i, j in zip(i[once].tolist(), j[once].tolist()):
                c, d = find(int(comp[i])), find(int(comp[j]))
                if c != d:
                    root[c] = d
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    found = tables.save(sent.groupBy("pair").applyInArrow(forest, "a long, b long"))
    for t in (rows, parts, pairs):
        tables.drop(t)
    return found


def _count_links(vectors: DataFrame, labels: DataFrame, weights: DataFrame | None, threshold: float, tables: SharedTables) -> DataFrame:
    """vec_id, n_links: exact links to the rows of other points within each component, in blocks of bounded size.

    A component of n vectors is dealt into chunks of at least 512 and at most 4096, so a vector is sent n / 4096 times
    at most in components of 260,000 and more.
    """
    chunk = F.greatest(F.lit(BLOCK), F.least(F.lit(EXACT_BLOCK), F.sqrt("n") * 8))
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).select("component", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    named = tables.save(vectors.join(labels, vectors["vec_id"] == labels["node"]).drop("node"))
    rows = spread_join(named, tables.save(sizes), ["component"], "vec_id")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    if weights is not None:
        rows = rows.join(weights, "vec_id", "left")
    weight = F.lit(1) if weights is None else F.coalesce("weight", F.lit(1))
    rows = rows.select("component", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "vec_id", "vec", weight.cast("long").alias("weight"))

    def count(table: pa.Table) -> pa.Table:
        chunk, weight = table["chunk"].to_numpy(), table["weight"].to_numpy()
        x, whole = unit(table["vec"].to_pylist()), table["i"][0] == table["j"][0]
        n = np.zeros(len(x), np.int64)
        for at in range(0, len(x), BLOCK):
            mine = np.arange(at, min(at + BLOCK, len(x)))
            linked = x[mine] @ x.T >= threshold
            if not whole:
                linked &= chunk[mine][:, None] != chunk[None, :]
            linked[np.arange(len(mine)), mine] = False
            n[mine] = linked @ weight
        return pa.table([table["vec_id"], pa.array(n)], names=["vec_id", "n"])

    return rows.groupBy("component", "i", "j").applyInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n_links"))


def _audit(vectors: DataFrame, threshold: float, audit: int, total: int, linked: int = 64) -> list[tuple[int, int]]:
    """True number of links of about `audit` seeded vectors, and of more until `linked` of them have links."""
    out, low, size = [], 0, audit
    while low < 1 << 20 and size <= 8 * audit and sum(n > 0 for _, n in out) < linked:
        high = min(1 << 20, low + int(min(1.0, size / max(total, 1)) * (1 << 20)) + 1)
        draw = F.pmod(F.xxhash64("vec_id", F.lit(99)), F.lit(1 << 20))
        out += _true_links(vectors, vectors.filter((draw >= low) & (draw < high)), threshold)
        low, size = high, 2 * size
    return out


def _recall(truth: dict[int, int], found: dict[int, int]) -> float:
    """The share of vectors, among those with links, whose links are all found."""
    whole = [found.get(v, 0) >= n for v, n in truth.items() if n]
    return sum(whole) / len(whole) if whole else 1.0


def _true_links(vectors: DataFrame, few: DataFrame, threshold: float) -> list[tuple[int, int]]:
    """vec_id and true number of links of a few vectors, by brute force over all rows."""
    sample = few.collect()
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(r["vec"]) for r in sample}:
        own = [r for r in sample if len(r["vec"]) == size]
        by_size[size] = np.array([r["vec_id"] for r in own]), unit([bytes(r["vec"]) for r in own])

    def run(batches):
        found: dict[int, int] = {}
        for batch in batches:
            ids, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size, (q, x) in by_size.items():
                at = np.flatnonzero(sizes == size)
                if len(at):
                    sim = x @ unit([raw[i] for i in at]).T
                    sim[q[:, None] == ids[at][None, :]] = -2
                    for v, n in zip(q.tolist(), (sim >= threshold).sum(1).tolist()):
                        found[v] = found.get(v, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["vec_id", "n"])

    rows = vectors.mapInArrow(run, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n")).collect()
    return [(r["vec_id"], r["n"]) for r in rows]


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, k: int = 10, trees: int = 8, target: float = 0.97, rounds: int = 6, audit: int = 256, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per input row."""
    spark = embeddings.sparkSession
    tables = SharedTables(spark, "descent")
    rows = tables.save(_vectors(embeddings))
    vectors = rows.filter("vec IS NOT NULL").select(F.col("row").alias("vec_id"), "vec")
    total = vectors.count()
    truth = dict(_audit(vectors, threshold, audit, total)) if total else {}
    equal = _equal_vectors(rows, tables)
    weights = None
    if equal is not None:
        equal = equal.withColumnRenamed("row", "vec_id")
        vectors = tables.save(vectors.join(equal.filter("vec_id <> point"), "vec_id", "left_anti"))
        total = vectors.count()
        weights = equal.filter("vec_id = point").select("vec_id", "weight")
    bits = lambda n: max(1, int(np.ceil(np.log2(max(n, 2) / 64))))
    lists = tables.save(_keep_nearest(_first_lists(vectors, trees, bits(total), k, seed), k))
    known = None  # links that joined components in earlier rounds
    links = labels = None

    def count(labels: DataFrame) -> DataFrame:
        """vec_id, n_links of all vectors that link."""
        found = _count_links(vectors, labels, weights, threshold, tables)
        if equal is None:
            return tables.save(found)
        own = spread_join(equal, found.withColumnRenamed("vec_id", "point"), ["point"], "vec_id", "left").select("vec_id", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
        return tables.save(found.join(equal, "vec_id", "left_anti").unionByName(own))

    def joined(labels: DataFrame, more: DataFrame) -> DataFrame:
        return components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), tables)

    def passes(links: DataFrame) -> bool:
        found = {r["vec_id"]: r["n_links"] for r in links.filter(F.col("vec_id").isin(list(truth))).collect()} if truth else {}
        return _recall(truth, found) >= target

    done = not total
    for n in range(1, rounds + 1 if total else 1):
        fresh = tables.save(_refine(lists, vectors, k, n))
        both = lists.select("a", "b", "sim", F.lit(False).alias("new")).union(fresh.select("a", "b", "sim", F.lit(True)))
        new = tables.save(_keep_nearest(both.groupBy("a", "b").agg(F.max("sim").alias("sim")), k))
        changed = new.join(lists, ["a", "b"], "left_anti").filter(F.col("sim") >= threshold - 0.1).count()
        tables.drop(fresh)
        tables.drop(lists)
        lists = new
        if changed > 0.001 * total and n < rounds and n % 2:
            continue
        if labels is not None:
            tables.drop(labels)
            tables.drop(links)
        edges = lists.filter(F.col("sim") >= threshold).select("a", "b")
        labels = components(edges if known is None else edges.union(known), tables)
        full = tables.save(lists.groupBy("a").agg(F.min("sim").alias("worst"), F.count(F.lit(1)).alias("n")).filter((F.col("worst") >= threshold) & (F.col("n") >= k)).select(F.col("a").alias("vec_id")))
        if not full.isEmpty():
            more = _bridges(vectors.join(full, "vec_id", "left_semi"), labels, threshold, trees, bits(full.count()), seed + n, BLOCK, tables)
            if not more.isEmpty():
                known = more if known is None else known.union(more)
                labels = joined(labels, more)
        links = count(labels)
        done = passes(links)
        if done:
            break
        k *= 2
    if not done:  # the exact pass
        more = _bridges(vectors, labels, threshold, 1, 0, seed, EXACT_BLOCK, tables)
        labels = joined(labels, more)
        links = count(labels)
    if labels is None:
        labels, links = spark.createDataFrame([], "node long, component long"), spark.createDataFrame([], "vec_id long, n_links long")
    if equal is not None:
        others = spread_join(equal.filter("vec_id <> point"), labels.withColumnRenamed("node", "point"), ["point"], "vec_id", "left").select(F.col("vec_id").alias("node"), F.coalesce("component", "point").alias("component"))
        alone = equal.filter("vec_id = point").select(F.col("vec_id").alias("node")).join(labels, "node", "left_anti").withColumn("component", F.col("node"))
        labels = tables.save(labels.unionByName(others).unionByName(alone))
    named = smallest(labels, rows.select(F.col("row").alias("node"), "id"), tables)
    out = rows.select("row", "id").join(links.withColumnRenamed("vec_id", "row"), "row", "left").join(named.withColumnRenamed("node", "row"), "row", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
