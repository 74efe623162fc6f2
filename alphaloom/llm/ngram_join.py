"""N-gram Jaccard self-join by a MinHash LSH forest.

A document is the set of its five-word shingles, as 64-bit fingerprints: "exact" below means exact on these. Documents
with equal sets form a class and are joined as one. Each tree of the forest is a sorted trie: its labels, the min-hashes
of a class in the tree's order, lie sorted in one table, so the classes below a node are neighbours there, and a node of
any depth is a run of equal prefixes. Runs are counted where they lie; only runs of two or more, and those that a batch
of rows cuts, are summed over the table.

Matching begins at the deepest prefixes. Two figures decide whether all prefixes are shortened by one: the recall
estimated from the similarities of all pairs found so far (each counts one over the probability that it is met at the
present depth), and the recall measured on a seeded sample of documents that are compared with all others by brute
force. Only candidates new at a depth are verified. At the last depth, one min-hash, a pair of similarity 0.8 is missed
with probability 0.2 ** 24.

Candidates of a node are verified in blocks; a node of more than `block` classes or `weight` shingles is dealt into chunks
and each pair of chunks is a group of its own, so no group is unbounded, however many or long the texts, no pair is emitted
as a row, and none is lost. A pair that
meets in several trees is counted in the first of them. Nodes with the same members in several trees are verified once.
Texts travel once, and only those that a fixed-size bitmap of the candidates lets pass.

Bounds (parameters): the sample of `audit` documents, of texts of at most a million characters; the bitmap of 2 ** 24
bits, beyond whose capacity more texts travel and none is lost.

Defined results: a text of fewer than five words has one shingle of all its words; a text without words (null, empty)
links with nothing and is its own class; rows that repeat a doc_id are documents of their own, with the same or other
text; `kept` marks one row of each class, that of the smallest doc_id (of rows with that doc_id one of the text with
the smallest fingerprint; all rows equal in both are marked); rows without doc_id are left out of the join and get null
class, no links, and are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, maybe_among, mix64, shingle_sets, spread_join, text_chunks
from .graph import components, smallest

TREES, DEPTH = 24, 6
_RNG = np.random.default_rng(7)
_MUL = (_RNG.integers(1, 1 << 31, TREES * DEPTH, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)
#: Similarities are counted in this many steps from 0 to 1.
STEPS = 200
#: Bytes of shingles that a batch on its way to the blocks holds, beyond those of one class.
SHIPPED = 1 << 24


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hashes of each non-empty set, one row a set."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), TREES * DEPTH), np.uint32)
    for k in range(TREES * DEPTH):
        out[:, k] = np.minimum.reduceat((low ^ _ADD[k]) * _MUL[k], starts)
    return out


def shared_prefix(sig: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """For each pair of rows: do they share the prefix of that depth in that tree?"""
    own = np.ascontiguousarray(sig.reshape(len(sig), TREES, DEPTH)[:, tree, :depth])
    _, node = np.unique(own.view(f"V{4 * depth}").ravel(), return_inverse=True)
    return node[:, None] == node[None, :]


def met(similarity, depth: int):
    """Probability that a pair of that similarity shares a prefix of that depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def estimated_recall(pairs: np.ndarray, depth: int) -> float:
    """The share of all links that is found at a depth, from the number of pairs found in each step of similarity."""
    if not pairs.sum():
        return 1.0
    return float(pairs.sum() / (pairs / met((np.arange(STEPS + 1)) / STEPS, depth).clip(1e-12)).sum())


def _describe(sample: list[tuple[int, int, np.ndarray]], threshold: float):
    """Digests of the shingle set, min-hashes, and the sampled documents that a text links to."""
    owner = np.repeat(np.arange(len(sample)), [len(s) for _, _, s in sample])
    known = np.concatenate([s for _, _, s in sample]) if sample else np.zeros(0, np.uint64)
    order = np.argsort(known, kind="stable")
    owner, known = owner[order], known[order]
    sizes = np.array([len(s) for _, _, s in sample])

    def linked(s: np.ndarray) -> list[int]:
        low, high = np.searchsorted(known, s, "left"), np.searchsorted(known, s, "right")
        on = high > low
        if not on.any():
            return []
        low, high = low[on], high[on]
        hits = owner[np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist())])]
        both = np.bincount(hits, minlength=len(sample))
        return np.flatnonzero(both >= threshold * (sizes + len(s) - both) - 1e-9).tolist()

    def run(batches):
        for batch in batches:
            for first, held in text_chunks(batch.column(1)):
                sets = shingle_sets(held)
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full]) if full else None
                cols: list[list] = [[None] * len(sets) for _ in range(5)]
                for row, i in enumerate(full):
                    s = sets[i]
                    cols[0][i] = int(np.bitwise_xor.reduce(mix64(s)).astype(np.int64))
                    cols[1][i] = int((mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))
                    cols[2][i] = sig[row].tobytes()
                    cols[3][i] = linked(s) if sample else []
                    cols[4][i] = len(s)
                own = batch.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.int32())], ["doc_id", "print", "set_a", "set_b", "sig", "audited", "size"])

    return run


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as an Arrow column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _labels(batches):
    """One label a tree: the number of the tree and its min-hashes, in bytes that sort as they do."""
    for batch in batches:
        for at in range(0, len(batch), 4096):
            own = batch.slice(at, 4096)
            sig = np.frombuffer(b"".join(own.column(1).to_pylist()), np.uint32).astype(">u4")
            label = np.empty((len(own), TREES, 1 + 4 * DEPTH), np.uint8)
            label[:, :, 0] = np.arange(TREES)
            label[:, :, 1:] = sig.view(np.uint8).reshape(len(own), TREES, 4 * DEPTH)
            yield pa.RecordBatch.from_arrays([_binary(label.reshape(-1, 1 + 4 * DEPTH)), *(pa.array(np.repeat(own.column(c).to_numpy(), TREES)) for c in (0, 2))], ["label", "rep", "size"])


def _runs(column: pa.Array, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefixes of sorted labels, and where each run of equal ones starts."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)[:, : 1 + 4 * depth]
    return rows, np.concatenate([[0], np.flatnonzero((rows[1:] != rows[:-1]).any(1)) + 1])


def _nodes(depth: int):
    """Runs of two or more classes, and those at the ends of a batch, with their shingles and digests of their members."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows, starts = _runs(batch.column(0), depth)
            n = np.diff(np.append(starts, len(rows)))
            rep = batch.column(1).to_numpy().astype(np.uint64)
            size = np.add.reduceat(batch.column(2).to_numpy().astype(np.int64), starts)
            a, b = (np.bitwise_xor.reduceat(mix64(rep * np.uint64(2) + np.uint64(k)), starts).astype(np.int64) for k in (0, 1))
            on = n > 1
            on[[0, -1]] = True
            yield pa.RecordBatch.from_arrays([_binary(rows[starts[on]]), *(pa.array(x[on]) for x in (n.astype(np.int64), size, a, b))], ["node", "n", "size", "fa", "fb"])

    return run


def _members(depth: int):
    """The classes of those runs."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            rows, starts = _runs(batch.column(0), depth)
            n = np.diff(np.append(starts, len(rows)))
            on = n > 1
            on[[0, -1]] = True
            on = np.repeat(on, n)
            yield pa.RecordBatch.from_arrays([_binary(rows[on]), batch.column(1).filter(pa.array(on))], ["node", "rep"])

    return run


def _ship(batches):
    """One row per block of a class: the shingles travel once for each block the class is in, about SHIPPED bytes in a batch."""
    for batch in batches:
        held, blocks = batch.column(1), batch.column(2).to_pylist()
        for i in range(len(batch)):
            (shingles,) = shingle_sets([held[i].as_py().encode("utf-8", "surrogatepass")])
            step = max(1, SHIPPED // (shingles.nbytes + 1))
            for at in range(0, len(blocks[i]), step):
                own = blocks[i][at : at + step]
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["node"] for b in own], pa.binary()), *(pa.array([b[c] for b in own], pa.int32()) for c in ("i", "j", "chunk")),
                     pa.array([batch.column(0)[i].as_py()] * n, pa.int64()), pa.array([batch.column(3)[i].as_py()] * n, pa.int64()), pa.array([batch.column(4)[i].as_py()] * n, pa.binary()), pa.array([shingles.tobytes()] * n, pa.binary())],
                    ["node", "i", "j", "chunk", "rep", "copies", "sig", "shingles"],
                )


def _common(sets: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, through an incidence matrix in column blocks."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[at] > 1
    owner, at = owner[keep], (np.cumsum(times > 1) - 1)[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((n, n), np.float32)
    for c in range(0, int(at[-1]) + 1 if len(at) else 0, columns):
        lo, hi = np.searchsorted(at, [c, c + columns])
        m = np.zeros((n, columns), np.float32)
        m[owner[lo:hi], at[lo:hi] - c] = 1
        out += m @ m.T
    return out.astype(np.int64)


def _verify(depth: int, above: int | None, threshold: float):
    """Links of each class within a block: copies linked, the root of its links, and pairs by similarity in the first row."""

    def run(table: pa.Table) -> pa.Table:
        tree, i, j = table["node"][0].as_py()[0], table["i"][0].as_py(), table["j"][0].as_py()
        rep, copies, chunk = (table[c].to_numpy() for c in ("rep", "copies", "chunk"))
        sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(len(rep), -1)
        n = len(rep)
        ok = np.triu(np.ones((n, n), bool), 1)
        if i != j:
            ok &= chunk[:, None] != chunk[None, :]
        size = np.array([len(s) for s in sets])
        ok &= np.minimum.outer(size, size) >= threshold * np.maximum.outer(size, size) - 1e-9
        for t in range(tree):  # the pair is counted in the first tree in which it meets
            ok &= ~shared_prefix(sig, t, depth)
        if above is not None:  # and at the first depth
            for t in range(TREES):
                ok &= ~shared_prefix(sig, t, above)
        if not ok.any():
            return _EMPTY
        inter = _common(sets)
        union = size[:, None] + size[None, :] - inter
        a, b = np.nonzero(ok & (inter >= threshold * union - 1e-9))
        if len(a) == 0:
            return _EMPTY
        steps = np.bincount((inter[a, b] * STEPS // union[a, b]).astype(int), minlength=STEPS + 1)
        links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        parent = np.arange(n)
        while True:  # labels fall to the smallest index of their component
            new = parent.copy()
            np.minimum.at(new, a, parent[b])
            np.minimum.at(new, b, parent[a])
            new = new[new]
            if (new == parent).all():
                break
            parent = new
        on = np.flatnonzero(links > 0)
        return pa.table([pa.array(rep[on]), pa.array(links[on].astype(np.int64)), pa.array(rep[parent[on]]), pa.array([steps.tolist()] + [None] * (len(on) - 1), pa.list_(pa.int64()))], names=_LINKS)

    return run


_LINKS = ["rep", "links", "root", "steps"]
_LINK_SCHEMA = "rep long, links long, root long, steps array<long>"
_EMPTY = pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))], names=_LINKS)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, target: float = 0.9995, block: int = 512, weight: int = 1 << 20, audit: int = 128, seed: int = 3) -> DataFrame:
    """doc_id, class_id (smallest doc_id reachable by links), n_links (other documents linked), kept, print (of the text): one row per input row."""
    spark = docs.sparkSession
    tables = SharedTables(spark, "forest")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("print", F.xxhash64("text"))
    drawn = F.pmod(F.xxhash64("doc_id", "print", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, audit / max(docs.count(), 1)) * (1 << 30))
    few = texts.filter(drawn & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= 1_000_000)).limit(4 * audit).collect()
    sample = [(r["doc_id"], r["print"], s) for r in few if len(s := shingle_sets([r["text"].encode("utf-8", "surrogatepass")])[0])]
    described = tables.save(texts.mapInArrow(_describe(sample, threshold), "doc_id long, print long, set_a long, set_b long, sig binary, audited array<int>, size int"))
    shown = described.filter("doc_id IS NOT NULL AND sig IS NOT NULL")
    audited = shown.select(F.explode("audited").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a sampled document
    truth = {sample[r["k"]][:2]: r["n"] - 1 for r in audited}
    head = F.min(F.struct("doc_id", "print", "sig")).alias("head")  # taken before the shuffle, so a group of equal sets is no hot key
    classes = shown.groupBy("set_a", "set_b").agg(head, F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"))
    classes = tables.save(classes.select(F.monotonically_increasing_id().alias("rep"), "set_a", "set_b", "head.*", "copies", "size"))
    trie = tables.save(classes.select("rep", "sig", "size").mapInArrow(_labels, "label binary, rep long, size int").repartitionByRange("label").sortWithinPartitions("label"))

    found: list[DataFrame] = []
    pairs = np.zeros(STEPS + 1, np.int64)
    above = None
    for depth in range(DEPTH, 0, -1):
        new = tables.save(_match(texts, classes, trie, depth, above, threshold, block, weight, tables))
        found.append(new)
        for r in new.filter("steps IS NOT NULL").select(F.posexplode("steps").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():  # one row a step
            pairs[r["at"]] += r["n"]
        if estimated_recall(pairs, depth) >= target and met(threshold, depth) >= 0.995 and measured_recall(truth, classes, shown, found) >= target:
            break
        above = depth
    links = found[0]
    for f in found[1:]:
        links = links.unionByName(f)
    labels = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b")), tables)
    firsts = smallest(labels, classes.select(F.col("rep").alias("node"), F.struct("doc_id", "print").alias("id")), tables).withColumnRenamed("node", "rep")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.join(counts, "rep", "left").join(firsts, "rep", "left")
    of_class = tables.save(
        of_class.select("set_a", "set_b", F.coalesce("component_id.doc_id", "doc_id").alias("class_id"), F.coalesce("component_id.print", "print").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    lone = "doc_id IS NULL OR sig IS NULL"
    members = tables.save(shown.select("doc_id", "print", "set_a", "set_b"))
    met_ = spread_join(members, of_class, ["set_a", "set_b"], "print").select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), ((F.col("doc_id") == F.col("class_id")) & (F.col("print") == F.col("first"))).alias("kept"), "print")
    return met_.unionByName(described.filter(lone).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"), "print"))


def measured_recall(truth: dict[tuple[int, int], int], classes: DataFrame, shown: DataFrame, found: list[DataFrame]) -> float:
    """The share of sampled documents with links for which all of them are found."""
    wanted = {k: n for k, n in truth.items() if n}
    if not wanted:
        return 1.0
    spark = classes.sparkSession
    few = F.broadcast(spark.createDataFrame(list(wanted), "doc_id long, print long"))  # at most the sample
    own = shown.join(few, ["doc_id", "print"]).select("doc_id", "print", "set_a", "set_b").distinct()
    own = classes.select("rep", "set_a", "set_b", "copies").join(F.broadcast(own), ["set_a", "set_b"])
    got = {(r["doc_id"], r["print"]): [r["rep"], r["copies"] - 1] for r in own.collect()}
    reps = {r for r, _ in got.values()}
    links: dict[int, int] = {}
    for f in found:
        for r in f.filter(F.col("rep").isin(list(reps))).groupBy("rep").agg(F.sum("links").alias("n")).collect():
            links[r["rep"]] = links.get(r["rep"], 0) + r["n"]
    return sum(got[k][1] + links.get(got[k][0], 0) >= n for k, n in wanted.items()) / len(wanted)


def _match(texts: DataFrame, classes: DataFrame, trie: DataFrame, depth: int, above: int | None, threshold: float, block: int, weight: int, tables: SharedTables) -> DataFrame:
    """Verified links among classes that share a prefix of `depth` in some tree, and none of depth `above`."""
    runs = trie.mapInArrow(_nodes(depth), "node binary, n long, size long, fa long, fb long")
    nodes = runs.groupBy("node").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.bit_xor("fa").alias("fa"), F.bit_xor("fb").alias("fb")).filter("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") / block, F.col("size") / weight)).cast("int").alias("chunks")
    once = tables.save(nodes.groupBy("n", "size", "fa", "fb").agg(F.min("node").alias("node")).select("node", chunks))
    runs_of = tables.save(trie.select("label", "rep").mapInArrow(_members(depth), "node binary, rep long"))
    members = spread_join(runs_of, once, ["node"], "rep").withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    spot = F.struct("node", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk")
    blocks = members.groupBy("rep").agg(F.collect_list(spot).alias("blocks"))  # at most one node a tree
    places = tables.save(blocks.join(classes.select("rep", "doc_id", "print", "copies", "sig"), "rep"))
    tables.drop(runs_of)
    # Rows equal in doc_id and text become one before the shuffle, so that they are no hot key.
    once_each = maybe_among(texts.filter("doc_id IS NOT NULL"), ["doc_id", "print"], places).filter("_maybe").groupBy("doc_id", "print").agg(F.first("text").alias("text"))
    full = once_each.join(places, ["doc_id", "print"]).select("rep", "text", "blocks", "copies", "sig")
    shipped = full.mapInArrow(_ship, "node binary, i int, j int, chunk int, rep long, copies long, sig binary, shingles binary")
    return shipped.groupBy("node", "i", "j").applyInArrow(_verify(depth, above, threshold), _LINK_SCHEMA)
