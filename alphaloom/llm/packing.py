"""Best-fit packing with exact-complement hashing.

All that matters for the choice of combinations is how many pieces have each length, a table of at most `limit` rows
whatever the corpus. The driver plans on that table. An index holds, for each sum, how many available pairs of lengths
have it; it is kept as lengths run out. Taking the longest length first, its gap is looked up: a single of that length,
pairs of that sum, and triples, which are a single and a pair whose sums make the gap. Every combination that fills the
gap exactly is consumed as often as counts allow. What is left is packed best fit: each piece, longest first, goes where
the smallest sufficient room is left. Should best fit alone need fewer sequences, its plan is taken. The plan lists
combinations with multiplicities; pieces find their place by their rank among pieces of their length, and ranks are
counted in ranges, so a length that a third of all pieces share is spread over many tasks.

Defined results: null text is empty and gives the one id 0; rows that repeat a document are packed each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTables, placed_in_key

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


def cut_pieces(docs: DataFrame, limit: int = 2048, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Token pieces of at most `limit` ids; the first of a longer document takes what does not fill a sequence."""

    def run(batches):
        from .tokenizer import encoder

        enc, end = encoder(tokenizer), np.zeros(1, "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.id_bytes(text.as_py() or "") + end
                n = len(ids) // 4
                cuts = [0, *range(n % limit or min(limit, n), n + 1, limit)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


Plan = list[tuple[int, dict[int, int]]]


class SumIndex:
    """Available lengths, and for each sum the number of unordered pairs of available lengths that have it."""

    def __init__(self, counts: dict[int, int], limit: int):
        self.limit, self.c = limit, np.zeros(limit + 1, np.int64)
        for length, n in counts.items():
            self.c[length] = n
        self.pairs = np.zeros(2 * limit + 1, np.int64)
        once = self.c > 0
        for x in np.flatnonzero(once):
            self.pairs[x + np.flatnonzero(once[: x + 1])] += 1
            if self.c[x] < 2:
                self.pairs[2 * x] -= 1

    def take(self, need: dict[int, int], times: int) -> None:
        for x, k in need.items():
            before, after = int(self.c[x]), int(self.c[x]) - times * k
            if before >= 2 > after:
                self.pairs[2 * x] -= 1
            if after == 0:
                self.c[x] = 0
                self.pairs[x + np.flatnonzero(self.c)] -= 1
            self.c[x] = after

    def pairs_of(self, total: int) -> np.ndarray:
        """The smaller members of the available pairs of that sum, those available most often first."""
        if total < 2 or not self.pairs[total]:
            return np.zeros(0, int)
        x = np.arange(max(1, total - self.limit), total // 2 + 1)
        n = np.minimum(self.c[x], self.c[total - x])
        if total % 2 == 0:
            n[-1] = self.c[total // 2] // 2
        order = np.argsort(-n, kind="stable")
        return x[order[: np.count_nonzero(n)]]

    def complements(self, gap: int):
        """Single, pairs and triples that fill the gap, as the index stands when each is asked for."""
        if gap == 0:
            yield ()
            return
        if self.c[gap]:
            yield (gap,)
        for x in self.pairs_of(gap).tolist():
            yield (x, gap - x)
        for x in np.flatnonzero((self.c[:gap] > 0) & (self.pairs[gap:0:-1] > 0))[::-1].tolist():
            if 3 * x < gap:  # the largest of the three is the single
                break
            if self.c[x]:
                for y in self.pairs_of(gap - x).tolist():
                    if gap - x - y <= x:
                        yield (x, y, gap - x - y)


def exact_combinations(index: SumIndex) -> Plan:
    """Consumes combinations of up to four pieces that fill a sequence exactly, longest piece first."""
    plan: Plan = []
    for a in range(index.limit, 0, -1):
        if not index.c[a]:
            continue
        for rest in index.complements(index.limit - a):
            need: dict[int, int] = {}
            for x in (a, *rest):
                need[x] = need.get(x, 0) + 1
            times = min(int(index.c[x]) // k for x, k in need.items())
            if times:
                index.take(need, times)
                plan.append((times, need))
            if not index.c[a]:
                break
    return plan


def best_fit(counts: dict[int, int], limit: int) -> Plan:
    """Best-fit decreasing; sequences filled alike are carried as one, so the work follows lengths, not pieces."""
    open_: dict[int, list[tuple[int, tuple]]] = {limit: []}  # room left: (how many sequences, (filled before, length, pieces))
    for a in sorted(counts, reverse=True):
        left = counts[a]
        for room in sorted(r for r in open_ if a <= r < limit):
            each = room // a
            stay = []
            for n, filled in open_.pop(room):
                whole, more = (n, 0) if left >= n * each else divmod(left, each)
                left -= whole * each + more
                if whole:
                    open_.setdefault(room - each * a, []).append((whole, (filled, a, each)))
                if more:
                    open_.setdefault(room - more * a, []).append((1, (filled, a, more)))
                if n - whole - (more > 0):
                    stay.append((n - whole - (more > 0), filled))
            if stay:
                open_.setdefault(room, []).extend(stay)
            if not left:
                break
        each = limit // a
        whole, more = divmod(left, each)
        if whole:
            open_.setdefault(limit - each * a, []).append((whole, ((), a, each)))
        if more:
            open_.setdefault(limit - more * a, []).append((1, ((), a, more)))
    plan: Plan = []
    for own in open_.values():
        for n, filled in own:
            need: dict[int, int] = {}
            while filled:
                filled, a, k = filled
                need[a] = need.get(a, 0) + k
            plan.append((n, need))
    return plan


def plan_combinations(counts: dict[int, int], limit: int = 2048) -> Plan:
    """(times, {length: pieces of it}) for all pieces, given how many pieces have each length."""
    counts = {x: n for x, n in counts.items() if n}
    index = SumIndex(counts, limit)
    exact = exact_combinations(index)
    exact += best_fit({x: int(index.c[x]) for x in np.flatnonzero(index.c).tolist()}, limit)
    alone = best_fit(counts, limit)
    return min(exact, alone, key=lambda plan: sum(n for n, _ in plan))


def _slots(plan: list[tuple[int, dict[int, int]]]) -> dict[str, np.ndarray]:
    """For each length and run of ranks: where the pieces go. At most a few combinations for each length end it."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, need in plan:
        offset = 0
        for x, k in sorted(need.items(), reverse=True):
            rows.append((x, used.get(x, 0), k, sequence, offset))
            used[x] = used.get(x, 0) + times * k
            offset += x * k
        sequence += times
    cols = np.array(sorted(rows) or np.zeros((0, 5)), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), cols))


def pack(docs: DataFrame, limit: int = 2048, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """One row per piece, with its sequence and the offset there."""
    spark = docs.sparkSession
    tables = SharedTables(spark, "pack")
    pieces = tables.save(cut_pieces(docs, limit, tokenizer))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `limit` rows
    slots = _slots(plan_combinations(counts, limit))
    ranked = placed_in_key(pieces, ["length"], ["doc_id", "piece", "ids_crc32", "start"], tables)

    def place(batches):
        key = slots["length"] * (1 << 44) + slots["first"]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            s = np.searchsorted(key, length * (1 << 44) + rank, side="right") - 1
            nth, each = rank - slots["first"][s], slots["each"][s]
            sequence = slots["sequence"][s] + nth // each
            offset = slots["offset"][s] + nth % each * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [x.split()[0] for x in PLACED.split(", ")])

    return ranked.mapInArrow(place, PLACED)
