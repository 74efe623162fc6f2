"""Pieces shared by the training-data operators: shared tables, word hashing, Arrow rows."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The whitespace that separates words, in one character class, for Java and Python patterns alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where the setting is absent and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class SharedTables:
    """Parquet tables in the shared folder; they cut lineage, outlive lost executors and go when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.release)

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._shared_path = path
        return out

    def _delete(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        self._delete(df._shared_path)

    def release(self) -> None:
        """Delete all tables: results that read them are no longer of use."""
        with contextlib.suppress(Exception):  # at the driver's end the gateway may be gone, and the folder with it
            self._delete(self.root)


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], by: str, how: str = "inner", least: int = 4096) -> DataFrame:
    """big joined with small (unique keys): keys that hold many rows of big are dealt over many tasks by a hash of `by`.

    big is a saved table. A key is hot beyond a 2000th of its rows, so at most 2000 hot keys are broadcast. Null keys match nothing.
    """
    limit = max(least, big.count() // 2000)
    hot = F.broadcast(big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts")))
    dealt = big.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    copies = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return dealt.join(copies, [*keys, "_salt"], how).drop("_salt")


def placed_in_key(rows: DataFrame, keys: list[str], order: list[str], tables: SharedTables) -> DataFrame:
    """rows with `nth`, the place from 0 within their key by `order`; a key of any size is spread over many tasks.

    The rows are dealt by ranges of (key, order) and numbered within each range. Only the key that a range begins in the
    middle of has rows in earlier ranges, so the table of starts has at most one row a range.
    """
    dealt = tables.save(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_at"), F.sum("_n").over(before).alias("_start")).filter("_start > 0")
    same = F.col("_part") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    own = Window.partitionBy(*keys, "_part").orderBy(*order)
    numbered = dealt.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(starts), same, "left")
    return numbered.withColumn("nth", (F.col("_own") + F.coalesce("_start", F.lit(0))).cast("long")).select(*rows.columns, "nth")


def maybe_among(rows: DataFrame, keys: list[str], members: DataFrame, bits: int = 24) -> DataFrame:
    """rows with `_maybe`: false where the keys are surely not among those of members, true elsewhere.

    A bitmap of 2 ** bits bits is broadcast, 2 MB by default, as a table of one row per 32,768 bits. Beyond its capacity more
    rows are marked true; none of members' is ever marked false.
    """
    spot = F.pmod(F.xxhash64(*keys), F.lit(1 << bits)) + 1
    table = members.select(spot.alias("_spot")).groupBy(F.expr("bitmap_bucket_number(_spot)").alias("_bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_spot))").alias("_bits"))
    held = rows.withColumn("_spot", spot).join(F.broadcast(table), F.expr("bitmap_bucket_number(_spot)") == F.col("_bucket"), "left")
    byte = "cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_spot) div 8 as int) + 1, 1)), 16, 10) as int)"
    bit = F.expr(f"{byte} & shiftleft(1, cast(bitmap_bit_position(_spot) % 8 as int)) <> 0")
    return held.withColumn("_maybe", F.coalesce(bit, F.lit(False))).drop("_spot", "_bucket", "_bits")


def bucket_of(id_col: Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo `modulus`; null ids count as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


# ---------------------------------------------------------------- word hashes

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 21), base, np.uint64)
        steps[0] = 1
        _powers[kind] = have = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the number of words of each text.

    A word's hash is a polynomial in its bytes, from prefix sums over one buffer: no loop over words.
    """
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = _IS_SPACE[buf]
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    starts = np.flatnonzero(~space[1:] & space[:-1]) + 1
    if not space[0]:
        starts = np.concatenate([[0], starts])
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * _power("up", _ODD, len(buf)), out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * _power("down", _INV, len(buf))[starts])
    limits = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, limits)
    return hashes, np.diff(np.concatenate([[0], upto]))


def text_chunks(texts, limit: int = 1 << 20):
    """Indices of consecutive texts (an Arrow column) holding about `limit` bytes together, with their UTF-8 bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t.as_py() or "").encode("utf-8", "surrogatepass")
        held.append(b)
        size += len(b)
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit fingerprints of the word n-grams of each text.

    A text of fewer words has one shingle, of all its words; a text without words has none.
    """
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    grams = np.zeros(max(n - words + 1, 0), np.uint64)
    for j in range(words):
        grams = grams * _ODD + hashes[j : n - words + 1 + j] if n >= words else grams
    grams = mix64(grams)
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(np.unique(grams[at : at + c - words + 1]))
        elif c:
            h = np.uint64(c)
            with np.errstate(over="ignore"):
                for w in hashes[at : at + c]:
                    h = h * _ODD + w
            out.append(mix64(np.array([h], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
