"""Exact dedup by MSD radix partitioning: documents are split by successive byte runs of their text.

A round groups the documents still undecided by (group, next run of bytes). A group is done when one document is
left in it or when its texts have ended; equality is therefore that of the bytes, and no digest decides it. The run
grows from round to round, so a text of n bytes takes about log(n) rounds, and only texts that share a whole prefix
with another text are carried on.

Defined results: null text is the empty text; the row with the smallest doc_id stays (null doc_ids last; among
rows that repeat a doc_id one stays); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SharedTables, maybe_among, spread_join


def normalised(text):
    """The text with each run of blanks as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _split(rows: DataFrame, keys: list[str], width: int, total: int, tables: SharedTables, keep: tuple[str, ...]) -> DataFrame:
    """One round. Rows get the group they are in after the next `width` bytes: `gid`, null where they are alone.

    Groups beyond a 2000th of all rows, at most 2000 of them, are broadcast, so that their rows are dealt over many tasks. A
    bitmap of the groups keeps rows that are surely alone out of the shuffle; a group is met by its bytes, never by a hash.
    """
    rows = rows.withColumn("digit", F.substring("rest", 1, width))
    limit = max(4096, total // 2000)
    groups = tables.save(rows.groupBy(*keys, "digit").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("new_gid")).filter("n > 1").withColumn("salts", F.ceil(F.col("n") / limit).cast("int")).drop("n"))
    hot = F.broadcast(groups.filter("salts > 1").drop("new_gid"))
    marked = maybe_among(rows, [*keys, "digit"], groups)
    lone = marked.filter("NOT _maybe").select("uid", "doc_id", "text_sha256", *keep, F.lit(None).cast("long").alias("gid"), F.lit(False).alias("active"), F.lit(None).cast("binary").alias("rest"))
    rows = marked.filter("_maybe").join(hot, [*keys, "digit"], "left").withColumn("salt", F.pmod(F.xxhash64("uid"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    joined = rows.join(groups, [*keys, "digit", "salt"], "left")
    ended = F.octet_length("digit") < width
    return tables.save(
        lone.unionByName(joined.select(
            "uid", "doc_id", "text_sha256", *keep, F.col("new_gid").alias("gid"),
            (F.col("new_gid").isNotNull() & ~ended).alias("active"),
            F.when(F.col("new_gid").isNotNull() & ~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        ))
    )


def exact_groups(docs: DataFrame, first_width: int = 64, factor: int = 8, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, `keep`: one row per input row."""
    tables = SharedTables(docs.sparkSession, "exact")
    own = [f"_keep_{k}" for k in keep]
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"), *(F.col(k).alias(c) for k, c in zip(keep, own))).select(
        F.monotonically_increasing_id().alias("uid"), "doc_id", F.sha2("norm", 256).alias("text_sha256"), F.encode("norm", "UTF-8").alias("rest"), *own
    )
    width, rounds, keys, total = first_width, [], [], docs.count()
    while True:
        done = _split(rows, keys, width, total, tables, tuple(own))
        rounds.append(done)
        rows, keys, width = done.filter("active").drop("active"), ["gid"], width * factor
        if rows.isEmpty():
            break
    alone = [r.filter("gid IS NULL") for r in rounds]
    met = [r.filter("gid IS NOT NULL AND NOT active") for r in rounds]

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.select("uid", "doc_id", "text_sha256", *own, "gid")

    members = tables.save(union(met))
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "uid")
    heads = tables.save(members.groupBy("gid").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("group_size")))
    grouped = spread_join(members, heads, ["gid"], "uid").select(
        "doc_id", F.col("head.doc_id").alias("keep_id"), "group_size", (F.col("head.uid") == F.col("uid")).alias("kept"), "text_sha256", *own
    )
    single = union(alone).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *own)
    return single.unionByName(grouped).withColumnsRenamed(dict(zip(own, keep)))
