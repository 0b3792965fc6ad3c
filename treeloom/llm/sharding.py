"""Proportional stratified interleaving into shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import HOT_SHARE, kept

#: Rows that one window group is meant to hold.
GROUP_ROWS = 20_000


def shard(docs: DataFrame, n_shards: int = 16, key: str = "doc_id", stratum: str = "source", text: str = "text", seed: int = 17) -> DataFrame:
    """Deal all rows of docs into n_shards shards whose row counts differ by one at most and whose mixtures match.

    In each stratum, rows are ranked by a seeded hash of their key and text. A row's fractional rank is (rank - 1 + offset) /
    rows of its stratum, with a seeded offset of each stratum between 0 and 1, so that many small strata spread as one large
    one does. Sorted by that, any stretch holds each stratum in proportion; n_shards equal stretches are the shards, and the
    place in its stretch is a row's slot.

    Result: key, size (UTF-8 bytes of the text + 1), text_crc32, law ('rows'), shard, slot (gapless from 0),
    grown_shard (null under this law), in no order. A null text counts as empty (size 1, crc 0); a null
    stratum is a stratum of its own; a null key is a key; rows with equal keys are ordered by their text's
    crc and size, so equal rows are interchangeable. An empty table gives an empty result. Other columns
    are not read. Texts of any length count whole.

    No group is sorted whole: a stratum's hash range and the fractional ranks are cut into about
    rows / GROUP_ROWS equal ranges, whose row counts give the offsets, so a stratum with a third of all rows
    is spread like the others. Only repeated rows can fill one range; such rows, which are interchangeable, are ranked by
    their place in the stored table instead. Text leaves the scan as two numbers only.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = kept(
        docs.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("_stratum"),
            F.col(stratum).isNull().alias("_none"),
            F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_hash"),
            F.monotonically_increasing_id().alias("_at"),
        ),
        "shard-rows",
    )
    n = rows.count()
    bits = max(8, (n // GROUP_ROWS).bit_length())
    ties = ["_hash", "doc_id", "text_crc32", "size", "_at"]
    cell = ["_stratum", "_none", "_cell"]
    rows = rows.withColumn("_cell", F.shiftrightunsigned("_hash", 64 - bits))
    hot = rows.groupBy(*cell).count().filter(F.col("count") > max(4 * GROUP_ROWS, n // HOT_SHARE)).select(*cell).collect()
    if hot:  # fewer than HOT_SHARE
        is_hot = F.lit(False)
        for s, none, c in hot:
            is_hot = is_hot | ((F.col("_stratum") == s) & (F.col("_none") == none) & (F.col("_cell") == c))
        rows = rows.withColumn("_hash", F.when(is_hot, F.xxhash64("_hash", "_at")).otherwise(F.col("_hash"))).withColumn("_cell", F.shiftrightunsigned("_hash", 64 - bits))
    whole = Window.partitionBy("_stratum", "_none")
    cells = rows.groupBy(*cell).count().select(*cell, _before(F.col("count"), whole.orderBy("_cell")).alias("_base"), F.sum("count").over(whole).alias("_of"))
    rank = F.col("_base") + F.row_number().over(Window.partitionBy(*cell).orderBy(*ties))
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "_stratum", "_none"), 12) / float(1 << 52)
    placed = rows.join(cells, cell).withColumn("_share", (rank - 1 + offset) / F.col("_of"))
    placed = kept(placed.withColumn("_part", F.least(F.floor(F.col("_share") * (1 << bits)), F.lit((1 << bits) - 1))).drop("_base", "_of", "_cell"), "shard-ranked")
    parts = placed.groupBy("_part").count().select("_part", _before(F.col("count"), Window.orderBy("_part")).alias("_start"))
    order = Window.partitionBy("_part").orderBy("_share", "_stratum", "_none", *ties)
    at = placed.join(parts, "_part").withColumn("_at", F.col("_start") + F.row_number().over(order) - 1)
    return (
        at.withColumn("shard", F.floor(F.expr(f"_at * {n_shards} div {max(n, 1)}")).cast("int"))
        .withColumn("slot", F.expr(f"_at - (shard * {n}L + {n_shards - 1}) div {n_shards}"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.when(~F.col("_none"), F.col("_stratum")).alias("stratum"))
    )


def _before(count: Column, window) -> Column:
    return F.coalesce(F.sum(count).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
