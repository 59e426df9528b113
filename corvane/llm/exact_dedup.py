"""Exact dedup by distributed MSD radix partitioning (operator 4).

Documents are split by their leading bytes, and what still shares a group is split again by more bytes, until each
group is a singleton or all its texts have ended. Groups compare bytes; no digest decides equality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop_table, materialise, table

#: Bytes that the first split looks at, and by how much each further split widens them. A text of L bytes takes part
#: in log(L / FIRST) / log(GROWTH) splits at most, and only for as long as another document shares its bytes so far.
FIRST, GROWTH = 64, 16


def radix_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """One row per row of docs: id, keep_id (largest id of its group), group_size, kept, text_sha256.

    Equal: the same bytes after lower-casing A-Z; a null text counts as empty. Null ids rank below all others; a
    group whose ids are all null has keep_id null and keeps each of its rows. Rows that repeat an id within a group
    count each, and all rows with the kept id are marked kept. Texts are compared whole, however long. Other columns of docs are ignored; an empty table
    gives an empty result. text_sha256 is reported only, nothing is compared by it.

    A split counts groups first (combined on the map side, so a group with a third of all rows sends one row per
    task), writes the groups of several rows, and joins documents to them. Both sides of that join are plain
    shuffles and nothing above it needs a group together, so AQE may split a hot group over many tasks. The first
    split moves each text once; later ones move only texts that still share a group.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    alive = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.lit(0).cast("long").alias("_group"))
    seen, width, norm, done, by = 0, first, lambda c: ascii_lower(c).cast("binary"), [], ["_group", "_key", "_ended"]
    while True:
        # A split's key is the number of the group so far and the bytes that follow those it agrees in. The first bytes
        # after lower-casing are those of the first characters: whole texts needn't be lowered for that.
        head = norm(F.substring("_text", 1, width)) if not seen else F.col("_text")
        keyed = alive.select("_id", "_text", "_group", F.substring(head, seen + 1, width - seen).alias("_key"), (F.octet_length("_text") <= width).alias("_ended"))
        several = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max("_id").alias("_keep")).filter("_n > 1")
        shared = materialise(several.withColumn("_next", F.monotonically_increasing_id()), "radix-groups")
        joined = keyed.join(shared.hint("shuffle_hash"), by, "left")
        body, settled = norm(F.col("_text")), F.col("_n").isNull() | F.col("_ended")
        split = materialise(
            joined.select(
                "_id",
                F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"),
                F.coalesce("_n", F.lit(1)).cast("long").alias("_n"),
                F.when(settled, F.sha2(body, 256)).alias("_sha"),
                F.when(~settled, body).alias("_text"),
                F.col("_next").alias("_group"),
            ),
            "radix-split",
        )
        drop_table(shared)
        done.append(split.filter("_sha IS NOT NULL"))
        alive = split.filter("_sha IS NULL").select("_id", "_text", "_group")
        if alive.isEmpty():
            break
        seen, width, norm = width, width * growth, lambda c: c
    rows = done[0]
    for x in done[1:]:
        rows = rows.unionByName(x)
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents with their groups of equal texts; null counts as empty, other columns are ignored."""
    return radix_groups(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (
  SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, g.text_sha256 FROM d JOIN g USING (t)
"""
