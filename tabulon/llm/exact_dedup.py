"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stored

#: Runs that a merge takes at once, rows of a run.
FAN_IN, RUN_ROWS = 4, 250_000
KEY = ["digest", "bytes", "check"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normal=lower_ascii) -> DataFrame:
    """id, SHA-256 of the normalised text, and two independent checks of it (its length in bytes and a 64-bit hash)."""
    text: Column = normal(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("t")).select("id", F.unhex(F.sha2("t", 256)).alias("digest"), F.octet_length("t").cast("long").alias("bytes"), F.xxhash64("t").alias("check"))


def first_runs(digest_rows: DataFrame, keep: str, runs: int) -> DataFrame:
    """Level 0: one run per residue of the row's identifier, pre-aggregated where the rows are read: run, digest, bytes,
    check, keep_id, group_size."""
    best = {"max": F.max, "min": F.min}[keep]
    return digest_rows.withColumn("run", _run_of("id", runs)).groupBy("run", *KEY).agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _run_of(id_col: str, runs: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(runs)).cast("int")


def merge_runs(level: DataFrame, keep: str, runs: int, fan_in: int = FAN_IN) -> DataFrame:
    """One row per distinct text: digest, bytes, check, keep_id, group_size. runs is a power of fan_in.

    Rounds of a binomial exchange: in round j, the runs whose numbers differ in digit j only (base fan_in) deal their keys
    among each other by the key's own digit j. Each then merges the fan_in sorted pieces that it holds: partitions are
    sorted by key, the best identifier first, and of the rows of one verified key (digest, length and second hash) the first
    stays, with the sum of their rows. After the last round a key is in one run. A key has at most fan_in rows in a
    merge, however many rows it began with. Null identifiers count as rows and stay only where there is no other."""
    order = {"max": F.desc_nulls_last, "min": F.asc_nulls_last}[keep]("keep_id")
    same = Window.partitionBy("run", *KEY).orderBy(order)
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = 1
    while place < runs:
        mine = F.floor(F.col("run") / place) % fan_in
        wanted = F.floor(F.pmod(F.col("check"), F.lit(runs)) / place) % fan_in
        dealt = level.withColumn("run", (F.col("run") + (wanted - mine) * place).cast("int"))
        merged = dealt.repartition("run").sortWithinPartitions("run", *KEY, order)
        level = merged.select("run", *KEY, "keep_id", F.sum("group_size").over(whole).alias("group_size"), F.row_number().over(same).alias("_nth")).where("_nth = 1").drop("_nth")
        place *= fan_in
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normal=lower_ascii, run_rows: int = RUN_ROWS) -> DataFrame:
    """Per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal after `normal`; the row with the largest (keep="max") or smallest identifier stays. A
    null text counts as empty; rows repeated with one identifier form a group and are all marked kept where that
    identifier stays; an empty table gives an empty result; other columns of docs play no part. The digests are written
    once to the shared folder, so each text is read once. Results go back the way they came: to each run's keys first, then
    to the run's rows, so that the rows of a hot text are spread over all runs (of about run_rows rows)."""
    rows = stored(digests(docs, id_col, text_col, normal), "digests")
    runs = FAN_IN ** max(3, math.ceil(math.log(max(1, rows.count() / run_rows), FAN_IN)))
    level = stored(first_runs(rows, keep, runs), "runs")
    final = merge_runs(level, keep, runs)
    told = level.select("run", *KEY).join(final, KEY)
    found = rows.withColumn("run", _run_of("id", runs)).join(told, ["run", *KEY])
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normal=lower_ascii) -> DataFrame:
    """docs without the rows whose text another row stands for; columns as they were. Of rows that repeat the staying identifier, all stay."""
    stay = exact_dedup(docs, id_col, text_col, keep, normal).where("kept").select(F.col(id_col).alias("id")).distinct().alias("stay")
    return docs.alias("docs").join(stay, F.col(f"docs.{id_col}").eqNullSafe(F.col("stay.id")), "left_semi")
