"""Snapshots of versioned rows and replay of a write-ahead log, as dataflow.

versions: rid, xmin_ts, xmax_ts (null while current), data, and the transactions xmin and xmax if own
writes matter. log: lsn, txn_id, log_type, page_id, slot_id, before_image, after_image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANGES = ("INSERT", "UPDATE", "DELETE")


def visible(snapshot: int, own: int | None = None) -> Column:
    """Whether a version is seen at a snapshot: made at or before it and not yet replaced or deleted.
    own: a transaction whose writes are seen although they have no time."""
    made, ended = F.col("xmin_ts") <= snapshot, F.col("xmax_ts").isNotNull() & (F.col("xmax_ts") <= snapshot)
    if own is None:
        return made & ~ended
    mine, ended_by_me = F.col("xmin").eqNullSafe(F.lit(own)), F.col("xmax").eqNullSafe(F.lit(own))
    return (F.coalesce(made, F.lit(False)) | mine) & ~F.coalesce(ended, F.lit(False)) & ~ended_by_me


def snapshot_read(versions: DataFrame, snapshot: int, own: int | None = None) -> DataFrame:
    """(rid, data): of each row the newest version that the snapshot sees."""
    seen = versions.where(visible(snapshot, own))
    newest = F.struct(F.coalesce("xmin_ts", F.lit(2**62)), F.lit(1))
    return seen.groupBy("rid").agg(F.max_by("data", newest).alias("data"))


def write_conflicts(versions: DataFrame, writes: DataFrame, snapshot: int) -> DataFrame:
    """Rows of writes (rid) that a transaction begun at snapshot cannot change: a later commit has
    already changed them."""
    later = versions.where((F.col("xmin_ts") > snapshot) | (F.col("xmax_ts") > snapshot)).select("rid").distinct()
    return writes.join(later, "rid", "left_semi")


def from_lsn(log: DataFrame, lsn: int) -> DataFrame:
    """The log from a place on, in order."""
    return log.where(F.col("lsn") >= lsn).orderBy("lsn")


def analysis(log: DataFrame) -> DataFrame:
    """(txn_id, status, last_lsn): ACTIVE, COMMIT or ABORT, whichever a begun transaction came to."""
    ends = F.col("log_type").isin("COMMIT", "ABORT")
    begun = F.max((F.col("log_type") == "BEGIN").cast("int")) == 1
    status = F.coalesce(F.max_by(F.when(ends, F.col("log_type")), F.when(ends, F.col("lsn"))), F.lit("ACTIVE"))
    return log.where("txn_id IS NOT NULL").groupBy("txn_id").agg(status.alias("status"), F.max("lsn").alias("last_lsn"), begun.alias("begun")).where("begun").drop("begun")


def dirty_pages(log: DataFrame) -> DataFrame:
    """(page_id, rec_lsn): changed pages and the first change of each."""
    return log.where(F.col("log_type").isin(*CHANGES)).groupBy("page_id").agg(F.min("lsn").alias("rec_lsn"))


def last_checkpoint(log: DataFrame) -> DataFrame:
    return log.where("log_type = 'CHECKPOINT'").agg(F.max("lsn").alias("checkpoint_lsn"))


def redo(log: DataFrame, since: int = 0, page_lsn: DataFrame | None = None) -> DataFrame:
    """(page_id, slot_id, image): slots after replaying changes from since on, newer than their page."""
    changes = log.where(F.col("log_type").isin(*CHANGES) & (F.col("lsn") >= since))
    if page_lsn is not None:
        flushed = page_lsn.select(F.col("page_id").alias("_p"), F.col("page_lsn").alias("_l"))
        changes = changes.join(flushed, F.col("page_id") == F.col("_p"), "left").where("_l IS NULL OR _l < lsn").drop("_p", "_l")
    last = changes.groupBy("page_id", "slot_id").agg(F.max_by(F.struct("log_type", "after_image"), "lsn").alias("x"))
    return last.where("x.log_type <> 'DELETE'").select("page_id", "slot_id", F.col("x.after_image").alias("image"))


def undo(log: DataFrame) -> DataFrame:
    """(page_id, slot_id, image): what slots changed by unfinished transactions go back to; a null image
    means that the slot is emptied."""
    active = analysis(log).where("status = 'ACTIVE'").select(F.col("txn_id").alias("_t"))
    changes = log.where(F.col("log_type").isin(*CHANGES)).join(active, F.col("txn_id") == F.col("_t"), "left_semi")
    return changes.groupBy("page_id", "slot_id").agg(F.min_by("before_image", "lsn").alias("image"))


def recover(log: DataFrame, since: int = 0) -> DataFrame:
    """(page_id, slot_id, image): the slots after redo of all and undo of unfinished transactions."""
    back = undo(log).select(F.col("page_id").alias("_p"), F.col("slot_id").alias("_s"), F.col("image").alias("_i"), F.lit(True).alias("_u"))
    both = redo(log, since).join(back, (F.col("page_id") == F.col("_p")) & (F.col("slot_id") == F.col("_s")), "full")
    image = F.when(F.col("_u"), F.col("_i")).otherwise(F.col("image"))
    return both.select(F.coalesce("page_id", "_p").alias("page_id"), F.coalesce("slot_id", "_s").alias("slot_id"), image.alias("image")).where("image IS NOT NULL")
