"""Exact deduplication by a 128-bit content hash, with a comparison of bytes inside the groups.

Only narrow rows (id and digests) are shuffled for all documents. The texts of groups with more than one row go
through min() and max(), which combine before the shuffle, so a hot group costs each task one row: a group whose
smallest and largest text are the same bytes holds one text. A group that fails is split by its whole text.

Nulls in the text count as empty. Rows with a null id are rows like others; as an id they never win against a
stated one. Repeated rows stay rows, each with its own result row: of equal texts the rows with the winning id
are all marked kept. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, lower_ascii, small


def content_hash(text: Column) -> Column:
    """128 bits, as hexadecimal digits."""
    return F.md5(text.cast("binary"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] = lower_ascii, digest: Callable[[Column], Column] = content_hash, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256. keep: "smallest" or "largest" id stays."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "exact")
    text = normalise(F.col("text"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    best = F.min if keep == "smallest" else F.max
    keyed = tmp.write(rows.select("id", digest(text).alias("h"), F.sha2(text.cast("binary"), 256).alias("text_sha256")), "keyed")
    groups = tmp.write(keyed.groupBy("h").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")

    shared = groups.filter("group_size > 1").select("h")
    several = small(shared, shared.count(), broadcast_rows)
    texts = rows.select("id", text.alias("t"), digest(text).alias("h")).join(several, "h", "left_semi")
    split = tmp.write(texts.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo <> hi").select("h"), "split")
    if n := split.count():
        # Different texts of one hash: the rows of these hashes alone are grouped by their whole text.
        inside = texts.join(small(split, n, broadcast_rows), "h", "left_semi")
        apart = inside.groupBy("h", "t").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        apart = tmp.write(apart.select("h", F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size"), "apart")
        same = keyed.join(split, "h", "left_anti").join(groups, "h")
        other = keyed.join(split, "h", "left_semi").join(apart, ["h", "text_sha256"])
        cols = ["id", "keep_id", "group_size", "text_sha256"]
        out = same.select(cols).unionByName(other.select(cols))
    else:
        out = keyed.join(groups, "h")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, **kw) -> DataFrame:
    """The documents themselves without the copies; ids are expected to be distinct and stated."""
    gone = exact_dedup(docs, **kw).filter(~F.col("kept"))
    key = kw.get("id_col", "doc_id")
    return docs.join(gone.select(key), key, "left_anti")
