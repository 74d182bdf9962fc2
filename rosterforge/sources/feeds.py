"""Partner files in several formats as rows of strings, and the pipeline's sinks."""

from __future__ import annotations

import fcntl
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import redact
from ..operators.audit import GENESIS, numbered_lines
from ..operators.audit import append as link_entries

CORRUPT = "_corrupt"


def read_csv(spark: SparkSession, path: str, with_line: bool = True) -> DataFrame:
    """All columns as strings under their own names, blanks as "". _line (file, place) orders rows as files have them, files by name.

    Fields may hold line breaks, so a file is one task; feeds come as many files.
    """
    columns = csv_columns(spark, path)
    schema = ", ".join(f"`{c}` string" for c in [*columns, CORRUPT])
    x = spark.read.options(header=True, escape='"', multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT).schema(schema).csv(path)
    line = [F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("place")).alias("_line")] if with_line else []
    return x.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns], F.col(CORRUPT).alias("parse_error"), *line)


def correlation_ids(rows: DataFrame) -> DataFrame:
    """rows of read_csv with `correlation_id`, the file's name and the row's index in it from 0."""
    firsts = rows.groupBy(F.col("_line.file").alias("_file")).agg(F.min("_line.place").alias("_first"))
    x = rows.join(firsts, F.col("_line.file") == F.col("_file"))
    name = F.element_at(F.split("_file", "/"), -1)
    return x.withColumn("correlation_id", F.concat_ws(":", name, (F.col("_line.place") - F.col("_first")).cast("string"))).drop("_file", "_first")


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(header=True, escape='"', multiLine=True).csv(path).columns


def read_json(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in [*columns, CORRUPT])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", CORRUPT).json(path).withColumnRenamed(CORRUPT, "parse_error")


def read_fixed_width(spark: SparkSession, path: str, fields: dict[str, tuple[int, int]]) -> DataFrame:
    """fields: name to (first column from 1, length). Lines that end before the last field begins carry a parse error."""
    last = max(a for a, _ in fields.values())
    x = spark.read.text(path).filter(F.col("value") != "")
    return x.select(*[F.trim(F.substring("value", a, n)).alias(c) for c, (a, n) in fields.items()], F.when(F.length("value") < last, F.col("value")).alias("parse_error"))


def read_xml(spark: SparkSession, path: str, row_tag: str, columns: list[str]) -> DataFrame:
    """The rows between row tags. One that isn't well formed, or has no end, is a row of nulls with its text as parse_error.

    Files are cut at the rows' end tags, and what stands before one at each begin tag, so that a broken row can't take the next
    one with it, and a file is read by many tasks. Row tags inside comments and CDATA aren't told from others; files are UTF-8.
    """
    end, begin = f"</{row_tag}>", rf"(?=<\Q{row_tag}\E[\s/>])"
    meta = F.col("_metadata")
    x = spark.read.option("lineSep", end).text(path).select("value", meta["file_path"].alias("f"), F.struct(meta["file_block_start"].alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    # What follows the last end tag has none: a row that begins there is cut off.
    last = x.groupBy("f").agg(F.max("at").alias("at"), F.lit(True).alias("tail"))
    x = x.join(last, ["f", "at"], "left").select("value", F.coalesce("tail", F.lit(False)).alias("tail"))
    x = x.select("tail", F.posexplode(F.split("value", begin)).alias("k", "piece"), F.size(F.split("value", begin)).alias("n"))
    x = x.filter(F.col("piece").rlike(f"^{begin}"))
    alone = F.regexp_extract("piece", r"^<[^>]*/>", 0)
    closed = (F.col("k") == F.col("n") - 1) & ~F.col("tail")
    whole = F.when(alone != "", alone).when(closed, F.concat("piece", F.lit(end)))
    schema = ", ".join(f"`{c}` string" for c in [*columns, CORRUPT])
    row = F.from_xml(whole, schema, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})
    x = x.select("piece", whole.isNull().alias("cut"), row.alias("row"))
    return x.select(*[F.col("row").getField(c).alias(c) for c in columns], F.when(F.col("cut"), F.col("piece")).otherwise(F.col("row").getField(CORRUPT)).alias("parse_error"))


#: What separates elements and ends segments where a file has no whole ISA segment.
ELEMENT, SEGMENT = "*", "~"
#: Fixed: an ISA segment has 16 elements and so many characters, the segment's end included.
ISA_ELEMENTS, ISA_CHARS = 16, 106


def files_of(spark: SparkSession, path: str) -> list[str]:
    """The files that a path, a folder or a pattern names, without hidden ones."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for s in fs.globStatus(p) or []:
        own = fs.listStatus(s.getPath()) if s.isDirectory() else [s]
        found += [x.getPath().toString() for x in own if x.isFile() and x.getPath().getName()[0] not in "._"]
    return sorted(found)


def x12_separators(spark: SparkSession, path: str) -> tuple[str, str]:
    """(element separator, segment end) of a file, as its ISA segment has them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        head = bytes(stream.readNBytes(ISA_CHARS)).decode("latin-1")
    finally:
        stream.close()
    if len(head) == ISA_CHARS and head.startswith("ISA") and head[:-1].count(head[3]) == ISA_ELEMENTS:
        return head[3], head[-1]
    return ELEMENT, SEGMENT


def x12_segments(spark: SparkSession, paths: list[str] | str, end: str) -> DataFrame:
    """(f, at, s): the segments of files, numbered from 1 in each. A row is a segment, so a file of any size is read by many tasks.

    Numbers come from the counts of a file's blocks and the place inside a block: nothing is sorted or gathered.
    """
    meta = F.col("_metadata")
    x = spark.read.option("lineSep", end).text(paths).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("s"), meta["file_path"].alias("f"), meta["file_block_start"].alias("b"), F.monotonically_increasing_id().alias("i"))
    heads = x.groupBy("f", "b").agg(F.min("i").alias("first"), F.count(F.lit(1)).alias("n"))
    heads = heads.select("f", "b", (F.sum("n").over(W.partitionBy("f").orderBy("b")) - F.col("n") - F.col("first")).alias("shift"))  # a row per block
    return x.join(heads, ["f", "b"]).select("f", "b", (F.col("i") + F.col("shift") + 1).alias("at"), "s").filter("s <> ''")


def read_x12_834(spark: SparkSession, path: str) -> DataFrame:
    """Benefit enrollment: a member per INS loop, from its REF*0F, NM1*IL, DMG*D8 and N3/N4 segments.

    Separators are those of each file's ISA segment. A loop's number is the count of INS segments up to it: counts of a file's blocks
    first, then inside each block. The first segment of a kind counts in each loop. parse_error says what a loop lacks (REF*0F or
    NM1*IL); the counts of SE, GE and IEA segments are checked, and one that is wrong or missing is a row with parse_error alone.
    """
    groups: dict[tuple[str, str], list[str]] = {}
    for f in files_of(spark, path):
        groups.setdefault(x12_separators(spark, f), []).append(f)
    out = None
    for (element, end), files in sorted(groups.items()) or [((ELEMENT, SEGMENT), path)]:
        x = x12_segments(spark, files, end)
        own = x12_members(x, element).unionByName(x12_envelope_errors(x, element), allowMissingColumns=True)
        out = own if out is None else out.unionByName(own)
    return out


def x12_members(segments: DataFrame, element: str) -> DataFrame:
    el = lambda n, s="s": F.split_part(F.col(s), F.lit(element), F.lit(n + 1))
    kinds = {"ref": ("REF", "0F"), "nm1": ("NM1", "IL"), "dmg": ("DMG", "D8"), "n3": ("N3", None), "n4": ("N4", None)}
    wanted = lambda head, code: (el(0) == head) & (F.lit(True) if code is None else el(1) == code)
    any_kind = el(0) == "INS"
    for k in kinds.values():
        any_kind = any_kind | wanted(*k)
    x = segments.filter(any_kind).withColumn("ins", (el(0) == "INS").cast("long"))
    heads = x.groupBy("f", "b").agg(F.sum("ins").alias("n"))
    heads = heads.select("f", "b", (F.sum("n").over(W.partitionBy("f").orderBy("b")) - F.col("n")).alias("before"))  # a row per block
    inside = W.partitionBy("f", "b").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    x = x.join(heads, ["f", "b"]).withColumn("loop", F.col("before") + F.sum("ins").over(inside)).filter("loop > 0")
    loops = x.groupBy("f", "loop").agg(*[F.min_by("s", F.when(wanted(*k), F.col("at"))).alias(name) for name, k in kinds.items()])
    text = lambda s, n: F.coalesce(el(n, s), F.lit(""))
    person = lambda n: F.when(text("nm1", 2) == "1", text("nm1", n)).otherwise("")
    error = F.when(text("ref", 2) == "", "no REF*0F").when(F.col("nm1").isNull(), "no NM1*IL")
    return loops.select(
        text("ref", 2).alias("member_id"), person(4).alias("first_name"), person(3).alias("last_name"), text("dmg", 2).alias("dob"), F.when(text("nm1", 8) == "34", text("nm1", 9)).otherwise("").alias("ssn"),
        text("n3", 1).alias("street"), text("n4", 1).alias("city"), text("n4", 2).alias("state"), text("n4", 3).alias("zip"), error.alias("parse_error"),
    )


def x12_envelope_errors(segments: DataFrame, element: str) -> DataFrame:
    """(parse_error) for each transaction set, group and interchange whose trailer counts otherwise or is missing; trailers without a beginning are let pass."""
    el = lambda n: F.split_part(F.col("s"), F.lit(element), F.lit(n + 1))
    x = segments.select("f", "at", el(0).alias("kind"), el(1).alias("said")).filter(F.col("kind").isin("ISA", "IEA", "GS", "GE", "ST", "SE"))
    w = W.partitionBy("f").orderBy("at")  # a few rows for each transaction set
    out = None
    for begin, end, inner in (("ST", "SE", None), ("GS", "GE", "ST"), ("ISA", "IEA", "GS")):
        y = x.withColumn("_n", F.col("at") if inner is None else F.count_if(F.col("kind") == inner).over(w))
        y = y.filter(F.col("kind").isin(begin, end)).withColumns({"_before": F.lag(F.struct("kind", "_n")).over(w), "_after": F.lead("kind").over(w)})
        found = F.col("_n") - F.col("_before._n") + (1 if inner is None else 0)
        wrong = (F.col("kind") == end) & (F.col("_before.kind") == begin) & ~F.coalesce(F.col("said").try_cast("long") == found, F.lit(False))
        open_ = (F.col("kind") == begin) & ~F.col("_after").eqNullSafe(F.lit(end))
        said = F.when(wrong, F.concat(F.lit(f"{end} says "), "said", F.lit(", found "), found.cast("string"))).when(open_, F.lit(f"{begin} without {end}"))
        if begin != "ST":  # parts of interchanges are read as well: only whole ones are missed when they break off
            said = F.when(wrong, F.concat(F.lit(f"{end} says "), "said", F.lit(", found "), found.cast("string"))).when(open_ & F.col("_after").isNotNull(), F.lit(f"{begin} without {end}"))
        y = y.select(said.alias("parse_error")).filter("parse_error IS NOT NULL")
        out = y if out is None else out.unionByName(y)
    return out


#: A format's reader, by name; others can be added.
READERS: dict[str, Callable[..., DataFrame]] = {"csv": read_csv, "json": read_json, "fixed_width": read_fixed_width, "xml": read_xml, "x12_834": read_x12_834, "parquet": lambda spark, path: spark.read.parquet(path)}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def discover(spark: SparkSession, feeds: dict[str, tuple[str, str]], **options) -> dict[str, DataFrame]:
    """feeds: id to (format, path). Files that aren't there are left out."""
    return {k: READERS[f](spark, p, **options.get(k, {})) for k, (f, p) in feeds.items() if exists(spark, p)}


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    out = feeds[0]
    for x in feeds[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def write_quarantine(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("partner_id", "feed_id").json(path)


PROFILE = "partner_id string, field string, count long, null_count long, distinct_count long, null_rate double"


def write_profile(profile: DataFrame, path: str) -> None:
    profile.coalesce(1).write.mode("overwrite").json(path)


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE).json(path)


def append_log(path: str, entries: list[dict]) -> None:
    """Lines at the end of a chain's JSONL, by its one writer on the driver."""
    with open(path, "a") as f:
        f.writelines(json.dumps(e) + "\n" for e in entries)


def append_chain(path: str, events: list[dict], head: str | None = None) -> str:
    """Events linked to the chain of a file of this machine, from its last entry's hash on; the new head. head: refuse if the file's is another one.

    The file is locked from the look at its head until the lines are written, so that writers follow each other.
    """
    with open(path, "a+b") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        last = last_hash(f)
        if head is not None and head != last:
            raise RuntimeError(f"the chain's head is {last}, not {head}")
        entries = link_entries(last, events)
        f.seek(0, os.SEEK_END)
        f.write(b"".join(json.dumps(e, sort_keys=True).encode() + b"\n" for e in entries))
        f.flush()
        os.fsync(f.fileno())
    return entries[-1]["self_hash"] if entries else last


def last_hash(f, step: int = 1 << 16) -> str:
    """The self_hash of a log's last line that isn't blank, read from the end; that of the genesis for an empty one."""
    end = f.seek(0, os.SEEK_END)
    tail = b""
    while end > 0 and len(tail.strip().split(b"\n")) < 2:
        at = max(0, end - step)
        f.seek(at)
        tail, end = f.read(end - at) + tail, at
    lines = tail.strip().split(b"\n")
    return json.loads(lines[-1])["self_hash"] if lines[-1] else GENESIS


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", schema).alias("e")).select("e.*")


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).select(F.explode("records").alias("r")).select("r.*")


#: Fixed endings of the test data that is scanned.
SCANNED = "*.{py,json,jsonl,csv,tsv,txt,yaml,yml,sql,md}"


def scan_fixtures(spark: SparkSession, path: str, glob: str = SCANNED) -> DataFrame:
    """Findings (path, line, pattern, value) in a tree of test data; lines that say so are let pass."""
    x = numbered_lines(spark, path, recursiveFileLookup=True, pathGlobFilter=glob)
    return x.select("path", "line", F.explode(redact.fixture_findings(F.col("value"))).alias("f")).select("path", "line", "f.pattern", "f.value")


def scan_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Findings (path, line, pattern, excerpt): of the strings in .jsonl files, of whole lines in others."""
    x = numbered_lines(spark, path, recursiveFileLookup=True, pathGlobFilter=glob).filter(redact.suspicious(F.col("value")))
    is_json = F.col("path").endswith(".jsonl")
    of = lambda rows, f: rows.select("path", "line", F.explode(f(F.trim("value"))).alias("f"))
    found = of(x.filter(is_json), redact.json_excerpts).unionByName(x.filter(~is_json).select("path", "line", F.explode(redact.excerpts("value")).alias("f")))
    return found.select("path", "line", "f.pattern", "f.excerpt")


def copy_new(store: DataFrame, path: str, key: list[str], spark: SparkSession) -> None:
    """Append rows of the store that an analytical copy lacks."""
    rows = store.join(spark.read.parquet(path).select(*key), key, "left_anti") if exists(spark, path) else store
    rows.write.mode("append").parquet(path)
