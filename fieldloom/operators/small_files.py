"""Records of very many small text files, each exactly once, in few files.

Lines are read, compared as numbers and times, and of equal records the first delivery stays. The
kept records are written as Parquet parts, and the parts are merged by copying encoded blocks (see
``fieldloom.sources.parquet_blocks``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.plans.scale import shared_path, spread, stored
from fieldloom.sources.parquet_blocks import merge_folder

KEY = ["dataset", "vars", "t_us", "points", "value", "odd"]
_PLAIN = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?Z?$"
_REST = "CASE WHEN instr(stamp, ':') = 0 THEN ' 00:00:00Z' WHEN length(stamp) - length(replace(stamp, ':', '')) = 1 THEN ':00Z' ELSE 'Z' END"
_STAMP = r"^\d{4}-\d{1,2}-\d{1,2}([T ]+\d{1,2}:\d{2}(:\d{2}([.]\d+)?)?)?\s*(Z|z|[+-]\d{2}:?\d{2})?$"


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """The columns, computed once for each row: filters above would otherwise be pushed down as copies of their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def records(files: DataFrame) -> DataFrame:
    """The record lines of all payloads, in comparable form.

    Returns file_id, line_no, written_at, dataset, vars, t_us, points, value, odd. A record is a line
    that is neither blank nor a comment (``#``) and has at least three entries that are not blank,
    with a readable time and number of point. ``value`` is null where it is missing (NaN); a value
    that can't be read stands in ``odd`` as text, which is null otherwise. Lines are those between
    line feeds, carriage returns and blanks around an entry don't count. Null payloads have none.
    """
    lines = spread(files.select("file_id", "written_at", "dataset", "vars", "payload").where(F.col("payload").isNotNull()))
    lines = lines.select("file_id", "written_at", "dataset", "vars", F.posexplode(F.split("payload", "\n")).alias("pos", "line"))
    lines = lines.where(F.expr("locate(',', line, instr(line, ',') + 1) > instr(line, ',')")).where(~F.ltrim("line").startswith("#"))
    entry = lambda n: F.trim(F.substring_index(F.substring_index("line", ",", n), ",", -1), F.lit(" \r\t"))
    lines = _computed(lines, e0=entry(1), e1=entry(2), e2=entry(3)).drop("line").where(F.col("e2") != "")
    # most times are written plainly; others are taken apart
    plain = F.col("e0").rlike(_PLAIN)
    zone = F.regexp_extract("e0", r"([+-])(\d{2}):?(\d{2})$", 0)
    has_zone = F.col("e0").rlike(r":\d{2}([.]\d+)?\s*[+-]\d{2}:?\d{2}$")
    sign = F.when(F.substring(zone, 1, 1) == "-", F.lit(-1)).otherwise(F.lit(1))
    shift = sign * (F.substring(zone, 2, 2).cast("long") * 3600 + F.expr("right(e0, 2)").cast("long") * 60)
    bare = F.when(has_zone, F.regexp_replace("e0", r"\s*[+-]\d{2}:?\d{2}$", "")).otherwise(F.regexp_replace("e0", r"\s*[Zz]$", ""))
    written = F.when(plain, F.struct(F.rtrim("e0", F.lit("Z")).alias("stamp"), F.lit(0).cast("long").alias("shift"))).when(
        F.col("e0").rlike(_STAMP), F.struct(F.regexp_replace(bare, "[T ]+", " ").alias("stamp"), F.when(has_zone, shift).otherwise(F.lit(0)).cast("long").alias("shift")))
    lines = _computed(lines, at=written).select("*", "at.stamp", "at.shift")
    t_us = F.expr(f"unix_micros(try_cast(concat(stamp, {_REST}) as timestamp))") - F.col("shift") * 1_000_000
    number = F.expr("try_cast(e2 as double)")
    missing = F.lower("e2").isin("nan", "na", "n/a", "null", "none", "-")
    lines = _computed(lines, **{
        "t_us": t_us,
        "points": F.expr("try_cast(e1 as double)") + F.lit(0.0),
        "value": F.when(~missing & ~F.isnan(number), number + F.lit(0.0)),
        "odd": F.when(~missing & number.isNull(), F.col("e2")),
        "line_no": (F.col("pos") + 1).cast("int"),
    })
    return lines.where(F.col("t_us").isNotNull() & F.col("points").isNotNull()).select("file_id", "line_no", "written_at", *KEY)


def _firsts(found: DataFrame) -> DataFrame:
    return found.groupBy(*KEY).agg(F.min(F.struct("written_at", "file_id", "line_no")).alias("first"), F.count(F.lit(1)).alias("copies"))


def surplus_copies(files: DataFrame) -> DataFrame:
    """file_id, line_no of each record line but the first of the same record.

    The same record has equal dataset, vars, time, points and value; null equals null and missing
    equals missing. The first has the lowest (written_at, file_id, line_no), nulls lowest.

    The payloads are read once; the read records are kept in the shared folder. A count of their hashes,
    combined before its shuffle, leaves those that may have copies; a record that makes up much of the
    data is split by the skew join. The first of each of them comes from an aggregate with a partial step.
    """
    found = stored(records(files).withColumn("h", F.xxhash64(*KEY)))
    # equal records have equal hashes, so only these rows can have copies
    again = found.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    some = found.join(again, "h", "left_semi")
    first = _firsts(some).select(F.col("first.file_id").alias("file_id"), F.col("first.line_no").alias("line_no"))
    return some.select("file_id", "line_no").join(first, ["file_id", "line_no"], "left_anti")


def kept_records(files: DataFrame) -> DataFrame:
    """dataset, vars, t_us, points, value, odd, copies and the (file_id, line_no) of the first of each record."""
    return _firsts(records(files)).select(*KEY, "copies", F.col("first.file_id").alias("file_id"), F.col("first.line_no").alias("line_no"))


def consolidate(files: DataFrame, out: str | None = None, target_bytes: int = 256 * 1024 * 1024) -> DataFrame:
    """Write each record once and merge the written parts into files of about ``target_bytes``.

    Returns one row for each merged file in ``out``/merged, see :func:`merge_folder`. ``out`` is a folder that all
    executors share; by default a new one below the folder named by spark.checkpoint.dir.
    """
    spark = files.sparkSession
    base = out or shared_path(spark, f"consolidated-{uuid.uuid4().hex}")
    kept_records(files).write.mode("overwrite").parquet(f"{base}/parts")
    return merge_folder(spark, f"{base}/parts", f"{base}/merged", target_bytes)
