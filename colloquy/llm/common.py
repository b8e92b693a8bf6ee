"""Shared helpers: materialised tables, text units, first-of-group joins."""

from __future__ import annotations

import atexit
import re
import tempfile
import unicodedata
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word contract; all other bytes belong to words.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LATIN = [chr(c) for c in range(0x250)]
#: Letters and numbers below U+0250, as the inside of a character class.
LETTERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "L"))
NUMBERS = re.escape("".join(c for c in _LATIN if unicodedata.category(c)[0] == "N"))
#: Characters whose normalisation or class may depend on a Unicode version.
OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-\u012f\u0131-\u024f]")


def words_of(text: str | None) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, unchanged; none for null."""
    if not text:
        return []
    for c in "\t\n\x0b\x0c\r":
        if c in text:
            text = text.replace(c, " ")
    return list(filter(None, text.split(" ")))


def lower_ascii(text: str) -> str:
    """A-Z to a-z, every other character unchanged."""
    return text.lower() if text.isascii() else text.encode().lower().decode()  # bytes lower A-Z only


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share.

    ``spark.checkpoint.dir`` where the session has it; else the directory the
    context already uses; else, only where driver and executors are one process
    (tests), a temporary one.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_dir = "file://" + tempfile.mkdtemp(prefix="colloquy-")
        spark.sparkContext.setCheckpointDir(set_dir)
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, removed when the driver exits."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared path; a stopped session or a missing path is fine."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the context may be gone at exit
        pass


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts lineage: a lost executor costs the tasks that read
    it, never the jobs before it.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")  # the written table replaces the shuffle files
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(cleanup, before) if before is not None else spark.conf.unset(cleanup)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a unit that is broadcast, at most; longer ones are joined.
LONGEST_UNIT = 64


def most_frequent(counts: DataFrame, most: int, longest: int | None = None) -> pa.Table:
    """Rows of ``counts`` (unit, n, ...) with the largest n, at most ``most``, by falling n, then unit.

    With ``longest``, only units of so many bytes at most, so the result is
    bounded in bytes as well.

    Only whole grades of n are taken: of those that would pass ``most``, none.
    Grades are single counts below 1024 and sixty-fourths of a doubling above,
    so their sizes are a few thousand rows; no task sorts or reads more than
    its own part.
    """
    counts = counts if longest is None else counts.where(F.octet_length("unit") <= longest)
    grade = F.when(F.col("n") < 1024, F.col("n")).otherwise((F.log2("n") * 64).cast("long") + 384)
    total, least = 0, None
    for r in sorted(counts.groupBy(grade.alias("grade")).agg(F.count(F.lit(1)).alias("units")).collect(), key=lambda r: -r["grade"]):
        total += r["units"]
        if total > most:
            break
        least = r["grade"]
    if least is None:
        return counts.limit(0).toArrow()
    return counts.where(grade >= least).toArrow().sort_by([("n", "descending"), ("unit", "ascending")])


def row_ids(df: DataFrame, name: str = "_row") -> DataFrame:
    """Adds a unique long per row; equal for every attempt of the same split."""
    return df.withColumn(name, F.monotonically_increasing_id())


def first_of_group(rows: DataFrame, key: str, id_col: str) -> DataFrame:
    """Joins to every row the smallest id and the size of its key's group.

    The group side is aggregated map-side first, so a key that holds a third
    of all rows arrives as one partial row per task. Its output is projected
    to a new key column, which makes both inputs of the join plain exchanges:
    adaptive execution can then split a hot key's rows over many tasks.
    """
    groups = rows.groupBy(key).agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("group_size"))
    again = (lambda c: F.concat(c, F.lit(b""))) if dict(rows.dtypes)[key] == "binary" else F.hex
    groups = groups.select(again(F.col(key)).alias("_group_key"), "first_id", "group_size")
    mine = rows[key] if again is not F.hex else F.hex(rows[key])
    return rows.join(groups, mine == groups["_group_key"], "left").drop("_group_key")


def later_of_group(rows: DataFrame, key: str) -> DataFrame:
    """_row of all rows (doc_id, _row) but the first of each key, by doc_id with nulls last, then _row."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    placed = rows.select(key, place.alias("place"))
    return first_of_group(placed, key, "place").where(F.col("place._row") != F.col("first_id._row")).select(F.col("place._row").alias("_row"))
