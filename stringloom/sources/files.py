"""Source files as rows of (path, content)."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import utf16_length

_BOM = "\ufeff"


def decode_utf8(data: Column) -> Column:
    """UTF-8 text without a leading byte-order mark; null for bytes that are not UTF-8."""
    text = F.try_validate_utf8(data.cast("string"))
    return F.when(text.startswith(_BOM), F.substring(text, F.lit(2), F.length(text))).otherwise(text)


def decode_text(data: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are not UTF-8."""
    return F.coalesce(decode_utf8(data), F.decode(data, "ISO-8859-1"))


def read_code_files(spark: SparkSession, folder: str, suffix: str = ".dart") -> DataFrame:
    """Every source file below a folder, of any size. ``unreadable_files`` lists those left out."""
    # As the input of a generator the text is decoded once, not again for the condition on it.
    usable = F.filter(F.array(decode_utf8(F.col("content"))), lambda t: t.isNotNull())
    return _binary(spark, folder, f"*{suffix}").select("path", F.explode(usable).alias("content"))


def unreadable_files(spark: SparkSession, folder: str, suffix: str = ".dart") -> DataFrame:
    """The source files that ``read_code_files`` leaves out: path and reason."""
    files = _binary(spark, folder, f"*{suffix}")
    return files.where(decode_utf8(F.col("content")).isNull()).select("path", F.lit("not UTF-8").alias("reason"))


def read_text_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Sheets or bundles below a folder, in either encoding."""
    return _binary(spark, folder, glob).select(
        "path", decode_text(F.col("content")).alias("content"),
        F.col("modificationTime").alias("modified"),
    )


def fits(content: Column, limit: int) -> Column:
    """At most ``limit`` UTF-16 units. Bytes bound the units, so most texts need only their size."""
    return (F.octet_length(content) <= limit) | (utf16_length(content) <= limit)


def _binary(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(folder)
    )
