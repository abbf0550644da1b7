"""Text files as a corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.text import is_blank
from corpusmill.operators.maintenance import EXTENSIONS

EMPTY = "empty text file"  # fixed value: warning for a blank or unreadable file


def scan_files(spark: SparkSession, path: str, exts: list[str] = EXTENSIONS) -> DataFrame:
    """Files with an allowed extension: path, title, type, size, SHA-256 and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.filter(extension.isin(exts)).select(
        "path",
        F.regexp_replace(name, r"\.[^.]+$", "").alias("title"),
        extension.alias("file_type"),
        F.col("length").alias("file_size"),
        F.sha2("content", 256).alias("file_hash"),
        "content",
    )


def decode_text(files: DataFrame) -> DataFrame:
    """Adds ``text`` (UTF-8, else GB18030) and ``warning`` for files that are blank or neither.

    Only content that is not UTF-8 goes to Python; Spark has no GB18030 decoder.
    """

    @F.pandas_udf("string")
    def gb18030(contents: pd.Series) -> pd.Series:
        def read(content: bytes | None) -> str | None:
            try:
                return None if content is None else content.decode("gb18030")
            except UnicodeDecodeError:
                return None

        return contents.map(read)

    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(utf8, gb18030(F.when(utf8.isNull(), F.col("content"))))
    return files.withColumn("text", F.regexp_replace(text, r"\r\n?", "\n")).withColumn(
        "warning", F.when(is_blank(F.col("text")), F.lit(EMPTY))
    )


def decoded_documents(files: DataFrame) -> DataFrame:
    """Decoded files that hold text."""
    return decode_text(files).filter(F.col("warning").isNull()).drop("content", "warning")
