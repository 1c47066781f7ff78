"""JSON and XML documents, read by the format their extension routes to.

Values stay text: ``007`` is not a number. A malformed document is one row with its text in ``_corrupt_record``. XML
attributes get a ``_`` before their name; mixed content is split, so a document that must be written back byte for byte
is read with ``whole`` instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.keys import extension


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("primitivesAsString", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", False)
    return (reader.schema(schema) if schema else reader).load(path)


def whole(spark: SparkSession, path: str) -> DataFrame:
    """path, ext, content: each document as it is."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", extension(F.col("path")).alias("ext"), "content")


def read_documents(spark: SparkSession, path: str, table: DataFrame) -> DataFrame:
    """The documents under ``path`` that a route (columns ext, action) opens, whole, with their action."""
    return whole(spark, path).join(table, "ext")
