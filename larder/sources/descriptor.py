"""Application descriptors: nested JSON with icons and file associations.

The schema is explicit: inferred, the MIME types of ``accept`` would become column names. A member of another type than the
schema's reads as null there, without a word; ``members`` and ``accepted_anyhow`` read descriptors as variants instead, tell
what is unknown or mistyped, and take an extension given as text where a list should be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.keys import extension, resolved, size_part

ICON = "STRUCT<src:STRING, sizes:STRING, type:STRING, purpose:STRING>"
SCHEMA = f"""name STRING, short_name STRING, description STRING, start_url STRING, scope STRING, display STRING,
background_color STRING, theme_color STRING, lang STRING, icons ARRAY<{ICON}>,
file_handlers ARRAY<STRUCT<action:STRING, accept:MAP<STRING,ARRAY<STRING>>, icons:ARRAY<{ICON}>, launch_type:STRING>>"""


def read_descriptor(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row a descriptor file, or with ``lines`` one a line; a malformed one is a row of nulls."""
    return spark.read.schema(SCHEMA).json(path, multiLine=not lines)


def located(apps: DataFrame, url: Column) -> DataFrame:
    """The descriptors with entry URL, scope and actions as absolute URLs, seen from ``url``, where each was read."""
    handler = lambda h: h.withField("action", resolved(h["action"], url))
    return apps.withColumns({"start_url": resolved(F.col("start_url"), url), "scope": resolved(F.col("scope"), url), "file_handlers": F.transform("file_handlers", handler)})


def parse_descriptor(text: Column) -> Column:
    return F.from_json(text, SCHEMA)


def metadata(apps: DataFrame) -> DataFrame:
    """The scalar fields: names, description, language, entry URL, scope and display."""
    return apps.select("name", "short_name", "description", "lang", "start_url", "scope", "display", "background_color", "theme_color")


def icon_fields(i: Column) -> list[Column]:
    return [i["src"].alias("src"), i["sizes"].alias("sizes"), size_part(i["sizes"], 0).alias("width"), size_part(i["sizes"], 1).alias("height"), i["type"].alias("type"), F.coalesce(i["purpose"], F.lit("any")).alias("purpose")]


def icons(apps: DataFrame) -> DataFrame:
    """One row an icon; a missing purpose is ``any``, a size that is not WxH has no width and height."""
    return apps.select("name", F.explode("icons").alias("i")).select("name", *icon_fields(F.col("i")))


def handlers(apps: DataFrame) -> DataFrame:
    """One row a file handler."""
    return apps.select("name", F.explode("file_handlers").alias("h")).select("name", "h.action", "h.accept", "h.icons", F.coalesce("h.launch_type", F.lit("single-client")).alias("launch_type"))


def handler_icons(apps: DataFrame) -> DataFrame:
    return handlers(apps).select("name", "action", F.explode("icons").alias("i")).select("name", "action", *icon_fields(F.col("i")))


def accepted(apps: DataFrame) -> DataFrame:
    """name, action, launch_type, mime, ext (lower-cased): a row for each extension of each MIME type."""
    types = handlers(apps).select("name", "action", "launch_type", F.explode("accept").alias("mime", "exts"))
    return types.select("name", "action", "launch_type", "mime", F.explode("exts").alias("ext")).withColumn("ext", F.lower("ext"))


def routes(apps: DataFrame) -> DataFrame:
    """ext to action; an extension that several MIME types list is one route."""
    return accepted(apps).select("ext", "action", "launch_type").distinct()


def route_files(files: DataFrame, table: DataFrame, path: str = "path", most: int = 100_000) -> DataFrame:
    """The files that a route opens, each with its action.

    Files have few extensions, so a shuffle would put most of them in one task: up to ``most`` routes (an extension and an
    action each, and counted first) are broadcast.
    """
    return files.withColumn("ext", extension(F.col(path))).join(F.broadcast(table) if table.count() <= most else table, "ext")


def opened(files: DataFrame, table: DataFrame, path: str = "path", launch: str = "launch_id") -> DataFrame:
    """launch_id, action, window, file: the files of ``launches`` as rows, for launches of any number of files.

    ``window`` is empty for the one window of a single-client launch, else the file that has a window of its own.
    """
    found = route_files(files, table, path)
    alone = F.when(F.col("launch_type") == "single-client", F.lit("")).otherwise(F.col(path))
    return found.select(launch, "action", alone.alias("window"), F.col(path).alias("file"))


def launches(files: DataFrame, table: DataFrame, path: str = "path", launch: str = "launch_id") -> DataFrame:
    """Files opened together: all of a single-client launch go to one window, others each to its own.

    A launch is one row with an array of its files, so one task holds them; ``opened`` has them as rows.
    """
    return opened(files, table, path, launch).groupBy(launch, "action", "window").agg(F.array_sort(F.collect_list("file")).alias("files")).drop("window")


#: The members of a descriptor and their kinds: fixed values of the web-app descriptor format.
KINDS = {c: "STRING" for c in ("name", "short_name", "description", "start_url", "scope", "display", "background_color", "theme_color", "lang")} | {"icons": "ARRAY", "file_handlers": "ARRAY"}


def read_variants(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """path, text, v: one row a descriptor file, or with ``lines`` one a line, as a variant; v is null for a malformed one."""
    texts = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return texts.withColumn("v", F.try_parse_json("text"))


def kind_of(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ..., VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def members(apps: DataFrame) -> DataFrame:
    """The columns of ``apps`` but v, with a row for each member of its v: member, kind and reason.

    The reason is ``unknown`` for a member that the format lacks, ``mistyped`` for one of another kind than the format's,
    null for the others. A descriptor that is no JSON object is one row, without member, with the reason ``malformed``.
    """
    rest = [c for c in apps.columns if c != "v"]
    is_object = F.coalesce(kind_of(F.col("v")) == "OBJECT", F.lit(False))
    found = apps.where(is_object).lateralJoin(apps.sparkSession.tvf.variant_explode(F.col("v").outer()))
    wanted = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("key")]
    found = found.select(*rest, F.col("key").alias("member"), kind_of(F.col("value")).alias("kind"), wanted.alias("_wanted"))
    reason = F.when(F.col("_wanted").isNull(), "unknown").when(F.col("kind") != F.col("_wanted"), "mistyped")
    none = F.lit(None).cast("string")
    bad = apps.where(~is_object).select(*rest, none.alias("member"), none.alias("kind"), F.lit("malformed").alias("reason"))
    return found.select(*rest, "member", "kind", reason.alias("reason")).unionByName(bad)


def accepted_anyhow(apps: DataFrame) -> DataFrame:
    """The columns of ``apps`` but v, with action, mime, ext (lower-cased) and reason: ``accepted`` of descriptors as variants.

    What a type accepts should be a list of texts. A single text is taken as a list of one (reason ``text``); what is no text,
    or no list, is a row without ext (``mistyped``), and a text without a leading dot stays, as ``no extension``. Handlers that
    are no objects, or whose accept is none, have one row without mime (``mistyped``).
    """
    rest = [c for c in apps.columns if c != "v"]
    each = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    rows = apps.select(*rest, F.explode(each(F.col("v"), "$.file_handlers")).alias("_h"))
    types = F.when(kind_of(F.try_variant_get("_h", "$.accept", "variant")) == "OBJECT", F.try_variant_get("_h", "$.accept", "map<string,variant>"))
    rows = rows.select(*rest, F.try_variant_get("_h", "$.action", "string").alias("action"), F.explode_outer(types).alias("mime", "_e"))
    kind = kind_of(F.col("_e"))
    texts = F.when(kind == "ARRAY", each(F.col("_e"), "$")).otherwise(F.array("_e"))
    # An empty list accepts nothing, and is well formed.
    rows = rows.where(~F.coalesce((kind == "ARRAY") & (F.size(texts) == 0), F.lit(False)))
    rows = rows.select(*rest, "action", "mime", (kind == "STRING").alias("_alone"), (kind == "ARRAY").alias("_list"), F.explode(texts).alias("_x"))
    text = F.when((kind_of(F.col("_x")) == "STRING") & (F.col("_alone") | F.col("_list")), F.lower(F.try_variant_get("_x", "$", "string")))
    reason = F.when(F.col("ext").isNull(), "mistyped").when(~F.startswith("ext", F.lit(".")), "no extension").when(F.col("_alone"), "text")
    return rows.withColumn("ext", text).select(*rest, "action", "mime", "ext", reason.alias("reason"))
