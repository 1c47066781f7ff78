"""Chat formatting with typed content parts, by DataFrame functions alone.

A conversation becomes one string: for each turn ``<|turn|>role<|text|>body<|end|>``. A visitor over the parts of a
turn writes text parts escaped and puts one ordered placeholder for each image, audio or document part; the k-th
placeholder of a conversation belongs to the k-th attachment record. Inside texts a backslash is doubled and ``<|``
becomes ``<\\|``, so no text can hold a marker and ``unescape`` restores it exactly.

``segments`` has for each turn the role, the place of its body in the string (0-based start and length in code points)
and whether it is under the loss mask (roles in ``loss_roles``).

Nulls: a null text is empty, a null role is an empty role, null parts are none, a null part type is text, an unknown type
is a document. Turns are ordered by turn (nulls first), then role and parts, so ties and repeated rows have a fixed order.
Rows with a null conv_id form one conversation. One conversation is one output row by definition: its turns meet in
one task. Empty texts are empty bodies; very long ones are formatted whole, by functions of linear time. No rows give no
conversation. Columns other than conv_id, turn, role and parts are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that an attachment expands to where its part does not say.
TOKENS = {"image": 256, "audio": 128, "document": 512}
PARTS = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as its one part."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens"))
    return F.array(part).cast(PARTS)


def kind(part: Column) -> Column:
    name = F.coalesce(part["type"], F.lit("text"))
    return F.when(name.isin("text", *TOKENS), name).otherwise(F.lit("document"))


def format_chat(turns: DataFrame, loss_roles: Sequence[str] = ("assistant",), tokens: Mapping[str, int] = TOKENS) -> DataFrame:
    """conv_id, formatted, segments, attachments, attachment_tokens from rows conv_id, turn, role, parts."""
    visit = lambda p: F.when(kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(p), F.lit("|>")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS)).alias("parts"))
    # One shuffle, of the turns as they came; the window and the aggregate below keep its partitioning.
    rows = rows.repartition("conv_id").withColumns({"_role": escape(F.col("role")), "_body": F.array_join(F.transform("parts", visit), "")})
    rows = rows.withColumn("_size", F.length("_role") + F.length("_body") + len(TURN) + len(TEXT) + len(END))

    # The place of each turn is a running sum over its predecessors, row by row.
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "parts").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_at": F.row_number().over(before), "_end": F.sum("_size").over(before)})
    start = (F.col("_end") - len(END) - F.length("_body")).cast("int")
    each = F.transform(F.filter("parts", lambda p: kind(p) != "text"), lambda p: F.struct((F.col("_at") - 1).alias("turn_index"), kind(p).alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")))
    turn = F.struct(
        F.col("_at").alias("at"),
        F.concat(F.lit(TURN), "_role", F.lit(TEXT), "_body", F.lit(END)).alias("piece"),
        F.struct(F.col("_role").alias("role"), start.alias("start"), F.length("_body").alias("length"), F.col("role").isin(*loss_roles).alias("loss")).alias("segment"),
        each.alias("attached"),
    )
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_t"))

    given = F.create_map(*[F.lit(x) for pair in tokens.items() for x in pair])
    attached = F.transform(F.flatten("_t.attached"), lambda p, i: F.struct(i.alias("ordinal"), p["turn_index"].alias("turn_index"), p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], given[p["type"]].cast("bigint"), F.lit(0)).alias("tokens")))
    out = convs.select("conv_id", F.array_join("_t.piece", "").alias("formatted"), F.col("_t.segment").alias("segments"), attached.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]))


def read_chat(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns read back from a formatted string; placeholders stay as they are."""
    piece = F.slice(F.split(formatted, r"\Q" + TURN + r"\E", -1), 2, 1 << 30)
    half = lambda p: F.split(F.substring_index(p, END, 1), r"\Q" + TEXT + r"\E", -1)
    return F.transform(piece, lambda p: F.struct(unescape(half(p)[0]).alias("role"), unescape(half(p)[1]).alias("text")))


def loss_text(formatted: Column, segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")
