"""Benchmark decontamination by a prefix-filtered set join, by DataFrame functions alone.

Every run of ``size`` consecutive words of an item is a window (an item of fewer words is one window). A document holds
a window only if it holds all its words, so with containment 1 the necessary prefix of a window, its words ordered by
rarity, is its rarest word. Documents meet windows on that word alone; then

* position: the window starts ``offset`` words before the meeting, so not before the document,
* length: and must end within it;
* exact check: the words there equal the window's.

Rarity is the count of the word in all documents; it decides the work, never the result. Windows with equal words are one
window; the items that have it are kept in a table of their own and join the documents' sets of windows, each distinct set
once, so a passage that very many items or documents share is looked up once.

Windows of at most ``most_windows`` rows and ``most_bytes`` are broadcast. Beyond that (a benchmark of a gigabyte) words meet
prefix words in one shuffle join, in which frequent words are dealt out over salts; both ways give the same rows.

Nulls: a null or wordless text has no words and no hits; null item_ids count as the item ''. Repeated document rows give
equal output rows; repeated items are one. Very long texts are matched whole, a word a row. Words of equal rarity are taken
by word, then place. An empty benchmark gives every document 0 hits, no documents no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import ascii_lower, broadcast_if_small, saved, with_unique

#: Most bytes of window words that are broadcast.
MOST_BYTES = 32 << 20
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text; none for null."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), lambda w: w != "")


def windows_of(items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """wid, win (its words), n of each distinct window, and wid, item of its items (written tables)."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    rows = words.select("item", "w", F.explode(starts).alias("at")).select("item", F.slice("w", F.col("at"), size).alias("win")).distinct()
    windows = rows.select("win").distinct().select(F.monotonically_increasing_id().alias("wid"), "win", F.size("win").alias("n"))
    windows = saved(windows, "windows")
    # A window that very many items share is one row here.
    return windows, saved(with_unique(rows, windows.select("wid", "win"), "win").select("wid", "item"), "window-items")


def counted(words: DataFrame, asked: DataFrame, small: bool) -> DataFrame:
    """word, count of the asked words in the column ``w`` (a written table)."""
    each = words.select(F.explode("w").alias("word"))
    if small:
        return saved(each.join(F.broadcast(asked), "word").groupBy("word").count(), "rarity")
    return saved(each.groupBy("word").count().join(asked, "word", "left_semi"), "rarity")


def at_prefix(rows: DataFrame, prefix: DataFrame, small: bool, hot: int) -> DataFrame:
    """``rows`` (with w and other columns) at each place ``pos`` whose word is a window's prefix, with the prefix's columns."""
    if small:
        return rows.select("*", F.posexplode("w").alias("pos", "word")).join(F.broadcast(prefix), "word")
    # A word with more than ``hot`` places is dealt out over salts; there is at most one for each ``hot`` places.
    salts = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / hot + 1e-9)
    crowded = broadcast_if_small(saved(prefix.where(F.col("c") > hot).select("word", salts(F.col("c")).alias("_salts")).distinct(), "crowded-words"))
    places = rows.select("row", F.posexplode("w").alias("pos", "word"))
    dealt = places.join(crowded, "word", "left").withColumn("_salt", F.pmod(F.xxhash64("row", "pos"), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    copies = prefix.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(salts(F.col("c")), F.lit(1)) - 1)))
    return dealt.join(copies, ["word", "_salt"]).drop("_salt")


def find_windows(docs: DataFrame, windows: DataFrame, most_windows: int = 200_000, most_bytes: int = MOST_BYTES, hot: int = 1_000_000) -> DataFrame:
    """key (struct of doc_id and the text's hash), n_words, copies, spans (start, n, wid; 0-based words) of each document."""
    text = docs.select("doc_id", F.xxhash64("text").alias("hash"), words_of(F.col("text")).alias("w"))
    n, size = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.array_join("win", " "))), F.lit(0))).first()
    small = n <= most_windows and size <= most_bytes
    if not small:
        text = saved(text.withColumn("row", F.monotonically_increasing_id()), "tokens")

    # Rarity of the windows' words over all documents. A window with a word that no document has cannot occur.
    seen = counted(text, windows.select(F.explode("win").alias("word")).distinct(), small)
    places = windows.select("wid", "win", "n", F.posexplode("win").alias("offset", "word"))
    places = places.join(broadcast_if_small(seen), "word", "left") if small else places.join(seen, "word", "left")
    rarest = places.groupBy("wid", "win", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "word", "offset")).alias("p"))
    prefix = saved(rarest.where("p.c > 0").select("wid", "win", "n", "p.c", "p.word", "p.offset"), "prefix")

    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("n") <= F.size("w"))
    equal = fits & (F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")) == F.col("win"))
    span = F.struct(start.alias("start"), "n", "wid").alias("span")
    key = F.struct("doc_id", "hash").alias("key")
    if small:
        # One row more for each document, whether it has a window or not: the place before its first word, of the empty word.
        blank = prefix.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("wid"), F.array().cast("array<string>").alias("win"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("c"), F.lit("").alias("word"), F.lit(0).alias("offset"))
        met = at_prefix(text.withColumn("w", F.concat(F.array(F.lit("")), "w")), prefix.unionByName(blank), True, hot)
        rows = met.where((F.col("wid") < 0) | ((start >= 1) & equal)).select(key, (F.size("w") - 1).alias("n_words"), F.when(F.col("wid") >= 0, F.struct((start - 1).alias("start"), "n", "wid")).alias("span"))
    else:
        met = at_prefix(text, prefix.drop("win"), False, hot).where(start >= 0).select("row", "wid", "n", "pos", "offset").distinct()
        near = with_unique(saved(met, "candidates"), windows.select("wid", "win"), "wid").join(text, "row").where(equal).select(key, F.size("w").alias("n_words"), span)
        rows = near.unionByName(text.select(key, F.size("w").alias("n_words"), F.lit(None).cast(near.schema["span"].dataType).alias("span")))
    own = F.sum(F.when(F.col("span").isNull(), 1).otherwise(0)).cast("int")
    return rows.groupBy("key").agg(F.max("n_words").alias("n_words"), own.alias("copies"), F.collect_set("span").alias("spans"))


def repeated(rows: DataFrame, times: str, run: int = 10_000) -> DataFrame:
    """Each row as often as its column ``times`` says, in runs, so that no array holds all its copies."""
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / run).cast("int"))))
    return runs.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(run), F.col(times) - F.col("_run") * run)))).drop("_run", "_copy")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, digest: bool = False, **how: int) -> DataFrame:
    """doc_id, hash, n_words, n_hit, n_items, items, contaminated: a row for each row of ``docs``.

    With ``digest`` the column ``items`` is the SHA-256 of the comma-joined ids in place of their array.
    """
    windows, has = windows_of(items, size)
    found = find_windows(docs, windows, **how)
    # Hit words: the union of the spans, by one pass in order of their starts.
    hit = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["end"], s["start"] + s["n"]).alias("end"),
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    found = found.select("key", "n_words", "copies", hit.alias("n_hit"), F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["wid"]))).alias("wids"))
    found = saved(found, "found")

    # The items of each distinct set of windows.
    sets = saved(found.where(F.size("wids") > 0).select("wids").distinct(), "window-sets")
    each = sets.select("wids", F.explode("wids").alias("wid")).join(has, "wid").groupBy("wids").agg(F.array_sort(F.collect_set("item")).alias("items"))
    of = lambda ids: F.sha2(F.array_join(ids, ","), 256) if digest else ids
    sets = saved(each.select("wids", F.size("items").cast("long").alias("n_items"), of(F.col("items")).alias("items")), "set-items")
    hits = with_unique(found.where(F.size("wids") > 0), sets, "wids").drop("wids")
    none = found.where(F.size("wids") == 0).drop("wids").withColumns({"n_items": F.lit(0).cast("long"), "items": of(F.array().cast("array<string>"))})
    return repeated(hits.unionByName(none), "copies").select("key.doc_id", "key.hash", F.col("n_words").cast("long").alias("n_words"), "n_hit", "n_items", "items", (F.col("n_hit") > 0).alias("contaminated"))
