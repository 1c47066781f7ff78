"""The queries opN_<name> and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import chat, decontam, html, importance, langid, lm, manifest, media, mixing, packing, quality, simhash, warc
from larder.llm.common import ascii_lower


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


CONTROL = "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    turns = given.unionByName(extra).withColumn("parts", chat.text_parts(F.col("text")))
    done = chat.format_chat(turns).withColumn("_read", chat.read_chat(F.col("formatted"))).withColumn("_loss", chat.loss_text(F.col("formatted"), F.col("segments")))
    lines = F.array_join(F.transform("_read", lambda r: F.concat(r["role"], F.lit("\n"), r["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("_read").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(23 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.remainder("doc_id", 5) == 0
    find = langid.predictor(docs, langid.fit(docs.where(~held_out)))
    return docs.select("doc_id", held_out.alias("held_out"), find("text").alias("found")).select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text", (langid.remainder("doc_id", 7) == 2).alias("held_out")))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), digest=True)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.col("items").alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, w[s:s + least(len(w), 10) - 1] AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM b WHERE len(w) > 0)
), pos AS (
  SELECT rid, w, unnest(range(1, len(w) + 1)) AS s FROM d
), hit AS (
  SELECT rid, s, n, item FROM pos JOIN win ON w[s] = win[1] AND w[s:s + n - 1] = win
), words AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY rid
), items AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY rid
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores, _ = quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")), payload=False)
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("bigint")
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP8_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
  o AS (SELECT digest, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM owner THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM owner THEN owner END AS refers_to
FROM p LEFT JOIN o USING (digest)
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keys = media.digests(docs)
    index = media.store(docs, keys=keys)
    rows = media.attach(docs, media.read_back(index).join(media.with_metadata(index), "digest"), keys=keys)
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth", "shard", "offset", "length")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 of an ASCII or UTF-8 text in DuckDB: bytes, then eight shifts each.
CRC = "xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, octet_length(encode({x})) + 1), lambda i: ('0x' || substr(hex(encode({x})), 2 * i - 1, 2))::UBIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, k: xor(v >> 1, 3988292384::UBIGINT * (v & 1::UBIGINT)))))"

OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark
), dw AS (
  SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY ALL
), v AS (
  SELECT word, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM (SELECT word, n AS s, 0 AS t FROM dw UNION ALL SELECT word, 0, 1 FROM b) GROUP BY word
), k AS (
  SELECT word, s, t, ({CRC.format(x="word")} % 10000)::BIGINT AS bucket FROM v
), g AS (
  SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * ((SELECT sum(s) FROM v) + 10000)::DOUBLE / ((sum(s) + 1)::DOUBLE * ((SELECT sum(t) FROM v) + 10000)::DOUBLE)))::BIGINT AS gain FROM k GROUP BY bucket
), m AS (
  SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM dw JOIN k USING (word) JOIN g USING (bucket) GROUP BY rid
), x AS (
  SELECT rid, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(total // n_features - (CASE WHEN total % n_features < 0 THEN 1 ELSE 0 END), 0)::BIGINT AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN m USING (rid)
), y AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM x
), z AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place FROM y
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * (SELECT count(*) FROM y WHERE n_features >= 20) // 100 THEN place END AS rank FROM z
"""


def op12_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.packed(found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "deal"), docs.count())
    return rows.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = docs.select("doc_id", "lang", manifest.leaf([*fields, F.col("text")]).alias("leaf"), F.when(tampered, manifest.leaf([*fields, ascii_lower(F.col("text"))])).alias("claimed"))
    return manifest.prove(rows, "lang", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


OP13_SQL = f"""
WITH RECURSIVE f AS (
  SELECT doc_id, lang, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, coalesce({CRC.format(x="doc_id::VARCHAR")} % 3 = 0, false) AS tampered
  FROM documents
), l AS (
  SELECT doc_id, lang, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf, sha256(head || coalesce(octet_length(encode(low)) || ':' || low, '-')) AS other, tampered FROM f
), leaves AS (
  SELECT doc_id, leaf, CASE WHEN tampered THEN other ELSE leaf END AS claimed, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM l
), nodes AS (
  SELECT tree, 0 AS h, p, n, leaf AS digest FROM leaves
  UNION ALL SELECT tree, h + 1, p // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY p)) FROM nodes WHERE n > 1 GROUP BY tree, h, p // 8, n
), subroots AS (
  SELECT tree, digest AS subroot, max(h) OVER () AS high, count(*) OVER () AS trees FROM nodes WHERE n = 1
), forest AS (
  SELECT high AS h, tree AS p, trees AS n, subroot AS digest FROM subroots
  UNION ALL SELECT h + 1, p // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY p)) FROM forest WHERE n > 1 GROUP BY h, p // 8, n
), pairs AS (
  SELECT v.tree, v.p, x.h, coalesce(string_agg(x.digest, '' ORDER BY x.p) FILTER (x.p < v.p >> (3 * x.h)), '') AS l, coalesce(string_agg(x.digest, '' ORDER BY x.p) FILTER (x.p > v.p >> (3 * x.h)), '') AS r
  FROM leaves v JOIN nodes x ON x.tree = v.tree AND x.n > 1 AND x.p // 8 = v.p >> (3 * x.h + 3) GROUP BY v.tree, v.p, x.h
  UNION ALL
  SELECT v.tree, v.p, x.h, coalesce(string_agg(x.digest, '' ORDER BY x.p) FILTER (x.p < v.tree >> (3 * (x.h - high))), ''), coalesce(string_agg(x.digest, '' ORDER BY x.p) FILTER (x.p > v.tree >> (3 * (x.h - high))), '')
  FROM leaves v JOIN subroots s USING (tree) JOIN forest x ON x.n > 1 AND x.p // 8 = v.tree >> (3 * (x.h - high) + 3) GROUP BY v.tree, v.p, x.h
), paths AS (
  SELECT tree, p, string_agg(l || r, '' ORDER BY h) AS proof, list({{'l': l, 'r': r}} ORDER BY h) AS path FROM pairs GROUP BY tree, p
), folded AS (
  SELECT doc_id, leaf, tree, sha256(coalesce(proof, '')) AS proof_sha256,
    list_reduce(list_prepend({{'l': claimed, 'r': ''}}, coalesce(path, [])), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}}).l AS folded_root
  FROM leaves LEFT JOIN paths USING (tree, p)
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM folded JOIN subroots USING (tree), (SELECT digest AS root FROM forest WHERE n = 1)
"""

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_chat_format": op2_chat_format,
    "op3_main_text": op3_main_text,
    "op4_language": op4_language,
    "op5_lm_score": op5_lm_score,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality": op7_quality,
    "op8_warc": op8_warc,
    "op9_simhash": op9_simhash,
    "op10_media": op10_media,
    "op11_importance": op11_importance,
    "op12_pack": op12_pack,
    "op13_manifest": op13_manifest,
}
SQL = {
    "op2_chat_format": OP2_SQL,
    "op6_decontaminate": OP6_SQL,
    "op8_warc": OP8_SQL,
    "op11_importance": OP11_SQL,
    "op13_manifest": OP13_SQL,
}
