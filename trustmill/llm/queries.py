"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, fingerprints, language, line_dedup, minhash, negatives, packing, pii, secrets, token_table, url_rules, warc
from .shared import joined_sha256, new_table_path, table

#: The written rules, (verdict, host with path).
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _spans(spans: Column, kinds: Column | None = None) -> Column:
    """kind:start:end of each, comma-joined."""
    named = lambda s: s.kind if kinds is None else F.get(kinds, s.kind)
    return F.transform(spans, lambda s: F.concat_ws(":", named(s), s.start.cast("string"), s.end.cast("string")))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = packing.pack(docs, capacity=2048, end_id=0, payload={"ids_crc32": F.crc32("ids")})
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), joined_sha256(F.col("item_ids")).alias("items_sha256"), "contaminated")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = pii.KINDS[:4]
    of = lambda *kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    return found.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base), joined_sha256(_spans(of(*base))).alias("base_sha256"), F.array_join(_spans(F.col("spans")), ",").alias("spans"), (F.size("spans") > 0).alias("personal"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.lit(list(secrets.KINDS))
    base = F.filter("spans", lambda s: s.kind < 3)
    of = lambda k: F.filter("spans", lambda s: s.kind == k)  # noqa: E731 (a second parameter of the inner one would be the span's place)
    counts = [F.size(of(k)).cast("long").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, joined_sha256(_spans(base, kinds)).alias("base_sha256"), F.array_join(_spans(F.col("spans"), kinds), ",").alias("spans"), (F.size("spans") > 0).alias("secret"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))  # with the numbers of lines behind the columns
    return kept.select("doc_id", F.col("_tm_lines").cast("long").alias("n_lines"), F.col("_tm_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op8_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "tokens")
    token_table.write(table(spark, sf_dir, "documents"), path, end_id=2)
    return token_table.digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op11_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_table_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"), "fault")


def damaged(turns: DataFrame) -> DataFrame:
    """What op12 repairs: by the checksum of `conv_id:turn` some turns go, lose their text or its ends, come twice or change their role."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = turns.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("harm")).filter("harm <> 0")
    x = x.withColumn("text", F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    x = x.withColumn("role", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")))
    return x.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.when(F.col("harm") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    edits, report = conversations.repair(damaged(turns))
    piece = F.concat(F.coalesce("role", F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    hashes = conversations.text_hashes(edits.filter("edit <> 'D'"), F.col("key"), ["pos", "nth"], piece)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    found = turns.select("conv_id", key.alias("key")).distinct().join(report.drop("conv_id"), "key", "left").join(hashes, "key", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select("conv_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0, id_col="vec_id").drop("anchor_row")


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_decontamination, op3_pii, op4_language_id, op5_secrets, op6_line_dedup, op7_minhash_near_dedup, op8_token_table, op9_simhash, op10_url_rules, op11_warc_reassembly, op12_conversation_repair, op13_hard_negatives)}

_WORDS2 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS2} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS2} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') AS win
       FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, k, size, array_to_string(w[k : k + size - 1], ' ') AS win
       FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(k) WHERE len(w) >= size),
hit AS (SELECT DISTINCT doc_id, k, size, item_id FROM dw JOIN bw USING (size, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, k, size FROM hit), unnest(range(k, k + size)) AS t(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
h AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, h.key IS NOT NULL AND l.doc_id <> h.first_doc AS dropped FROM l LEFT JOIN h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
""",
    "op7_minhash_near_dedup": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k : k + 3], ' ')) AS sh FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT sym.b, r.root FROM r JOIN sym ON sym.a = r.node AND r.root < sym.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN c ON c.node = doc_id
""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
""",
}
