"""Contract queries of the thirteen operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, language_id, language_model, packing, prefix_trie, quality, simhash, spelling, substring_dedup, token_counts, toxicity, warc
from .common import table


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    training = docs.where(F.coalesce(_remainder(7), F.lit(0)) != 2)
    counts = table(language_model.word_counts(training), "word-counts")
    model = language_model.train(training, counts)
    scored = language_model.score(docs, model, counts)
    return scored.select(
        "doc_id", (_remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 2048)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_read(spark, sf_dir, "pages"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Model:
    """The quality model, learned from rows whose remainder by 5 is not 0."""
    labels = _read(spark, sf_dir, "labels").where(_remainder(5) != 0).select("doc_id", F.col("quality").alias("label"))
    return quality.train(_read(spark, sf_dir, "documents"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").where(_remainder(4) != 2).select("doc_id", F.col("toxic").alias("label"))
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "passages")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(_read(spark, sf_dir, "documents"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_read(spark, sf_dir, "documents"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    net = language_id.train(docs.where(F.coalesce(_remainder(3), F.lit(0)) != 1))
    return language_id.predict(docs, net).select("doc_id", (_remainder(3) == 1).alias("held_out"), "lang_pred", "score")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_simhash": op8_simhash,
    "op9_language_model": op9_language_model,
    "op10_token_counts": op10_token_counts,
    "op11_spelling": op11_spelling,
    "op12_language_id": op12_language_id,
    "op13_prefix_trie": op13_prefix_trie,
}


def _crc_step(k: int) -> int:
    """What four bits at the low end add to a CRC-32."""
    for _ in range(4):
        k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
    return k


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 in DuckDB; its code points are below U+0800."""
    steps = [_crc_step(k) for k in range(16)]
    table_of = lambda c: f"xor({c} >> 4, {steps}[CAST(({c} & 15) + 1 AS INT)])"
    code = f"list_transform(string_split({text}, ''), lambda x: unicode(x))"
    octets = f"flatten(list_transform({code}, lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 | (u >> 6), 128 | (u & 63)] END))"
    halves = f"flatten(list_transform({octets}, lambda o: [o & 15, o >> 4]))"
    folded = f"list_reduce(list_transform(list_concat([4294967295], {halves}), lambda b: CAST(b AS BIGINT)), lambda c, b: {table_of('xor(c, b)')})"
    return f"xor({folded}, 4294967295)"


ORACLE_SQL = {
    "op1_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS s
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)
        ), rep AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM win) WHERE k > 1
        ), gone AS (
            SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM rep) GROUP BY doc_id
        ), kept AS (
            SELECT w.doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN gone USING (doc_id)
        ), flat AS (
            SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM kept)
            ANTI JOIN (SELECT doc_id, unnest(ps) AS i FROM gone) g USING (doc_id, i)
        ), joined AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM flat GROUP BY doc_id
        )
        SELECT kept.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM kept LEFT JOIN joined USING (doc_id)""",
    "op5_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
        ), g AS (
            SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
        ), b AS (
            SELECT *, list_reduce(list_transform(range(40), lambda i:
                lpad(bin(strpos('0123456789abcdef', substr(hex, CAST(i + 1 AS INT), 1)) - 1), 4, '0')),
                lambda x, y: x || y) AS bits
            FROM g
        )
        SELECT page_id, strlen(html) AS payload_bytes,
               list_reduce(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + list_sum(list_transform(range(5), lambda k:
                       CAST(substr(bits, CAST(5 * i + k + 1 AS INT), 1) AS INT) * CAST(pow(2, 4 - k) AS INT))) AS INT), 1)),
                   lambda x, y: x || y) AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM b""",
    "op7_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op11_spelling": rf"""
        WITH RECURSIVE run AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents
        ), counted AS (
            SELECT doc_id, run, count(*) AS k, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM run WHERE length(run) >= 6 GROUP BY doc_id, run
        ), word AS (
            SELECT w AS word, CAST(sum(k) AS BIGINT) AS n FROM (
                SELECT k, CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS w FROM counted
            ) GROUP BY w HAVING sum(k) >= 5 AND length(w) >= 6
        ), less AS (
            SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)
        ), pair AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.rest = b.word
            UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.rest = b.word
        ), near AS (
            SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS best, max(near_n) AS best_n FROM pair GROUP BY word
        ), formed AS (
            SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n
            FROM word LEFT JOIN near USING (word)
        ), walk AS (
            SELECT word, word AS here FROM formed UNION ALL SELECT walk.word, form FROM walk JOIN formed ON here = formed.word WHERE form IS NOT NULL
        ), ended AS (
            SELECT walk.word, here AS root FROM walk JOIN formed ON here = formed.word WHERE form IS NULL
        )
        SELECT word, form, root, n, n_near, form_n FROM formed JOIN ended USING (word)""",
    "op13_prefix_trie": f"""
        WITH turn AS (
            SELECT conv_id, turn, sha256(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, length(coalesce(text, '')) AS size
            FROM conversations WHERE conv_id IS NOT NULL
        ), own AS (
            SELECT conv_id, list({{'d': d, 'size': size}} ORDER BY turn NULLS FIRST, d, size) AS ts FROM turn GROUP BY conv_id
        ), hashed AS (
            SELECT *, CAST({crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS INT) AS h FROM own
        ), built AS (
            SELECT c.conv_id, list_concat(coalesce(b.ts, [])[1:c.h], c.ts[c.h + 1:]) AS ts FROM hashed c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
        ), prefix AS (
            SELECT conv_id, len(ts) AS total, CAST(depth AS BIGINT) AS depth, array_to_string(list_transform(ts[1:depth], lambda t: t.d), '') AS path,
                   array_to_string(list_transform(ts[1:depth - 1], lambda t: t.d), '') AS above, CASE WHEN depth > 0 THEN ts[depth].size ELSE 0 END AS size
            FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS depth FROM built)
        ), node AS (
            SELECT path, depth, CASE WHEN depth > 0 THEN any_value(above) END AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE total = depth), '')) AS ends_sha256
            FROM prefix GROUP BY path, depth
        ), child AS (
            SELECT above AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY above
        ), leafy AS (
            SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (path)
        ), below AS (
            SELECT a.path, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, CAST(sum(b.saved) AS BIGINT) AS saved_tokens FROM leafy a JOIN leafy b ON starts_with(b.path, a.path) GROUP BY a.path
        )
        SELECT leafy.conv_id, leafy.depth, up.conv_id AS parent_conv_id, leafy.n_convs, leafy.n_children, n_leaves, saved_tokens, leafy.ends_sha256
        FROM leafy JOIN below ON leafy.path = below.path LEFT JOIN node up ON leafy.above = up.path""",
}
