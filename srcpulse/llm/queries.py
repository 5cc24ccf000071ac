"""The operators over their whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcpulse.llm import decontaminate, exact, hard_negatives, language_model, lexical, packing, pii, repeats, simhash, token_counts, token_files, toxicity, url_templates
from srcpulse.llm.common import documents

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(documents(spark, sf_dir), with_text=True)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), TOKENIZER)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_documents(token_files.write_ids(documents(spark, sf_dir), TOKENIZER))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.report(decontaminate.find_items(documents(spark, sf_dir), items))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir).select("doc_id", "text")).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.spans(documents(spark, sf_dir), everywhere=True))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), TOKENIZER)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    mined = hard_negatives.mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label=label)
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) % 5 == 1
    scored = language_model.score(docs, language_model.fit(docs, ~held_out("doc_id")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_token_counts, op3_token_files, op4_simhash, op5_url_templates, op6_decontaminate, op7_exact_dedup,
        op8_pii, op9_packing, op10_toxicity, op11_hard_negatives, op12_language_model, op13_lexical_search,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"[x for x in string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> '']"
_NO_TERM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
ORACLE: dict[str, str] = {
    "op5_url_templates": url_templates.judge_sql(RULES),
    "op6_decontaminate": f"""
    WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
      windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS grams
        FROM items, unnest(range(greatest(len(w) - 9, 1))) t(i) WHERE len(w) > 0),
      docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
      sizes AS (SELECT DISTINCT n FROM windows),
      runs AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS grams FROM docs, sizes, unnest(range(len(w) - n + 1)) t(i)),
      hits AS (SELECT doc_id, r.n, i, item_id FROM runs r JOIN windows USING (n, grams)),
      words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, n, i FROM hits), unnest(range(n)) u(j) GROUP BY 1),
      found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_exact_dedup": r"""
    WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
      doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM norm""",
    "op11_hard_negatives": """
    WITH vectors AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
      scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
        FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
      positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
      negatives AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
          row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
        FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5""",
    "op13_lexical_search": rf"""
    WITH tokens AS (SELECT doc_id, [x for x in string_split_regex({_LOWER}, '{_NO_TERM}+') if x <> ''] AS w FROM documents),
      sizes AS (SELECT doc_id, len(w) AS n FROM tokens WHERE len(w) > 0),
      total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
      wanted AS (SELECT DISTINCT item_id, unnest([x for x in string_split_regex({_LOWER}, '{_NO_TERM}+') if x <> '']) AS t FROM benchmark),
      counts AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM tokens) WHERE t IN (SELECT t FROM wanted) GROUP BY ALL),
      weights AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
        FROM (SELECT t, count(*) AS df FROM counts GROUP BY t), total),
      impacts AS (SELECT doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // terms)) AS impact
        FROM counts JOIN sizes USING (doc_id), total),
      scored AS (SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM wanted JOIN weights USING (t) JOIN impacts USING (t) GROUP BY ALL),
      ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 10""",
}
