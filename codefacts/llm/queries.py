"""The queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .common import table


def vocabulary_path() -> str:
    """The public vocabulary of query op5; another file can be named in CODEFACTS_VOCABULARY."""
    named = os.environ.get("CODEFACTS_VOCABULARY")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_formatting import format_conversations, read_back

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return read_back(format_conversations(turns.unionByName(extra)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import digests

    return digests(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import by_first_position, mix

    # The rows stand in training order; op4_training_order has a row for each reading.
    return by_first_position(mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "first_position")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import by_position, mix, training_order

    return by_position(training_order(mix(table(spark, sf_dir, "documents"))))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nn_descent import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import apply_rules, learn

    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, learn(docs, table(spark, sf_dir, "labels")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_mixing": op4_mixing,
    "op4_training_order": op4_training_order,
    "op5_bpe": op5_bpe,
    "op6_nn_descent": op6_nn_descent,
    "op7_quality_rules": op7_quality_rules,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_quality_classifier": op10_quality_classifier,
}

ORACLE = {
    "op2_chat_formatting": """
        WITH t AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
          UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        s AS (SELECT *, row_number() OVER w AS nth, coalesce(lag(role) OVER w, '') AS state FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
        f AS (SELECT conv_id AS f_id, arg_min(CASE role WHEN '' THEN 'no role' ELSE role END || ' after ' || CASE state WHEN '' THEN 'start' ELSE state END, nth) AS fault FROM s
          WHERE (state, role) NOT IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) GROUP BY conv_id)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
          CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
          CAST(sum(26 + length(regexp_replace(regexp_replace(replace(replace(role, chr(92), repeat(chr(92), 2)), chr(10), chr(92) || 'n'), '<(\\\\*)\\|', '<\\1\\\\|', 'g'), '<(\\\\*)\\|', '<\\1|', 'g'))
            - 2 + length(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g'))) AS BIGINT) AS formatted_chars,
          any_value(fault) AS fault
        FROM t LEFT JOIN f ON conv_id IS NOT DISTINCT FROM f_id GROUP BY conv_id""",
    "op3_suffix_dedup": """
        WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS k, hex(encode(coalesce(text, ''))) AS h, row_number() OVER () AS r FROM documents),
        n AS (SELECT *, length(h) // 2 AS n_bytes FROM d),
        w AS (SELECT r, k, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT r, k, h, unnest(range(n_bytes - 49)) AS i FROM n WHERE n_bytes >= 50)),
        g AS (SELECT r, i FROM (SELECT r, i, k, min(k) OVER (PARTITION BY s) AS least FROM w) WHERE least < k),
        m AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS is_new FROM g),
        b AS (SELECT r, i, sum(is_new) OVER (PARTITION BY r ORDER BY i) AS run FROM m),
        x AS (SELECT r, run, min(i) AS a, max(i) + 50 AS z FROM b GROUP BY r, run),
        e AS (SELECT r, a, z, lead(a) OVER (PARTITION BY r ORDER BY a) AS next_a, row_number() OVER (PARTITION BY r ORDER BY a) AS nth FROM x),
        c AS (SELECT n.r, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans,
                string_agg(CASE WHEN nth = 1 THEN substr(h, 1, 2 * a) ELSE '' END || substr(h, 2 * z + 1, 2 * (coalesce(next_a, n_bytes) - z)), '' ORDER BY a) AS kept
              FROM e JOIN n ON e.r = n.r GROUP BY n.r)
        SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM n LEFT JOIN c ON n.r = c.r""",
    "op4_mixing": """
        WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk FROM s),
        w AS (SELECT *, CAST(CASE rnk % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM r),
        l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
                / sum(weight) OVER (ORDER BY source_size / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        f AS (SELECT *, level * weight >= source_size * 2.0::DOUBLE AS is_full FROM l),
        g AS (SELECT arg_min(level, source_size / weight + rnk * 1e-9) AS at FROM f WHERE NOT is_full),
        u AS (SELECT source, source_size, rnk, CASE WHEN is_full THEN source_size * 2.0::DOUBLE ELSE g.at * weight END AS target FROM f LEFT JOIN g ON true),
        v AS (SELECT *, floor(target) AS goal_words, CASE rnk % 2 WHEN 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END AS a FROM u),
        t AS (SELECT *, sum(goal_words * a) OVER () AS early, sum(goal_words * (1.0::DOUBLE - a)) OVER () AS late FROM v),
        p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.a, t.early, t.late, CAST(floor(t.target) AS BIGINT) AS goal,
                CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        x AS (SELECT *, CASE WHEN st < goal OR size = 0 THEN least(1.0::DOUBLE, coalesce(CAST(st AS DOUBLE) / nullif(CAST(goal AS DOUBLE), 0), 0.0::DOUBLE)) END AS part FROM p),
        y AS (SELECT *, (sqrt(a * a + 4.0::DOUBLE * (1.0::DOUBLE - a) * part) - a) / (2.0::DOUBLE * (1.0::DOUBLE - a)) AS tm FROM x)
        SELECT doc_id, size, source_size, target,
          greatest(0, least(size, goal - st)) + greatest(0, least(size, goal - source_size - st)) AS taken, early * tm + late * tm * tm AS first_position FROM y""",
}
