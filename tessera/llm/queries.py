"""One query for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


from tessera.llm.common import documents


def tokenizer_path() -> str:
    """The vocabulary file that the contracts name; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.content_store import content_store

    return content_store(documents(spark, sf_dir), tokenizer_path())


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.media import media_digests

    return media_digests(documents(spark, sf_dir))


def op3_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.chat import collapse_and_render

    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_metric_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mtree import top_inner_products

    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import line_decisions

    return line_decisions(documents(spark, sf_dir))


def op6_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import bpe_digests

    return bpe_digests(documents(spark, sf_dir), tokenizer_path())


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import predicted_languages

    return predicted_languages(documents(spark, sf_dir))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


def op9_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.lattice import lattice_scores

    return lattice_scores(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.mixing import mix_digest

    return mix_digest(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_content_store, op2_media_columns, op3_snapshot_collapse, op4_metric_tree, op5_line_dedup, op6_bpe_transducer, op7_language_id, op8_near_duplicates, op9_lattice_score, op10_source_mix)}

ORACLE: dict[str, str] = {
    "op3_snapshot_collapse": """
        WITH c AS (
            SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
                   string_agg('<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || chr(10)
                              || replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
            FROM conversations GROUP BY conv_id
        ), one AS (SELECT min(conv_id) AS conv_id, turns, any_value(rendered) AS rendered FROM c GROUP BY turns)
        SELECT a.conv_id, CAST(len(a.turns) AS INTEGER) AS n_turns, a.rendered FROM one a
        WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.turns[1] = a.turns[1] AND len(b.turns) > len(a.turns) AND b.turns[1:len(a.turns)] = a.turns)""",
    "op4_metric_tree": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), p AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
        QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20""",
    "op5_line_dedup": """
        WITH l AS (
            SELECT doc_id, CAST(i AS INTEGER) AS line_no, list_filter(regexp_split_to_array(t[i + 1], '[ \\x09\\x0B-\\x0D]+'), lambda x: x <> '') AS w
            FROM (SELECT doc_id, string_split(text, chr(10)) AS t, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
        ), k AS (SELECT doc_id, line_no, w FROM l WHERE len(w) > 0),
        f AS (SELECT w, min(struct_pack(d := doc_id, n := line_no)) AS fst FROM k GROUP BY w),
        u AS (SELECT w, fst, len(w) >= 10 AS by_word, array_to_string(w, ' ') AS s FROM f WHERE len(w) >= 10 OR length(array_to_string(w, ' ')) >= 20),
        v AS (SELECT w, fst, by_word, -1 AS pos, s AS cut FROM u
              UNION ALL SELECT w, fst, by_word, pos, array_to_string(list_concat(w[1:pos], w[pos + 2:]), ' ') FROM (SELECT *, unnest(range(len(w))) AS pos FROM u WHERE by_word)
              UNION ALL SELECT w, fst, by_word, pos, substring(s, 1, pos) || substring(s, pos + 2) FROM (SELECT *, unnest(range(length(s))) AS pos FROM u WHERE NOT by_word)),
        near AS (
            SELECT a.w, min(b.fst) AS near FROM v a JOIN v b ON a.by_word = b.by_word AND a.cut = b.cut
             AND (a.pos = b.pos OR a.pos < 0 OR b.pos < 0) AND b.fst < a.fst GROUP BY a.w
        ), g AS (SELECT k.doc_id, k.line_no, CASE WHEN struct_pack(d := doc_id, n := line_no) > f.fst THEN f.fst ELSE near.near END AS x
                 FROM k JOIN f ON k.w = f.w LEFT JOIN near ON k.w = near.w)
        SELECT doc_id, line_no, x IS NULL AS kept, x.d AS dup_doc, x.n AS dup_line FROM g""",
}
