"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, tune
from . import chat_format, cotraining, exact_dedup, license_scan, line_dedup, mixing, ngram_join, piece_codec, prefix_trie, quality_rules, simhash, token_align, token_counts
from .shared import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

BYTE_JSON = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_soft_mixing(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "labels"))[0]


@query
def op2_exact_dedup(spark, sf):
    return exact_dedup.mark_copies(table(spark, sf, "documents"))


@query
def op3_chat_format(spark, sf):
    """The recovered turns of transcripts built from the labelled turns, without their texts."""
    lines = chat_format.transcripts(table(spark, sf, "conversations"))
    turns = chat_format.render(chat_format.parse(lines, chat_format.fit(lines)))
    return turns.select("conv_id", "turn_no", "role", "n_lines", F.sha2("text", 256).alias("text_sha256"))


@query
def op4_ngram_join(spark, sf):
    return ngram_join.near_copies(table(spark, sf, "documents"), n=4, percent=85)


@query
def op5_quality_rules(spark, sf):
    return quality_rules.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op6_piece_codec(spark, sf):
    coded = piece_codec.code(table(spark, sf, "documents"), PIECE_MODEL, whole=False)
    return coded.select("doc_id", *[F.col(f"_piece_code.{c}").alias(c) for c in ("n_tokens", "ids_sha256", "decoded_sha256")])


@query
def op7_token_counts(spark, sf):
    """Documents of the flat token files made from all texts."""
    path = shared_path(spark, "flat")
    token_counts.write_flat(table(spark, sf, "documents"), path, BYTE_RANKS, public_tokenizers.PATTERN)
    found = token_counts.count(spark, path)
    # the writer names files part-<task>-<job>-c<number>.txt
    return found.withColumn("file", F.regexp_replace("file", "^part-(\\d+)-.*-c(\\d+).*$", "$1-$2"))


@query
def op8_line_dedup(spark, sf):
    return line_dedup.dropped(table(spark, sf, "documents"))


@query
def op9_cotraining(spark, sf):
    return cotraining.train_and_score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_license_scan(spark, sf):
    return license_scan.scan(table(spark, sf, "documents"))


@query
def op11_simhash(spark, sf):
    return simhash.near_copies(table(spark, sf, "documents"), n=4)


@query
def op12_token_align(spark, sf):
    return token_align.summary(table(spark, sf, "documents"), BYTE_JSON, PIECE_MODEL)


@query
def op13_prefix_trie(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


def license_sql() -> str:
    """Dice of distinct word bigrams of lines and whole texts against the templates."""
    names = sorted(license_scan.TEMPLATES)
    templates = " UNION ALL ".join("SELECT '{}' AS license, '{}' AS body".format(k, license_scan.TEMPLATES[k].replace("'", "''")) for k in names)
    words = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    most = max(license_scan.bounds(len(g), license_scan.LEAST)[1] for g in license_scan.template_bigrams(license_scan.TEMPLATES).values())
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
        units AS (
            SELECT doc_id, unnest(parts) AS unit, (generate_subscripts(parts, 1) - 1)::INTEGER AS line_no FROM d
            UNION ALL
            SELECT doc_id, text, -1 FROM d WHERE len(parts) > 1),
        split AS (SELECT doc_id, line_no, {words.format("unit")} AS w FROM units),
        grams AS (SELECT doc_id, line_no, {pairs} AS g FROM split WHERE len(w) > 1 AND len(list_distinct(w)) <= {most + 1}),
        t AS (SELECT license, {pairs} AS tg FROM (SELECT license, {words.format("body")} AS w FROM ({templates})))
        SELECT doc_id, line_no, license, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice
        FROM grams JOIN t ON 2.0 * len(list_intersect(g, tg)) / (len(g) + len(tg)) >= {license_scan.LEAST}
    """


# Texts are equal when identical after lower-casing A-Z; the largest doc_id of equal texts stays.
SQL: dict[str, str] = {
    "op2_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
            doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256)
    """,
    "op10_license_scan": license_sql(),
    # the fixed number is the polynomial of CRC-32, least bit first
    "op13_prefix_trie": """
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
            sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, digest) AS said FROM t GROUP BY conv_id),
    heads AS (
        SELECT conv_id, said, conv_id - conv_id % 5 AS first,
            xor(4294967295::BIGINT, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) % 9 AS h
        FROM own),
    whole AS (
        SELECT a.conv_id, list_concat(coalesce(b.said[1:a.h], []), a.said[a.h + 1:]) AS said
        FROM heads a LEFT JOIN own b ON b.conv_id = a.first),
    prefixes AS (SELECT conv_id, len(said) AS whole_len, unnest(range(len(said) + 1)) AS depth, said FROM whole),
    members AS (SELECT conv_id, depth, said[1:depth] AS path, whole_len = depth AS at_end FROM prefixes),
    nodes AS (
        SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
            sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256
        FROM members GROUP BY path, depth),
    kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    valued AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children,
            CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth].text) END AS saved
        FROM nodes n LEFT JOIN kids k USING (path, depth)),
    above AS (SELECT path, n_children, saved, unnest(range(depth + 1)) AS up FROM valued),
    sums AS (
        SELECT path[1:up] AS path, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
        FROM above GROUP BY ALL)
    SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves,
        s.saved_tokens::BIGINT AS saved_tokens, v.ends_sha256
    FROM valued v JOIN sums s USING (path, depth)
    LEFT JOIN nodes p ON p.depth = v.depth - 1 AND p.path = v.path[1:v.depth - 1]
    """,
}
