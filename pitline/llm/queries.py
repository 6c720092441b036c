"""The registered queries of this subpackage: each operator on its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.llm import (
    conversation_trie,
    decontamination,
    exact_dedup,
    html_text,
    packing,
    pii,
    quality,
    simhash,
    substrings,
    token_counts,
    toxicity,
    vector_codes,
    vector_search,
)
from pitline.llm.common import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


SQL["op8_nearest"] = """WITH e AS (SELECT DISTINCT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
 FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
 SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
 AS rank, vec_id, score FROM s) WHERE rank <= 20"""


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Integer k-means, one pair of tables per round."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT p.vec_id, p.part, min(CAST(list_inner_product(p.v, p.v)
 - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) * {entries} + c.entry) AS m
 FROM p JOIN c{i} c USING (part) GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN
 (SELECT part, entry, list(floor(s / n) ORDER BY pos) AS v FROM (SELECT part, m % {entries} AS entry, pos,
 sum(x) AS s, count(*) AS n FROM (SELECT a.part, a.m, unnest(p.v) AS x, unnest(range(len(p.v))) AS pos
 FROM a{i} a JOIN p USING (vec_id, part)) GROUP BY ALL) GROUP BY ALL) n USING (part, entry))""")
    return f"""WITH k AS (SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
 WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
 p AS MATERIALIZED (SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v
 FROM k, range({parts}) t(part)),
 c0 AS MATERIALIZED (SELECT part, entry, v FROM (SELECT part, v, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1
 AS entry FROM p) WHERE entry < {entries}), {", ".join(steps)},
 books AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM
 (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS pos FROM c{rounds})),
 e AS (SELECT vec_id, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code,
 CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
 FROM e JOIN k USING (vec_id), books"""


SQL["op11_vector_codes"] = _codes_sql()

SQL["op12_exact_dedup"] = """WITH t AS (SELECT doc_id,
 translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
 SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
 row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256 FROM t"""

SQL["op13_conversation_trie"] = """WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(
 [n, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS tab),
 t AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
 l AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, sha256(strlen(r) || ':' || r || x)) AS l
 FROM t GROUP BY conv_id),
 c AS (SELECT conv_id, l, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''),
 lambda ch: CAST(ascii(ch) AS BIGINT))), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 6 AS h
 FROM l, crc),
 r AS (SELECT c.conv_id, coalesce(b.l[1:c.h], []) || c.l[c.h + 1:] AS l FROM c LEFT JOIN c b
 ON b.conv_id = c.conv_id - c.conv_id % 100),
 p AS (SELECT conv_id, d, l[1:d] AS k, len(l) AS n FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r)),
 u AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs,
 coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends,
 (count(*) - 1) * coalesce(length(k[d].x), 0) AS value FROM p GROUP BY d, k),
 q AS (SELECT p.conv_id, p.d, u.conv_id AS rep FROM p JOIN u USING (d, k)),
 v AS (SELECT u.*, q.rep AS parent FROM u LEFT JOIN q ON q.conv_id = u.conv_id AND q.d = u.d - 1),
 w AS (SELECT v.*, coalesce(kids.n, 0) AS n_children FROM v LEFT JOIN
 (SELECT parent, d - 1 AS d, count(*) AS n FROM v WHERE d > 0 GROUP BY ALL) kids ON kids.parent = v.conv_id AND kids.d = v.d),
 s AS (SELECT q.rep, q.d, CAST(sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
 CAST(sum(w.value) AS BIGINT) AS saved FROM w JOIN q ON q.conv_id = w.conv_id AND q.d <= w.d GROUP BY ALL)
 SELECT w.conv_id, w.d AS depth, w.parent AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved AS saved_tokens,
 sha256(w.ends) AS ends_sha256 FROM w JOIN s ON s.rep = w.conv_id AND s.d = w.d"""


@query
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_passages(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))
