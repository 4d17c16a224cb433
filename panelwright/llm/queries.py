"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm.bpe import op10_bpe
from panelwright.llm.centroids import CENTROIDS, ROUNDS, op13_centroids
from panelwright.llm.html_text import op6_html
from panelwright.llm.langid import op4_langid
from panelwright.llm.licenses import BASE, op3_licenses
from panelwright.llm.media import op2_media
from panelwright.llm.packing import op5_packing
from panelwright.llm.quality import op8_quality
from panelwright.llm.simhash import op9_simhash
from panelwright.llm.suffix_dedup import op1_suffix_array
from panelwright.llm.topk import op11_topk
from panelwright.llm.toxicity import op7_toxicity
from panelwright.llm.whitening import op12_whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": op1_suffix_array,
    "op2_media": op2_media,
    "op3_licenses": op3_licenses,
    "op4_langid": op4_langid,
    "op5_packing": op5_packing,
    "op6_html": op6_html,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_bpe": op10_bpe,
    "op11_topk": op11_topk,
    "op12_whitening": op12_whitening,
    "op13_centroids": op13_centroids,
}



def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op3_licenses`` says of the base phrases."""
    return op3_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ``op8_quality`` counts, and the base rule's verdict."""
    return op8_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES |= {"license_base": license_base, "quality_counts": quality_counts}

_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _rounds(rounds: int) -> str:
    """The assignments a0, a1, ... and centroids c1, c2, ... in turn, from the first centroids c0."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, any_value(x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT v.r, v.x, k.c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{i} AS k)
  GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""
s{i} AS (SELECT c, p, sum(y) AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, unnest(range(64)) AS p FROM a{i}) GROUP BY c, p),
c{i + 1} AS MATERIALIZED (
  SELECT k.c, coalesce(m.x, k.x) AS x
  FROM c{i} AS k LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS x FROM s{i} GROUP BY c
  ) AS m USING (c)
)""")
    return ",".join(parts)


#: Of the others, SQL lacks the hash, the image format, the tokenizer, the parser, the sketch or the learnt model.
ORACLE_SQL: dict[str, str] = {
    "license_base": rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
places AS (
  SELECT doc_id, len(w) AS n_words, {", ".join(f"list_filter(range(len(w)), lambda i: w[i + 1 : i + {len(p.split())}] = {p.split()!r}) AS p{k}" for k, p in enumerate(BASE))} FROM d
)
SELECT doc_id, n_words, ({" + ".join(f"len(p{k})" for k in range(len(BASE)))})::BIGINT AS n_base,
  least({", ".join(f"list_min(p{k})" for k in range(len(BASE)))}) AS first_word, greatest({", ".join(f"list_max(p{k})" for k in range(len(BASE)))}) AS last_word,
  array_to_string(list_sort(list_distinct(list_filter([{", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, label in enumerate(BASE.values()))}], lambda v: v IS NOT NULL))), ',') AS base_labels
FROM places
""",
    "quality_counts": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
five AS (SELECT r, i, w[i + 1 : i + 5] AS x FROM (SELECT r, w, unnest(range(len(w) - 4)) AS i FROM d)),
twice AS (SELECT r, x FROM five GROUP BY r, x HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 5)) AS p FROM five SEMI JOIN twice USING (r, x)),
rep AS (SELECT r, count(*) AS n FROM covered GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda v: length(v))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  len(w) < 10 OR 100 * coalesce(rep.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
""",
    "op1_suffix_array": """
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
),
s AS (
  SELECT r, p, md5_number(b[p + 1 : p + 200]) AS h
  FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS p FROM d)
),
twice AS (SELECT h FROM s GROUP BY h HAVING count(*) > 1),
hit AS (SELECT s.r, s.p FROM s SEMI JOIN twice USING (h)),
edge AS (
  SELECT r, p, p > coalesce(lag(p) OVER w, -201) + 200 AS fresh FROM hit WINDOW w AS (PARTITION BY r ORDER BY p)
),
run AS (SELECT r, p, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM edge),
cut AS (SELECT r, k, min(p) AS a, max(p) + 200 AS z FROM run GROUP BY r, k),
gap AS (
  SELECT r, coalesce(lag(z) OVER w, 0) AS a, a AS z FROM cut WINDOW w AS (PARTITION BY r ORDER BY a)
  UNION ALL
  SELECT d.r, coalesce(max(cut.z), 0), any_value(octet_length(d.b)) FROM d LEFT JOIN cut USING (r) GROUP BY d.r
),
kept AS (
  SELECT gap.r, unhex(string_agg(hex(d.b[gap.a + 1 : gap.z]), '' ORDER BY gap.a)) AS b
  FROM gap JOIN d USING (r) GROUP BY gap.r
),
sums AS (SELECT r, sum(z - a) AS n_removed, count(*) AS n_spans FROM cut GROUP BY r)
SELECT d.doc_id, octet_length(d.b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(kept.b) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN sums USING (r)
""",
    "op11_topk": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE {_USABLE}
),
s AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, v.r AS other, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 20 = 0) AS q JOIN v ON q.r <> v.r
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other)::INTEGER AS rank FROM s)
WHERE rank <= 20
""",
    "op13_centroids": f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE {_USABLE} AND len(embedding) = 64
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v
  ORDER BY sha256('2:' || vec_id) NULLS LAST, x LIMIT {CENTROIDS}
),{_rounds(ROUNDS)},
i AS (SELECT c, sum(d)::BIGINT AS cluster_inertia FROM a{ROUNDS} GROUP BY c)
SELECT v.vec_id, a.c::INTEGER AS cluster, a.d AS distance, i.cluster_inertia, (SELECT sum(d)::BIGINT FROM a{ROUNDS}) AS inertia,
  sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{ROUNDS} AS a JOIN v USING (r) JOIN i USING (c) JOIN c{ROUNDS} AS k USING (c)
""",
}
