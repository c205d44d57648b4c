"""The operators as queries over the test tables, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing, bm25_decontam, fill_in_middle, gru_lm, host_paths, ngram_join, quality_fm, soft_mixing, suffix_dedup, url_filter, vp_negatives, warc, winnowing


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.as_responses(_table(spark, sf_dir, "pages")))


def op2_gru_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru_lm.scores(_table(spark, sf_dir, "documents"))


def op3_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.main_text(_table(spark, sf_dir, "pages"))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(_table(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"))


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_vp_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = _table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), label.alias("label"), (F.col("vec_id") % 100 == 0).alias("anchor"), F.col("embedding").alias("vector"),
    )
    return vp_negatives.hard_negatives(given, scale=256.0)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(_table(spark, sf_dir, "documents"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {
        "op1_warc_derivatives": op1_warc_derivatives,
        "op2_gru_language_model": op2_gru_language_model,
        "op3_host_paths": op3_host_paths,
        "op4_winnowing": op4_winnowing,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_bm25_decontamination": op6_bm25_decontamination,
        "op7_soft_mixing": op7_soft_mixing,
        "op8_url_filter": op8_url_filter,
        "op9_suffix_array_dedup": op9_suffix_array_dedup,
        "op10_quality_fm": op10_quality_fm,
        "op11_vp_hard_negatives": op11_vp_hard_negatives,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_best_fit_packing": op13_best_fit_packing,
    }


#: Words as the contract has them, shingles as strings (words hold no space), and roots carried along the links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
sides AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.doc_id AND reach.root < sides.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY 1
"""

#: Every 400-byte window by its digest, runs of repeated windows' starts, and what is left between them; the same runs of 200-byte
#: windows, whose words are runs of hex pairs other than those of white space.
REPEATED_STRINGS = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
pos AS (SELECT doc_id, l, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), CAST(2 * l AS BIGINT))) AS k FROM (SELECT doc_id, h, l, unnest(range(n - l + 1)) AS i FROM d, (VALUES (200), (400)) AS t(l) WHERE n >= l)),
rep AS (SELECT l, k FROM pos GROUP BY ALL HAVING count(*) > 1),
st AS (SELECT doc_id, l, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id, l ORDER BY i) + l OR lag(i) OVER (PARTITION BY doc_id, l ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM pos SEMI JOIN rep USING (l, k)),
gr AS (SELECT doc_id, l, i, sum(new) OVER (PARTITION BY doc_id, l ORDER BY i) AS grp FROM st),
runs AS (SELECT doc_id, l, min(i) AS a, max(i) + l AS z FROM gr GROUP BY doc_id, l, grp),
sp AS (SELECT doc_id, a, z FROM runs WHERE l = 400),
cut AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS b, a AS e FROM sp UNION ALL SELECT doc_id, max(z), any_value(n) FROM sp JOIN d USING (doc_id) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * b + 1 AS BIGINT), CAST(2 * (e - b) AS BIGINT)), '' ORDER BY b) AS h FROM cut JOIN d USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM sp GROUP BY 1),
long AS (SELECT doc_id, z - a AS size FROM runs JOIN d USING (doc_id) WHERE l = 200
  AND len(list_filter(regexp_split_to_array(regexp_replace(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)), '(..)', '\1,', 'g'), '\b(20|09|0A|0B|0C|0D),'), lambda x: x <> '')) > 50),
passages AS (SELECT doc_id, count(*) AS n_passages, CAST(sum(size) AS BIGINT) AS passage_bytes FROM long GROUP BY 1)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256,
  coalesce(n_passages, 0) AS n_passages, coalesce(passage_bytes, 0) AS passage_bytes
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN passages USING (doc_id)
"""


#: All scores of all anchors, by brute force.
HARD_NEGATIVES = r"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, br, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, other, br) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.br ORDER BY s.score DESC, s.other, s.br) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

#: Tokens as a list of matches; pieces are slices of it.
FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[ 	-
]*[^ 	-
]+|[ 	-
]+') AS w, list_transform(range(4), lambda i: CAST('0x' || h[8 * i + 1 : 8 * i + 8] AS BIGINT)) AS r FROM d),
c AS (SELECT doc_id, t, w, len(w) AS n, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS lo, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:lo], '') AS p, array_to_string(w[lo + 1:hi], '') AS m, array_to_string(w[hi + 1:n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m) ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    """The other operators' results depend on hashes, models or text rules that SQL doesn't have; tests/llm holds them against brute force."""
    return {
        "op5_ngram_jaccard_join": NEAR_DUPLICATES, "op9_suffix_array_dedup": REPEATED_STRINGS, "op11_vp_hard_negatives": HARD_NEGATIVES,
        "op12_fill_in_middle": FILL_IN_MIDDLE,
    }
