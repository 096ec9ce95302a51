"""Queries of the training-data operators, with SQL for those that SQL can express."""

from __future__ import annotations

from tilewright.llm import groups, languages, leaks, quantiles, quota_sample, terms, tokens
from tilewright.sources.tables import table as t

QUERIES = {
    "p1_found": lambda s, d: quantiles.p1_found(t(s, d, "final_trees"), t(s, d, "class_table")),
    "p1_percentiles": lambda s, d: quantiles.p1_percentiles(t(s, d, "final_trees"), t(s, d, "class_table")),
    "p1_counts": lambda s, d: quantiles.p1_counts(t(s, d, "final_trees"), t(s, d, "class_table")),
    "p2_found": lambda s, d: quota_sample.p2_found(t(s, d, "training_data"), t(s, d, "sample_targets"), t(s, d, "class_table")),
    "p2_report": lambda s, d: quota_sample.p2_report(t(s, d, "training_data"), t(s, d, "sample_targets"), t(s, d, "class_table")),
    "p2_targets": lambda s, d: quota_sample.p2_report(t(s, d, "training_data"), t(s, d, "sample_targets"), t(s, d, "class_table")).select("training_set", "seg_class", "available", "wanted"),
    "p2_totals": lambda s, d: quota_sample.p2_totals(t(s, d, "training_data"), t(s, d, "sample_targets"), t(s, d, "class_table")),
    "p2_sample": lambda s, d: quota_sample.p2_sample(t(s, d, "training_data"), t(s, d, "sample_targets"), t(s, d, "class_table")),
    "p3_found": lambda s, d: groups.p3_found(t(s, d, "training_data")),
    "p3_split": lambda s, d: groups.p3_split(t(s, d, "training_data")),
    "p3_checks": lambda s, d: groups.p3_checks(t(s, d, "training_data")),
    "p5_found": lambda s, d: terms.p5_found(t(s, d, "training_data"), t(s, d, "edits")),
    "p5_terms": lambda s, d: terms.p5_terms(t(s, d, "training_data"), t(s, d, "edits")),
    "p6_ids": lambda s, d: tokens.p6_ids(t(s, d, "documents")),
    "p6_texts": lambda s, d: tokens.p6_texts(t(s, d, "documents")),
    "p7_found": lambda s, d: leaks.p7_found(t(s, d, "documents"), t(s, d, "eval_items")),
    "p7_tiles": lambda s, d: leaks.p7_tiles(t(s, d, "documents"), t(s, d, "eval_items")),
    "p7_report": lambda s, d: leaks.p7_report(t(s, d, "documents"), t(s, d, "eval_items")),
    "p8_found": lambda s, d: languages.p8_found(t(s, d, "documents")),
    "p8_languages": lambda s, d: languages.p8_languages(t(s, d, "documents")),
}

_TERMS = """
WITH field AS (
  SELECT 'seg_class' AS field, row_id AS id, seg_class AS v FROM training_data
  UNION ALL SELECT 'to_class', row_number() OVER (), to_class FROM edits
  UNION ALL SELECT 'from_class', row_number() OVER (), from_class FROM edits
), term AS (
  SELECT * FROM (SELECT field, id, unnest(regexp_split_to_array(upper(v), '[\\s\\x0b\\x1c-\\x1f]+')) AS term FROM field) WHERE term <> ''
), total AS (
  SELECT field, count(DISTINCT id) AS of FROM term GROUP BY field
), counted AS (
  SELECT field, term, count(*) AS occurrences, count(DISTINCT id) AS records FROM term GROUP BY field, term
), marked AS (
  SELECT field, term, occurrences, records, records <= 2 AS is_rare, records >= CAST(0.2 AS DOUBLE) * of AS is_common FROM counted JOIN total USING (field)
)
"""

_TREES = """
WITH latest AS (
  SELECT *, lower(regexp_replace(class, '^\\s+|\\s+$', '', 'g')) AS tree_class FROM final_trees WHERE fid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY fid ORDER BY delivered_at DESC NULLS LAST) = 1
), v AS (
  SELECT batch_id, tree_class, m.measure AS measure, m.v AS v
  FROM (SELECT batch_id, tree_class, unnest([{'measure': 'height', 'v': height}, {'measure': 'crown_area', 'v': crown_area}]) AS m FROM latest)
  WHERE tree_class IN (SELECT lower(label) FROM class_table WHERE is_tree) AND m.v > 0 AND NOT isnan(m.v) AND NOT isinf(m.v)
)"""
_HAVE = """
WITH latest AS (
  SELECT training_set, upper(regexp_replace(seg_class, '^\\s+|\\s+$', '', 'g')) AS seg_class FROM training_data WHERE fid IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY fid ORDER BY extracted_at DESC NULLS LAST, row_id) = 1
), have AS (
  SELECT training_set, seg_class, count(*) AS n FROM latest WHERE seg_class IN (SELECT code FROM class_table) GROUP BY training_set, seg_class
)"""
_TIED = """
WITH RECURSIVE key AS (
  SELECT row_id, 'f' || fid AS k FROM training_data WHERE fid IS NOT NULL
  UNION ALL SELECT row_id, 't' || type || ' ' || training_fid FROM training_data WHERE type IS NOT NULL AND training_fid >= 1
), edge AS (
  SELECT DISTINCT a.row_id AS u, b.u AS v FROM key a JOIN (SELECT k, min(row_id) AS u FROM key GROUP BY k) b USING (k)
), both_ways AS (
  SELECT u, v FROM edge WHERE u <> v UNION SELECT v, u FROM edge WHERE u <> v
), reach AS (
  SELECT u AS row_id, u AS r FROM both_ways UNION SELECT reach.row_id, e.v FROM reach JOIN both_ways e ON e.u = reach.r
)"""

ORACLE = {
    # exact percentiles in place of digests: the cases are far from the limits
    "p1_found": _TREES
    + """, p AS (SELECT unnest([50, 90]) AS pct),
own AS (
  SELECT batch_id, tree_class, measure, pct, count(*) AS n, CASE pct WHEN 50 THEN quantile_disc(v, 0.5) ELSE quantile_disc(v, 0.9) END AS q
  FROM v CROSS JOIN p WHERE batch_id IS NOT NULL GROUP BY batch_id, tree_class, measure, pct
), every AS (
  SELECT tree_class, measure, pct, CASE pct WHEN 50 THEN quantile_disc(v, 0.5) ELSE quantile_disc(v, 0.9) END AS w FROM v CROSS JOIN p GROUP BY tree_class, measure, pct
)
SELECT batch_id, tree_class, measure, pct FROM own JOIN every USING (tree_class, measure, pct) WHERE n >= 100 AND (q <= CAST(0.6 AS DOUBLE) * w OR q >= CAST(1.7 AS DOUBLE) * w)
""",
    "p1_counts": _TREES + """
SELECT batch_id, tree_class, measure, n, whole FROM (SELECT batch_id, tree_class, measure, count(*) AS n FROM v GROUP BY batch_id, tree_class, measure) JOIN (SELECT tree_class, measure, count(*) AS whole FROM v GROUP BY tree_class, measure) USING (tree_class, measure)
""",
    "p2_targets": _HAVE + """
SELECT t.training_set, t.seg_class, coalesce(h.n, 0) AS available, CAST(ceil(greatest(t.min_rows, round(t.target_share * t.sample_rows, 6))) AS BIGINT) AS wanted FROM sample_targets t LEFT JOIN have h ON t.training_set = h.training_set AND t.seg_class = h.seg_class
""",
    # as many rows as wanted, or the floors if they are more, or all there are if they are fewer
    "p2_totals": _HAVE + """, s AS (
  SELECT t.training_set, CAST(least(greatest(max(t.sample_rows), sum(least(t.min_rows, coalesce(h.n, 0)))), sum(coalesce(h.n, 0))) AS BIGINT) AS quota FROM sample_targets t LEFT JOIN have h ON t.training_set = h.training_set AND t.seg_class = h.seg_class GROUP BY t.training_set
)
SELECT training_set, quota, quota AS sampled FROM s
""",
    "p2_found": _HAVE + """
SELECT t.training_set, t.seg_class FROM sample_targets t LEFT JOIN have h ON t.training_set = h.training_set AND t.seg_class = h.seg_class
WHERE coalesce(h.n, 0) < greatest(t.min_rows, round(t.target_share * t.sample_rows))
""",
    "p3_found": _TIED + """
SELECT row_id, min(r) AS group_id FROM reach GROUP BY row_id
""",
    "p3_checks": _TIED + """
SELECT (SELECT count(row_id) FROM training_data) AS rows, (SELECT count(row_id) FROM training_data) - (SELECT count(DISTINCT row_id) FROM reach) + (SELECT count(DISTINCT g) FROM (SELECT min(r) AS g FROM reach GROUP BY row_id)) AS groups, CAST(0 AS BIGINT) AS parted, true AS even
""",
    "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p5_found": _TERMS + "SELECT field, term, 'rare' AS mark FROM marked WHERE is_rare UNION ALL SELECT field, term, 'common' FROM marked WHERE is_common",
    "p5_terms": _TERMS + "SELECT field, term, occurrences, records, is_rare, is_common FROM marked",
}
