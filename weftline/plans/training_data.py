"""Queries of the general operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.operators.run_diffs import run_differences


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_differences(spark.read.parquet(f"{sf_dir}/setup_bundles.parquet"), spark.read.parquet(f"{sf_dir}/exec_results.parquet"))


QUERIES = {"p2_found": p2_found}

_VALUE = "CASE WHEN regexp_full_match({0}, '\\s*[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*') THEN '#' || CAST(CAST(trim({0}) AS DOUBLE) AS VARCHAR) WHEN trim({0}) = '' THEN '' ELSE {0} END"

ORACLES = {
    "p2_found": f"""
        WITH runs AS (
            SELECT exec_id, example_id, output_records FROM (SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY received_at DESC) AS rn FROM exec_results)
            WHERE rn = 1 AND run_status = 'FINISHED_OK' AND output_records IS NOT NULL),
        both_ AS (SELECT exec_id, golden_records, output_records FROM runs JOIN setup_bundles USING (example_id) WHERE golden_records IS NOT NULL),
        g AS (SELECT exec_id, r['row_key'] AS row_key, r FROM (SELECT exec_id, unnest(golden_records) AS r FROM both_)),
        o AS (SELECT exec_id, r['row_key'] AS row_key, r FROM (SELECT exec_id, unnest(output_records) AS r FROM both_)),
        j AS (SELECT coalesce(g.exec_id, o.exec_id) AS exec_id, coalesce(g.row_key, o.row_key) AS row_key, g.r AS gr, o.r AS rr
              FROM g FULL JOIN o ON g.exec_id = o.exec_id AND g.row_key = o.row_key),
        f AS (SELECT exec_id, row_key, gr, rr, unnest(list_distinct(list_concat(map_keys(gr), map_keys(rr)))) AS field_name FROM j WHERE gr IS NOT NULL AND rr IS NOT NULL),
        v AS (SELECT exec_id, row_key, field_name, gr[field_name] AS a, rr[field_name] AS b FROM f WHERE field_name NOT IN ('__meta', 'row_key'))
        SELECT exec_id, row_key, '' AS field_name, CASE WHEN rr IS NULL THEN 'missing_in_output' ELSE 'missing_in_golden' END AS diff_kind FROM j WHERE gr IS NULL OR rr IS NULL
        UNION SELECT exec_id, row_key, field_name, 'value_differs' FROM v WHERE {_VALUE.format('a')} IS DISTINCT FROM {_VALUE.format('b')}""",
}
