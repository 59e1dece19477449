"""Queries over the test tables and, where SQL can state them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import answer_defects, encoding, format_dups, group_split, leakage, packing, quota_sample

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(operator: Callable[..., DataFrame], *names: str) -> Query:
    """A query that applies ``operator`` to whole tables with its production parameters."""
    return lambda spark, sf_dir: operator(*(_table(spark, sf_dir, n) for n in names))


def _split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _table(spark, sf_dir, "split_targets")
    return group_split.split_report(group_split.assign_splits(_table(spark, sf_dir, "source_examples"), _table(spark, sf_dir, "setup_bundles"), targets), targets)


def queries() -> dict[str, Query]:
    sampled = ("forged_provenance", "setup_bundles", "sample_targets")
    return {
        "p1_found": _over(format_dups.format_duplicates, "source_examples"),
        "p1_collapsed": _over(format_dups.collapse_formats, "source_examples"),
        "p3_found": _over(group_split.group_files, "source_examples"),
        "p3_splits": _over(group_split.assign_splits, "source_examples", "setup_bundles", "split_targets"),
        "p3_split_report": _split_report,
        "p4_found": _over(answer_defects.defective_answers, "forged", "source_examples"),
        "p4_report": _over(answer_defects.defect_report, "forged", "source_examples"),
        "p5_found": _over(quota_sample.unmet_targets, *sampled),
        "p5_sample": lambda spark, sf_dir: _over(quota_sample.draw_sample, *sampled)(spark, sf_dir).select("pair_id", "floor", "seat"),
        "p5_report": _over(quota_sample.sample_report, *sampled),
        "p6_containers": _over(packing.pack_documents, "documents", "pack_sizes"),
        "p6_report": lambda spark, sf_dir: packing.pack_report(_over(packing.pack_documents, "documents", "pack_sizes")(spark, sf_dir)),
        "p7_found": _over(leakage.leaked_tests, "documents", "suite_tests"),
        "p7_paraphrases": _over(leakage.paraphrased_tests, "documents", "suite_tests"),
        "p8_found": _over(encoding.garbled_documents, "documents"),
        "p8_repaired": _over(encoding.repair_documents, "documents"),
    }


_FILE = r"nullif(lower(trim(regexp_replace(source_file, '(?s)^.*[/\\]', ''))), '')"
_AUTHOR = "CASE WHEN lower(trim(meta['author'])) NOT IN ('', 'unknown', 'n/a') THEN lower(trim(meta['author'])) END"
_LABEL = "regexp_replace(upper({}), '[\\s_-]+', '', 'g')"


def oracle_sql() -> dict[str, str]:
    label = _LABEL.format
    return {
        "p3_found": f"""
            WITH RECURSIVE n AS (SELECT rec_id, 'f:' || {_FILE} AS f, 'a:' || {_AUTHOR} AS a FROM source_examples),
            e AS (SELECT DISTINCT f AS u, a AS v FROM n WHERE f IS NOT NULL AND a IS NOT NULL),
            s AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
            r(x, y) AS (SELECT v, v FROM (SELECT f AS v FROM n UNION SELECT a FROM n) WHERE v IS NOT NULL
                        UNION SELECT r.x, s.v FROM r JOIN s ON r.y = s.u)
            SELECT rec_id, substr(min(y), 3) AS group_file FROM n JOIN r ON coalesce(f, a) = x
            WHERE starts_with(y, 'f:') GROUP BY rec_id""",
        "p5_found": f"""
            WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY logged_at DESC NULLS LAST) AS rn FROM forged_provenance) WHERE rn = 1),
            k AS (SELECT pair_id, 'component_type' AS kind, {label('b.component_type')} AS v FROM p JOIN setup_bundles b ON lower(p.example_id) = lower(b.example_id)
                  UNION SELECT pair_id, 'rejected_exec_level', {label('rejected_exec_level')} FROM p
                  UNION SELECT pair_id, 'failure_mode', {label('m')} FROM (SELECT pair_id, unnest(rejected_failure_modes) AS m FROM p)),
            c AS (SELECT kind, v, count(DISTINCT pair_id) AS n FROM k GROUP BY ALL),
            z AS (SELECT count(*) // 5 AS size FROM p)
            SELECT DISTINCT category_kind, category_value FROM sample_targets CROSS JOIN z
            LEFT JOIN c ON c.kind = category_kind AND c.v = {label('category_value')}
            WHERE coalesce(n, 0) < greatest(min_rows, size * target_pm // 1000)""",
        "p7_found": """
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents WHERE text IS NOT NULL),
            i AS (SELECT item_id, regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+') AS w FROM (SELECT item_id, unnest([prompt, rubric]) AS t FROM suite_tests) WHERE t IS NOT NULL),
            dg AS (SELECT doc_id, hash(w[k:k + 11]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
            ig AS (SELECT DISTINCT item_id, hash(w[k:k + 11]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
            SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    }
