"""Duplicates, nearest texts, contamination, clusters and holdouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import content_id, folded
from weftline.operators import identity as I
from weftline.operators import similarity as S
from weftline.operators.scale import sized_join
from weftline.plans.tables import on
from weftline.plans.text_queries import _WORDS, _norm
from weftline.session import cut


@on("source_examples")
def first_seen(s: DataFrame) -> DataFrame:
    kept = I.keep_first(s.select("rec_id", "source_file", "source_index", content_id(F.col("prompt")).alias("pid")), ["pid"], [F.col("source_file").asc_nulls_first(), "source_index", "rec_id"])
    return kept.select("pid", "rec_id")


@on("exec_results")
def last_write(e: DataFrame) -> DataFrame:
    return I.keep_first(e.select("exec_id", "exec_level", "received_at"), ["exec_id"], [F.col("received_at").desc()])


@on("forged")
def pair_digests(f: DataFrame) -> DataFrame:
    d = f.select("pair_id", F.sha2(F.concat(F.coalesce("chosen", F.lit("")), F.lit("|#|"), F.coalesce("rejected", F.lit(""))), 256).alias("digest"))
    return I.keep_first(d, ["digest"], ["pair_id"])


@on("forged")
def equal_sides(f: DataFrame) -> DataFrame:
    """Pairs whose sides are the same but for space and case, and their lengths' ratio otherwise."""
    c, r = folded(F.col("chosen")), folded(F.col("rejected"))
    return f.select("pair_id", (c == r).alias("same"), F.round(F.length(r) / F.nullif(F.length(c), F.lit(0)), 4).alias("ratio"))


@on("forged")
def code_cache(f: DataFrame) -> DataFrame:
    """Each distinct (prompt, code) is scored once and joined back."""
    rows = f.select("pair_id", content_id(F.col("prompt")).alias("pid"), F.sha2(F.coalesce("chosen", F.lit("")), 256).alias("code"))
    once = rows.select("pid", "code").distinct().withColumn("score", F.pmod(F.conv(F.left("code", F.lit(4)), 16, 10).cast("bigint"), F.lit(100)))
    return rows.join(once, ["pid", "code"]).select("pair_id", "score")


@on("forged")
def lost_variants(f: DataFrame) -> DataFrame:
    """Prompts with more distinct chosen answers than distinct rejected ones."""
    n = f.groupBy(content_id(F.col("prompt")).alias("pid")).agg(F.countDistinct("chosen").alias("chosen"), F.countDistinct("rejected").alias("rejected"))
    return n.where("chosen > rejected")


@on("documents", "suite_tests")
def nearest_test(d: DataFrame, t: DataFrame) -> DataFrame:
    best = S.nearest(d, t, "doc_id", "item_id", "text", "prompt")
    return best.select("doc_id", "item_id", "shared", F.round("jaccard", 6).alias("jaccard"), F.round("contained", 6).alias("contained"))


@on("source_examples", "suite_tests")
def clean_pool(s: DataFrame, t: DataFrame) -> DataFrame:
    """First-seen prompts that resemble no held-out test (Jaccard below 0.3)."""
    kept = I.keep_first(s.select("rec_id", "prompt", content_id(F.col("prompt")).alias("pid")), ["pid"], ["rec_id"])
    near = S.nearest(kept, t, "rec_id", "item_id", "prompt", "prompt", 0.3)
    return kept.join(near.select("rec_id"), "rec_id", "left_anti").select("rec_id", "pid")


@on("documents")
def near_duplicates(d: DataFrame) -> DataFrame:
    return S.near_duplicate_classes(d)


@on("documents")
def safe_holdout(d: DataFrame) -> DataFrame:
    return S.holdout(S.near_duplicate_classes(d), d)


@on("documents")
def holdout_gate(d: DataFrame) -> DataFrame:
    """How close the holdout comes to the pool: no text of it may be a near-duplicate of one left in."""
    held = cut(S.holdout(S.near_duplicate_classes(d), d).where("held").select("doc_id"))
    rows = d.where("doc_id is not null").select("doc_id", "text")
    pool = sized_join(rows, held, ["doc_id"], "left_anti").select(F.col("doc_id").alias("other"), F.col("text").alias("other_text"))
    return S.gate(sized_join(rows, held, ["doc_id"], "left_semi"), pool, "doc_id", "other", "text", "other_text", S.SIMILAR).withColumn("closest", F.round("closest", 6))


@on("suite_tests")
def suite_gate(t: DataFrame) -> DataFrame:
    """Tests of one component against all others, names masked: none may reach 0.3."""
    other = t.where("test_component <> 'REFORMAT'").select(F.col("item_id").alias("other"), F.col("prompt").alias("other_text"))
    return S.gate(t.where("test_component = 'REFORMAT'"), other, "item_id", "other", "prompt", "other_text", 0.3, masked=True).withColumn("closest", F.round("closest", 6))


@on("forged")
def edit_ratio(f: DataFrame) -> DataFrame:
    """Pairs of similar length whose sides differ by few edits."""
    c, r = F.coalesce("chosen", F.lit("")), F.coalesce("rejected", F.lit(""))
    rows = f.select("pair_id", F.round(S.edit_similarity(c, r), 6).alias("similarity"), F.length(r).alias("lr"), F.length(c).alias("lc"))
    return rows.where("lr between 0.7 * lc and 1.4 * lc").select("pair_id", "similarity")


@on("setup_bundles", "exec_results")
def multiset_rows(b: DataFrame, e: DataFrame) -> DataFrame:
    """Example ids of both tables as multisets."""
    return I.multiset_difference(b.select("example_id"), e.select("example_id"))


@on("exec_results")
def tuple_digests(e: DataFrame) -> DataFrame:
    return e.select("exec_id", I.digest(F.col("exec_level"), F.col("run_id"), F.col("run_status")).alias("digest")).distinct()


QUERIES = {f.__name__: f for f in (first_seen, last_write, pair_digests, equal_sides, code_cache, lost_variants, nearest_test, clean_pool, near_duplicates, safe_holdout, holdout_gate, suite_gate, edit_ratio, multiset_rows, tuple_digests)}

_PID = f"substr(sha256({_norm('prompt')}), 1, 16)"


def _grams(table: str, key: str, text: str) -> str:
    return rf"""(SELECT {key}, w, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END) AS s
                FROM (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}_]+') AS w FROM {table}))"""


def _nearest(left: str, key: str) -> str:
    return f"""
    a AS (SELECT *, len(s) AS n1 FROM {left}), b AS (SELECT *, len(s) AS n2 FROM {_grams('suite_tests', 'item_id', 'prompt')}),
    m AS (SELECT {key}, item_id, n1, n2, count(*) AS shared FROM (SELECT {key}, n1, unnest(s) AS g FROM a) JOIN (SELECT item_id, n2, unnest(s) AS g FROM b) USING (g) GROUP BY ALL),
    j AS (SELECT *, shared / (n1 + n2 - shared) AS jaccard, row_number() OVER (PARTITION BY {key} ORDER BY shared / (n1 + n2 - shared) DESC, item_id) AS rn FROM m)"""


_CLASSES = rf"""
    g AS {_grams('documents', 'doc_id', 'text')},
    k AS (SELECT doc_id, s, len(s) AS n, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE '' END || '|' || array_to_string(list_sort(s), ',') AS same FROM g),
    x AS (SELECT doc_id, n, unnest(s) AS h FROM k),
    p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n) GROUP BY u, v, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
    e AS (SELECT u, v FROM p UNION SELECT a.doc_id, b.doc_id FROM k a JOIN k b ON a.same = b.same AND a.doc_id <> b.doc_id),
    r(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
    c AS (SELECT r.u AS doc_id, min(r.v) AS class_id FROM r GROUP BY r.u)"""

_HOLDOUT = f"""WITH RECURSIVE {_CLASSES},
    z AS MATERIALIZED (SELECT class_id, count(*) AS n, arg_min(coalesce(component, ''), doc_id) AS component FROM c JOIN documents USING (doc_id) GROUP BY class_id),
    t AS (SELECT sum(n) AS total, CAST(floor(sum(n) * 100 / 1000 + 0.5) AS BIGINT) AS wanted FROM z),
    q0 AS (SELECT component, sum(n) * any_value(wanted) / any_value(total) AS exact FROM z CROSS JOIN t GROUP BY component),
    q AS (SELECT component, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, component) <= (SELECT wanted FROM t) - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM q0),
    o AS MATERIALIZED (SELECT z.*, quota, row_number() OVER (PARTITION BY component ORDER BY sha256('holdout|' || class_id), class_id) AS rn FROM z JOIN q USING (component)),
    gr AS (SELECT component, class_id, n, rn, n <= quota AS held, CASE WHEN n <= quota THEN n ELSE 0 END AS got FROM o WHERE rn = 1
           UNION ALL SELECT o.component, o.class_id, o.n, o.rn, gr.got + o.n <= quota, gr.got + CASE WHEN gr.got + o.n <= quota THEN o.n ELSE 0 END FROM gr JOIN o ON o.component = gr.component AND o.rn = gr.rn + 1),
    f AS (SELECT class_id, sum(n) OVER (ORDER BY n, class_id ROWS UNBOUNDED PRECEDING) <= (SELECT wanted FROM t) - (SELECT coalesce(sum(n), 0) FROM gr WHERE held) AS held FROM gr WHERE NOT held),
    h AS MATERIALIZED (SELECT doc_id, gr.component, gr.held OR coalesce(f.held, false) AS held FROM c JOIN gr USING (class_id) LEFT JOIN f USING (class_id))"""

# edit_ratio has none: the oracle's edit distance counts bytes, not characters. It is tested against brute force.
ORACLES = {
    "first_seen": f"SELECT pid, rec_id FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY source_file NULLS FIRST, source_index, rec_id) AS rn FROM (SELECT *, {_PID} AS pid FROM source_examples)) WHERE rn = 1",
    "last_write": "SELECT exec_id, exec_level, received_at FROM (SELECT *, row_number() OVER (PARTITION BY exec_id ORDER BY received_at DESC) AS rn FROM exec_results) WHERE rn = 1",
    "pair_digests": "SELECT min(pair_id) AS pair_id, digest FROM (SELECT pair_id, sha256(coalesce(chosen, '') || '|#|' || coalesce(rejected, '')) AS digest FROM forged) GROUP BY digest",
    "equal_sides": f"SELECT pair_id, lower({_norm('chosen')}) = lower({_norm('rejected')}) AS same, round(length({_norm('rejected')}) / nullif(length({_norm('chosen')}), 0), 4) AS ratio FROM forged",
    "code_cache": "SELECT pair_id, CAST('0x' || left(sha256(coalesce(chosen, '')), 4) AS BIGINT) % 100 AS score FROM forged",
    "lost_variants": f"SELECT {_PID} AS pid, count(DISTINCT chosen) AS chosen, count(DISTINCT rejected) AS rejected FROM forged GROUP BY pid HAVING count(DISTINCT chosen) > count(DISTINCT rejected)",
    "nearest_test": "WITH " + _nearest(_grams("documents", "doc_id", "text"), "doc_id") + " SELECT doc_id, item_id, shared, round(jaccard, 6) AS jaccard, round(shared / n2, 6) AS contained FROM j WHERE rn = 1",
    "clean_pool": f"WITH f AS (SELECT pid, min(rec_id) AS rec_id, arg_min(prompt, rec_id) AS prompt FROM (SELECT *, {_PID} AS pid FROM source_examples) GROUP BY pid), "
    + _nearest(_grams("f", "rec_id", "prompt"), "rec_id")
    + " SELECT rec_id, pid FROM f WHERE rec_id NOT IN (SELECT rec_id FROM j WHERE jaccard >= 0.3)",
    "near_duplicates": f"WITH RECURSIVE {_CLASSES} SELECT doc_id, class_id, (SELECT count(*) FROM e WHERE e.u = c.doc_id) AS links FROM c",
    "safe_holdout": _HOLDOUT + " SELECT doc_id, component, held FROM h",
    "holdout_gate": _HOLDOUT + f""", a AS (SELECT doc_id, s, len(s) AS n FROM g), tr AS (SELECT a.* FROM a JOIN h USING (doc_id) WHERE held), po AS (SELECT a.* FROM a JOIN h USING (doc_id) WHERE NOT held),
        mm AS (SELECT x.doc_id, y.doc_id AS other, x.n AS n1, y.n AS n2, count(*) AS shared FROM (SELECT doc_id, n, unnest(s) AS k FROM tr) x JOIN (SELECT doc_id, n, unnest(s) AS k FROM po) y USING (k) GROUP BY ALL),
        jj AS (SELECT doc_id, max(shared / (n1 + n2 - shared)) AS j FROM mm GROUP BY doc_id)
        SELECT (SELECT count(*) FROM h WHERE held) AS checked, count(*) AS with_neighbour, round(coalesce(max(j), 0), 6) AS closest, count(*) FILTER (j >= 0.8) AS over, count(*) FILTER (j >= 0.8) = 0 AS passed FROM jj""",
    "suite_gate": f"""WITH a AS (SELECT item_id, test_component, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [] END) AS s
                    FROM (SELECT item_id, test_component, list_transform({_WORDS.format('prompt')}, lambda w: CASE WHEN contains(w, '_') THEN 'F' ELSE w END) AS w FROM suite_tests)),
        e AS (SELECT item_id, test_component, len(s) AS n, unnest(s) AS k FROM a),
        m AS (SELECT x.item_id, y.item_id AS other, x.n AS n1, y.n AS n2, count(*) AS shared FROM e x JOIN e y ON x.k = y.k AND x.test_component = 'REFORMAT' AND y.test_component <> 'REFORMAT' GROUP BY ALL),
        j AS (SELECT item_id, max(shared / (n1 + n2 - shared)) AS j FROM m GROUP BY 1)
        SELECT (SELECT count(*) FROM a WHERE test_component = 'REFORMAT') AS checked, count(*) AS with_neighbour, round(coalesce(max(j), 0), 6) AS closest, count(*) FILTER (j >= 0.3) AS over, count(*) FILTER (j >= 0.3) = 0 AS passed FROM j""",
    "multiset_rows": """SELECT example_id, CASE WHEN n > 0 THEN 'left' ELSE 'right' END AS side, CAST(abs(n) AS BIGINT) AS surplus
        FROM (SELECT example_id, sum(n) AS n FROM (SELECT example_id, 1 AS n FROM setup_bundles UNION ALL SELECT example_id, -1 FROM exec_results) GROUP BY example_id) WHERE n <> 0""",
    "tuple_digests": """WITH m AS (SELECT exec_id, 'V' || exec_level AS a, CASE WHEN run_id IS NULL THEN 'N' ELSE 'V' || run_id END AS b, 'V' || run_status AS c FROM exec_results)
        SELECT DISTINCT exec_id, sha256(length(a) || ':' || a || length(b) || ':' || b || length(c) || ':' || c) AS digest FROM m""",
}
