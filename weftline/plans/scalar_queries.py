"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import strict as C
from weftline.functions.values import canonical_value
from weftline.plans.tables import on


@on("part")
def string_functions(p: DataFrame) -> DataFrame:
    n = F.col("p_name")
    return p.select(
        "p_partkey", C.sub_text(n, 2, 5).alias("part"), C.index_of(n, "a").cast("bigint").alias("first_a"), C.last_index_of(n, "a").cast("bigint").alias("last_a"), C.count_char(n, "e").cast("bigint").alias("e"),
        F.lpad(F.left(n, F.lit(4)), 6, "*").alias("padded"), F.reverse(n).alias("reversed"), C.plus_text(F.col("p_brand"), F.lit(None), F.col("p_size")).alias("joined"), F.upper(F.right(n, F.lit(3))).alias("tail"),
    )


@on("lineitem")
def math_functions(i: DataFrame) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return i.groupBy("l_linenumber").agg(F.sum(C.divide(q, F.lit(7), True)).alias("whole"), F.sum(F.pmod(q, F.lit(7)).cast("bigint")).alias("rest"), F.sum(q.bitwiseAND(5).cast("bigint")).alias("bits"), F.sum(F.signum(q - 25).cast("bigint")).alias("signs"), F.round(F.sum(F.sqrt(q.cast("double")).cast("decimal(20,8)")).cast("double"), 4).alias("roots"), F.sum(F.greatest(q, F.lit(30)).cast("bigint")).alias("most"))


@on("orders")
def date_functions(o: DataFrame) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp")
    return o.select("o_orderkey", F.date_format(C.date_add(d, 40, "DAY"), "yyyy-MM-dd").alias("later"), C.date_diff(d, F.lit("1992-01-15").cast("timestamp"), "MONTH").alias("months"), C.day_of_week(d).cast("bigint").alias("weekday"), F.date_format(F.date_trunc("MONTH", d), "yyyy-MM-dd").alias("month_start"), F.year(d).cast("bigint").alias("year"))


@on("forged_provenance")
def list_functions(p: DataFrame) -> DataFrame:
    m = F.coalesce("rejected_failure_modes", F.array().cast("array<string>"))
    return p.select("pair_id", "logged_at", F.array_join(F.array_sort(F.array_distinct(m)), ",").alias("labels"), F.array_join(C.poll(m), ",").alias("rest"), F.array_join(C.pop(m), ",").alias("front"), C.contains_all(m, F.array(F.lit("null_handling"))).alias("has"), F.size(m).cast("bigint").alias("n"))


@on("setup_bundles")
def map_functions(b: DataFrame) -> DataFrame:
    more = F.create_map(F.lit("DEBUG"), F.lit("x"), F.lit("NEW"), F.lit("y"))
    kept, taken = C.append_all(F.col("run_params"), more), C.copy_map(F.col("run_params"), more)
    return b.where("run_params is not null").select("example_id", F.coalesce(F.try_element_at(kept, F.lit("DEBUG")), F.lit("-")).alias("left_wins"), F.try_element_at(taken, F.lit("DEBUG")).alias("right_wins"), F.size(taken).cast("bigint").alias("n"))


@on("source_examples")
def file_parts(s: DataFrame) -> DataFrame:
    f = F.col("source_file")
    return s.select("rec_id", *[C.file_part(f, w).alias(w) for w in ("name", "extension", "path", "stem")])


@on("events")
def conversions(e: DataFrame) -> DataFrame:
    t = F.format_string("%.2f", F.col("value"))
    return e.select("event_id", C.is_number(t).alias("is_number"), C.is_integer(F.col("user_id").cast("string")).alias("is_integer"), F.conv(F.col("user_id").cast("string"), 10, 16).alias("hex"), F.md5(F.col("event_type")).alias("md5"), F.base64(F.encode("event_type", "UTF-8")).alias("b64"))


@on("supplier")
def null_functions(s: DataFrame) -> DataFrame:
    odd = F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name"))
    return s.select("s_suppkey", F.nvl(odd, F.lit("none")).alias("nvl"), F.nvl2(odd, F.lit("some"), F.lit("none")).alias("nvl2"), C.equal(odd, F.lit(None)).alias("is_null"), C.is_blank(odd).alias("blank"), C.first_valid((F.col("s_suppkey") % 2 == 0, F.lit("even")), (F.lit(True), F.lit("odd"))).alias("first"))


@on("customer")
def overflow(c: DataFrame) -> DataFrame:
    """Silent 32-bit overflow, the 31-polynomial hash, and values equal across spellings."""
    k = F.col("c_custkey").cast("bigint")
    return c.select("c_custkey", C.wrap_int(k * 3_000_019).alias("wrapped"), canonical_value(F.concat(F.lit(" "), k.cast("string"), F.lit("0.50E-1"))).alias("value"))


@on("part")
def address_functions(p: DataFrame) -> DataFrame:
    """Parts of addresses, escapes and code points of made-up texts."""
    url = F.concat(F.lit("https://u:p@host"), "p_size", F.lit(".org:80"), F.pmod("p_size", F.lit(10)), F.lit("/a/"), F.url_encode("p_name"), F.lit("?q="), "p_partkey", F.lit("#top"))
    xml = F.concat(F.lit("<"), "p_name", F.lit("&'\""))
    parts = [C.url_part(url, w).alias(w) for w in ("host", "port", "protocol", "query", "ref", "userinfo")]
    return p.select("p_partkey", *parts, C.is_url(url).alias("is_url"), C.is_url(F.col("p_name")).alias("name_is_url"), C.escape_xml(xml).alias("escaped"), (C.unescape_xml(C.escape_xml(xml)) == xml).alias("back"), C.code_point_at(F.col("p_name"), 1).alias("point"), C.from_code_points(F.array(F.lit(233), F.lit(128512), F.col("p_size") + 64)).alias("text"))


@on("customer")
def bit_functions(c: DataFrame) -> DataFrame:
    """Bits, packed decimals, messages and decimals in normal form."""
    k = F.col("c_custkey").cast("bigint")
    signed = F.when(k % 2 == 0, -k).otherwise(k)
    text = F.concat(F.lit("+00"), k.cast("string"), F.lit(".500"))
    return c.select("c_custkey", C.bit_set(k, 4).alias("bit_on"), C.bit_set(k, 0, False).alias("bit_off"), F.hex(C.pack_decimal(signed)).alias("packed"), C.unpack_decimal(C.pack_decimal(signed)).alias("unpacked"), C.format_message("{0} of {1}: {0}", k, F.lit(None)).alias("message"), C.normalize_decimal(text).alias("decimal"), (F.abs(C.add_noise(k, 2.0, k) - k) <= 2).alias("near"), C.compare_fields(k % 3, F.nullif(k % 2, F.lit(0))).alias("compared"))


@on("forged_provenance")
def container_functions(p: DataFrame) -> DataFrame:
    m = F.array_sort(F.coalesce("rejected_failure_modes", F.array().cast("array<string>")))
    doc = F.to_json(F.struct("pair_id", F.col("provenance.verdict").alias("v")))
    return p.select("pair_id", "logged_at", F.array_join(C.insert_at(m, 0, F.lit("first")), ",").alias("inserted"), C.binary_search(m, F.lit("null_handling")).alias("found"), F.array_join(C.find_all_values(doc, "verdict"), ",").alias("verdicts"))


QUERIES = {f.__name__: f for f in (address_functions, bit_functions, container_functions, string_functions, math_functions, date_functions, list_functions, map_functions, file_parts, conversions, null_functions, overflow)}

_M = "coalesce(rejected_failure_modes, [])"
ORACLES = {
    "address_functions": """
        SELECT p_partkey, 'host' || p_size || '.org' AS host, CAST('80' || p_size % 10 AS INT) AS port, 'https' AS protocol, 'q=' || p_partkey AS query, 'top' AS ref, 'u:p' AS userinfo, true AS is_url, false AS name_is_url,
               '&lt;' || p_name || '&amp;&apos;&quot;' AS escaped, true AS back, CAST(ord(p_name[2]) AS BIGINT) AS point, 'é😀' || chr(CAST(p_size + 64 AS INT)) AS text FROM part""",
    "bit_functions": """
        WITH k AS (SELECT c_custkey, CAST(c_custkey AS BIGINT) AS k FROM customer)
        SELECT c_custkey, k | 16 AS bit_on, k - k % 2 AS bit_off, CASE WHEN length(CAST(k AS VARCHAR)) % 2 = 0 THEN '0' ELSE '' END || k || CASE WHEN k % 2 = 0 AND k > 0 THEN 'D' ELSE 'C' END AS packed, CASE WHEN k % 2 = 0 THEN -k ELSE k END AS unpacked,
               k || ' of null: ' || k AS message, k || '.5' AS decimal, true AS near, CAST(CASE WHEN nullif(k % 2, 0) IS NULL THEN 1 ELSE sign(k % 3 - 1) END AS INT) AS compared FROM k""",
    "container_functions": """
        WITH m AS (SELECT *, list_sort(coalesce(rejected_failure_modes, [])) AS m FROM forged_provenance)
        SELECT pair_id, logged_at, array_to_string(list_prepend('first', m), ',') AS inserted, CASE WHEN list_contains(m, 'null_handling') THEN list_position(m, 'null_handling') - 1 ELSE -len(list_filter(m, lambda x: x < 'null_handling')) - 1 END AS found,
               coalesce(provenance.verdict.verdict, '') AS verdicts FROM m""",
    "string_functions": "SELECT p_partkey, substr(p_name, 3, 5) AS part, strpos(p_name, 'a') - 1 AS first_a, CASE WHEN strpos(reverse(p_name), 'a') = 0 THEN -1 ELSE length(p_name) - strpos(reverse(p_name), 'a') END AS last_a, length(p_name) - length(replace(p_name, 'e', '')) AS e, lpad(left(p_name, 4), 6, '*') AS padded, reverse(p_name) AS reversed, p_brand || 'null' || p_size AS joined, upper(right(p_name, 3)) AS tail FROM part",
    "math_functions": "WITH x AS (SELECT l_linenumber, CAST(trunc(l_quantity) AS INT) AS q FROM lineitem) SELECT l_linenumber, CAST(sum(q // 7) AS BIGINT) AS whole, CAST(sum(q % 7) AS BIGINT) AS rest, CAST(sum(q & 5) AS BIGINT) AS bits, CAST(sum(sign(q - 25)) AS BIGINT) AS signs, round(CAST(sum(CAST(sqrt(q) AS DECIMAL(20,8))) AS DOUBLE), 4) AS roots, CAST(sum(greatest(q, 30)) AS BIGINT) AS most FROM x GROUP BY 1",
    "date_functions": "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 40 DAY, '%Y-%m-%d') AS later, datesub('month', TIMESTAMP '1992-01-15', o_orderdate) AS months, isodow(o_orderdate) AS weekday, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month_start, year(o_orderdate) AS year FROM orders",
    "list_functions": f"SELECT pair_id, logged_at, array_to_string(list_sort(list_distinct({_M})), ',') AS labels, array_to_string({_M}[2:], ',') AS rest, array_to_string({_M}[:greatest(len({_M}) - 1, 0)], ',') AS front, list_contains({_M}, 'null_handling') AS has, len({_M}) AS n FROM forged_provenance",
    "map_functions": "SELECT example_id, coalesce(CASE WHEN list_contains(map_keys(run_params), 'DEBUG') THEN run_params['DEBUG'] ELSE 'x' END, '-') AS left_wins, 'x' AS right_wins, len(list_distinct(list_concat(map_keys(run_params), ['DEBUG', 'NEW']))) AS n FROM setup_bundles WHERE run_params IS NOT NULL",
    "file_parts": r"WITH n AS (SELECT rec_id, source_file, regexp_extract(source_file, '([^/\\]*)$', 1) AS name FROM source_examples) SELECT rec_id, name, regexp_extract(name, '\.([^.]*)$', 1) AS extension, regexp_extract(source_file, '^(.*[/\\])', 1) AS path, regexp_replace(name, '\.[^.]*$', '') AS stem FROM n",
    "conversions": "SELECT event_id, true AS is_number, true AS is_integer, to_hex(user_id) AS hex, md5(event_type) AS md5, to_base64(encode(event_type)) AS b64 FROM events",
    "null_functions": "WITH x AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS o FROM supplier) SELECT s_suppkey, coalesce(o, 'none') AS nvl, CASE WHEN o IS NOT NULL THEN 'some' ELSE 'none' END AS nvl2, o IS NULL AS is_null, o IS NULL OR trim(o) = '' AS blank, CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS first FROM x",
    "overflow": "SELECT c_custkey, CAST((c_custkey::BIGINT * 3000019 + 2147483648) % 4294967296 - 2147483648 AS INT) AS wrapped, '#' || CASE WHEN c_custkey = 0 THEN '5' ELSE CAST(c_custkey AS VARCHAR) || '05' END || 'E-2' AS value FROM customer",
}
