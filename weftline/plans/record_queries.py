"""Record operators over orders, line items, customers and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import strict as C
from weftline.operators import records as R
from weftline.operators.identity import keep_first
from weftline.plans.tables import on


def _money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)")


@on("orders")
def route_ports(o: DataFrame) -> DataFrame:
    """Ordered routing with an error port that comes before the amount is looked at."""
    rules = [(F.col("o_orderstatus") == "P", 4), (F.col("o_totalprice").isNull() | (F.col("o_totalprice") < 0), 5), (F.col("o_orderpriority") == "1-URGENT", 0), (F.col("o_totalprice") > 300000, 1), (F.year("o_orderdate") < 1994, 2)]
    return R.route(o, rules, 3).groupBy("port").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))


@on("orders")
def reject_reasons(o: DataFrame) -> DataFrame:
    rules = [("LOW", F.col("o_totalprice") < 50000), ("OLD", F.year("o_orderdate") < 1995), ("SLOW", F.col("o_orderpriority").startswith("5"))]
    return o.select("o_orderkey", R.all_reasons(rules).alias("reasons"), R.first_reason(rules).alias("first_reason"))


@on("part")
def expand_words(p: DataFrame) -> DataFrame:
    """Distinct words of a name in order, with ordinal and total; a name without any keeps a placeholder."""
    words = F.array_distinct(F.filter(F.split(F.lower("p_name"), " "), lambda w: F.length(w) > 0))
    return R.expand(p, words, ["p_partkey"], "word", True)


@on("lineitem")
def winner_per_key(i: DataFrame) -> DataFrame:
    """Complete rows before incomplete, then the later, then the larger; the first on ties, with the count of all."""
    w = Window.partitionBy("l_orderkey")
    best = [(F.col("l_returnflag") != "N").desc(), F.col("l_shipdate").desc_nulls_last(), F.col("l_quantity").desc(), F.col("l_linenumber")]
    return keep_first(i.withColumn("n", F.count(F.lit(1)).over(w)), ["l_orderkey"], best).select("l_orderkey", "l_linenumber", "n")


@on("lineitem")
def rollup_summary(i: DataFrame) -> DataFrame:
    late = F.col("l_shipdate") > F.lit("1996-06-30").cast("timestamp")
    return i.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("rows"), F.sum(_money("l_quantity")).cast("double").alias("units"), F.count_if(late).alias("late"), F.max_by("l_partkey", F.struct("l_extendedprice", "l_linenumber")).alias("top_part"))


@on("lineitem")
def running_detail(i: DataFrame) -> DataFrame:
    """Each line's running total and disposition, and the winner known so far."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    eligible = F.col("l_quantity") >= 20
    d = i.withColumn("so_far", F.sum(_money("l_quantity")).over(w).cast("double")).withColumn("k", F.count_if(eligible).over(w))
    state = F.when(~eligible, "INELIGIBLE").when(F.col("k") == 1, "WINNER").otherwise("ELIGIBLE")
    return d.select("l_orderkey", "l_linenumber", "so_far", state.alias("disposition"), F.first(F.when(eligible, F.col("l_linenumber")), True).over(w).alias("winner"))


@on("events")
def retractions(e: DataFrame) -> DataFrame:
    """What each user's types have left after a purchase removes the earlier ones of its type's length."""
    rows = e.withColumn("slot", F.length("event_type"))
    left = R.survivors(rows, ["user_id"], "slot", "event_id", F.col("event_type") == "purchase")
    return left.groupBy("user_id").agg(F.count(F.lit(1)).alias("left"), F.max("event_id").alias("last"))


@on("orders")
def month_report(o: DataFrame) -> DataFrame:
    """Monthly sums, share of open orders and reopened customers' orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = o.withColumn("reopened", (F.col("o_orderstatus") == "O") & (F.lag("o_orderstatus").over(w) == "F"))
    return d.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", _money("o_totalprice"))).cast("double").alias("done"), F.round(F.count_if(F.col("o_orderstatus") == "O") / F.count(F.lit(1)), 6).alias("open_share"), F.count_if("reopened").alias("reopened"))


@on("orders")
def fiscal_quarters(o: DataFrame) -> DataFrame:
    """Weighted exposure by fiscal quarter from April on; quarters without an eligible order are left out."""
    start = F.add_months(F.to_date("o_orderdate"), -3)
    weight = F.when(F.col("o_orderpriority").startswith("1"), 2).otherwise(1)
    ok = F.col("o_totalprice") >= 100000
    g = o.groupBy(F.year(start).alias("fy"), F.quarter(start).alias("fq")).agg(F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("excluded"), F.sum(F.when(ok, _money("o_totalprice") * weight)).alias("s"), F.sum(F.when(ok, weight)).alias("w"))
    return g.where("eligible > 0").select("fy", "fq", "eligible", "excluded", F.round((F.col("s") / F.col("w")).cast("double"), 2).alias("average"))


@on("events")
def islands_of_types(e: DataFrame) -> DataFrame:
    d = R.islands(e, ["user_id"], ["ts", "event_id"], "event_type")
    return d.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least_id"))


@on("events")
def reset_balances(e: DataFrame) -> DataFrame:
    kind = F.when(F.col("event_type") == "login", "OPEN").when(F.col("event_type") == "logout", "CLOSE").when(F.col("event_type") == "click", "MOVE").otherwise("NONE")
    v = F.col("value").cast("decimal(18,4)")
    return R.balance_with_resets(e, ["user_id"], ["ts", "event_id"], kind, v, v).select("event_id", F.col("balance").cast("double").alias("balance"))


@on("orders")
def snapshot_changes(o: DataFrame) -> DataFrame:
    """Two derived snapshots compared: which orders are in one only, changed or the same."""
    a = o.where("o_orderkey % 7 <> 0").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    b = o.where("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "X").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return R.changes(a, b, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@on("orders", "lineitem")
def outer_gaps(o: DataFrame, i: DataFrame) -> DataFrame:
    """Expected against settled amounts; equal ones are dropped, one-sided ones named."""
    settled = i.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.when(F.col("l_returnflag") != "R", _money("l_extendedprice")).otherwise(0)).alias("settled"))
    planned = o.select(F.col("o_orderkey").alias("k2"), _money("o_totalprice").alias("planned"))
    d = planned.join(settled, F.col("k") == F.col("k2"), "full").withColumn("delta", F.coalesce("settled", F.lit(0)) - F.coalesce("planned", F.lit(0)))
    state = F.when(F.col("k2").isNull(), "UNPLANNED").when(F.col("k").isNull(), "WAITING").when(F.col("delta") < 0, "SHORT").otherwise("EXCESS")
    return d.where("delta <> 0").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"), F.sum("delta").cast("double").alias("delta"))


@on("orders", "customer")
def tariff_cascade(o: DataFrame, c: DataFrame) -> DataFrame:
    """Tariff by segment and priority, else by segment, else for all, valid on the order's day."""
    ts = lambda x: F.lit(x).cast("timestamp")
    seg = c.select("c_mktsegment").distinct()
    rules = (
        seg.select(F.col("c_mktsegment").alias("segment"), F.lit("1-URGENT").alias("priority"), ts("1993-01-01").alias("valid_from"), ts("1995-12-31").alias("valid_to"), F.lit(10).alias("fee"))
        .unionByName(seg.select(F.col("c_mktsegment").alias("segment"), F.lit("*").alias("priority"), ts("1994-06-01").alias("valid_from"), ts(None).alias("valid_to"), F.lit(20).alias("fee")))
        .unionByName(seg.limit(1).select(F.lit("*").alias("segment"), F.lit("*").alias("priority"), ts("1990-01-01").alias("valid_from"), ts("1996-12-31").alias("valid_to"), F.lit(30).alias("fee")))
    )
    rows = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey").select("o_orderkey", "o_orderdate", "o_orderpriority", "c_mktsegment")
    out = R.cascade_lookup(rows, rules, [[("c_mktsegment", "segment"), ("o_orderpriority", "priority")], [("c_mktsegment", "segment")], []], "o_orderdate", "fee")
    return out.select("o_orderkey", "level", "fee")


@on("customer", "nation", "region")
def lookup_chain(c: DataFrame, n: DataFrame, r: DataFrame) -> DataFrame:
    """First nation of a key in either case, then its region."""
    out = R.hash_join(c.select("c_custkey", "c_nationkey"), n.select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey"), [("c_nationkey", "k")], ["n_name"])
    out = R.hash_join(out, r.select("r_regionkey", F.upper("r_name").alias("region")), [("n_regionkey", "r_regionkey")], ["region"])
    return out.select("c_custkey", "n_name", "region")


@on("events")
def type_versions(e: DataFrame) -> DataFrame:
    v = R.versions(e, ["user_id"], ["ts", "event_id"], ["event_type"], "event_id")
    return v.select("user_id", "event_type", "valid_from", "valid_to", "version")


@on("orders")
def close_and_open(o: DataFrame) -> DataFrame:
    """A changed record closes its version and opens a new one, an unchanged one gives nothing; opens are numbered."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = o.withColumn("was", F.lag("o_orderstatus").over(w)).where(~F.col("was").eqNullSafe(F.col("o_orderstatus")))
    ops = F.array_compact(F.array(F.when(F.col("was").isNotNull(), F.struct(F.lit("CLOSE").alias("op"), F.col("was").alias("status"))), F.struct(F.lit("OPEN").alias("op"), F.col("o_orderstatus").alias("status"))))
    return d.select("o_orderkey", F.explode(ops).alias("x")).select("o_orderkey", "x.op", "x.status")


@on("events")
def clipped_levels(e: DataFrame) -> DataFrame:
    rows = e.select("user_id", "event_id", F.when(F.col("event_type") != "purchase", F.round("value")).alias("inflow"), F.when(F.col("event_type") == "purchase", F.round("value")).alias("outflow"))
    return R.clipped_level(rows, "user_id", ["event_id"], "inflow", "outflow", 100.0)


@on("nation")
def generated_discounts(n: DataFrame) -> DataFrame:
    """A generator of alternating values, 1000 records."""
    g = n.sparkSession.range(1000).withColumn("discount", F.when(F.col("id") % 2 == 0, F.col("id") % 10).otherwise(-(F.col("id") % 7)))
    return g.select("id", "discount")


@on("orders")
def numbered_output(o: DataFrame) -> DataFrame:
    """A sequence from 100 in steps of 10 that only emitted rows advance, within each customer."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.where("o_orderstatus = 'F'").select("o_orderkey", (F.lit(100) + 10 * (F.row_number().over(w) - 1)).alias("seq"))


@on("events")
def json_entries(e: DataFrame) -> DataFrame:
    """Entries of a JSON object in key order with their place; the place counts entries that are then left out."""
    m = F.from_json("props", "map<string,string>")
    rows = R.expand(e.withColumn("m", m), F.array_sort(F.map_keys("m")), ["event_id", "m"], "key")
    return rows.withColumn("value", F.try_element_at("m", F.col("key"))).where("value is not null and value <> ''").select("event_id", "key", "ordinal", "value")


@on("events")
def sessions(e: DataFrame) -> DataFrame:
    """Extension: sessions of a user with gaps of up to half an hour."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w) > 1_800_000_000).cast("int"), F.lit(1))
    d = e.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least_id"))


@on("setup_bundles")
def config_changes(b: DataFrame) -> DataFrame:
    """Run parameters that differ from the previous bundle of the same sandbox."""
    w = Window.partitionBy("sandbox").orderBy("created_at", "example_id")
    d = b.withColumn("old", F.lag("run_params").over(w)).where("old is not null and run_params is not null")
    names = F.array_union(F.map_keys("old"), F.map_keys("run_params"))
    diff = F.filter(names, lambda k: ~F.try_element_at("old", k).eqNullSafe(F.try_element_at("run_params", k)))
    return d.select("example_id", F.array_join(F.array_sort(diff), ",").alias("changed"))


@on("lineitem")
def batches_of_rows(i: DataFrame) -> DataFrame:
    """Groups of three consecutive lines of a supplier."""
    d = R.fixed_groups(i, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 3)
    return d.groupBy("l_suppkey", "grp").agg(F.count(F.lit(1)).alias("n"), F.sum(_money("l_quantity")).cast("double").alias("units"))


@on("customer", "supplier")
def zipped_flows(c: DataFrame, s: DataFrame) -> DataFrame:
    return R.combine(c.select("c_custkey"), s.select("s_suppkey"), ["c_custkey"], ["s_suppkey"])


@on("orders", "lineitem")
def settlement_states(o: DataFrame, i: DataFrame) -> DataFrame:
    """Expected against settled amounts with amounts that do not parse: these go to repair; void settlements count 0, equal sides are dropped."""
    text = F.when(F.col("o_orderpriority") == "5-LOW", "n/a").otherwise(_money("o_totalprice").cast("string"))
    planned = o.select(F.col("o_orderkey").alias("k2"), text.alias("text")).withColumn("planned", F.col("text").try_cast("decimal(18,2)"))
    settled = i.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(F.when(F.col("l_returnflag") != "R", _money("l_extendedprice")).otherwise(0)).alias("settled"))
    d = planned.join(settled, F.col("k") == F.col("k2"), "full").withColumn("delta", F.coalesce("settled", F.lit(0)) - F.coalesce("planned", F.lit(0)))
    state = F.when(F.col("k2").isNotNull() & F.col("planned").isNull(), "REPAIR").when(F.col("k2").isNull(), "UNPLANNED").when(F.col("k").isNull(), "WAITING").when(F.col("delta") < 0, "SHORT").otherwise("EXCESS")
    return d.withColumn("state", state).where("state = 'REPAIR' or delta <> 0").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("state") != "REPAIR", F.col("delta"))).cast("double").alias("delta"))


@on("lineitem")
def receipt_states(i: DataFrame) -> DataFrame:
    """Lines as receipts: a blank id is invalid, a repeated one a duplicate, a void or small one ineligible; the first eligible wins, and the
    winner so far stands on each."""
    receipt = F.when(F.col("l_returnflag") == "A", "").otherwise(F.pmod("l_partkey", F.lit(3)).cast("string"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = i.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_linestatus", "l_quantity", receipt.alias("id"))
    d = d.withColumn("seen", F.row_number().over(Window.partitionBy("l_orderkey", "id").orderBy("l_linenumber", "l_partkey", "l_extendedprice")))
    fits = (F.col("id") != "") & (F.col("seen") == 1) & ~((F.col("l_linestatus") == "F") | F.col("l_quantity").isNull() | (F.col("l_quantity") <= 5))
    d = d.withColumn("fits", fits).withColumn("k", F.count_if("fits").over(upto)).withColumn("winner", F.first(F.when(F.col("fits"), F.col("id")), True).over(upto))
    state = F.when(F.col("id") == "", "INVALID").when(F.col("seen") > 1, "DUPLICATE").when(~F.col("fits"), "INELIGIBLE").when(F.col("k") == 1, "WINNER").otherwise("ELIGIBLE")
    return d.select("l_orderkey", "l_linenumber", state.alias("state"), "winner")


@on("orders")
def tariff_operations(o: DataFrame) -> DataFrame:
    """Each order as a tariff record: a cancellation closes and tells so, a bad rate is an error, an unchanged one only an audit, a change
    closes and opens and tells both."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    d = o.withColumn("was", F.lag("o_orderpriority").over(w))
    op = lambda name: F.struct(F.lit(name).alias("op"))
    bad, cancelled = F.col("o_totalprice") < 20000, F.col("o_orderstatus") == "P"
    same = F.col("was").eqNullSafe(F.col("o_orderpriority"))
    ops = F.when(cancelled, F.array(op("CLOSE"), op("CANCELLED"))).when(bad, F.array(op("ERROR"))).when(same, F.array(op("AUDIT"))).when(F.col("was").isNull(), F.array(op("OPEN"), op("AUDIT"))).otherwise(F.array(op("CLOSE"), op("OPEN"), op("AUDIT")))
    return d.select("o_orderkey", F.posexplode(ops).alias("place", "x")).select("o_orderkey", "place", "x.op")


@on("orders")
def handled_errors(o: DataFrame) -> DataFrame:
    """A parse that may fail, its fallback and the message, and the rows by the port that follows from it."""
    text = F.when(F.col("o_orderstatus") == "P", "x").otherwise(F.col("o_custkey").cast("string"))
    handled = C.on_error(text.try_cast("int"), text.try_cast("int").isNull(), F.concat(F.lit("no number: "), text), F.lit(-1))
    good, bad = R.split_filter(o.select("o_orderkey", handled.alias("h")).select("o_orderkey", "h.value", "h.error"), F.col("error").isNull())
    told = lambda d, port: d.groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).withColumn("port", F.lit(port))
    return told(good, 0).unionByName(told(bad, 1))


@on("orders")
def graph_parameters(o: DataFrame) -> DataFrame:
    """Parameters of a run as named arguments of SQL text."""
    o.createOrReplaceTempView("parameterised_orders")
    return o.sparkSession.sql("SELECT o_orderpriority, count(*) AS n FROM parameterised_orders WHERE o_totalprice > :least AND o_orderstatus = :status GROUP BY 1", args={"least": 100000, "status": "F"})


@on("customer", "nation", "supplier")
def mapped_keys(c: DataFrame, n: DataFrame, s: DataFrame) -> DataFrame:
    """Two slave ports joined by a mapping of differently named keys."""
    first, second = R.key_mapping("$c_nationkey=$n_nationkey # $c_custkey = $s_suppkey; $c_nationkey=$s_nationkey")
    out = R.hash_join(c.select("c_custkey", "c_nationkey"), n.select("n_nationkey", "n_name"), first, ["n_name"])
    return R.hash_join(out, s.select("s_suppkey", "s_nationkey", "s_name"), second, ["s_name"]).select("c_custkey", "n_name", "s_name")


@on("part")
def called_out(p: DataFrame) -> DataFrame:
    """Rows through an outside function in batches."""
    return R.call_out(p.select("p_partkey", "p_size"), lambda b: b.assign(p_size=b["p_size"] * 2), "p_partkey bigint, p_size int")


@on("part", "customer")
def hashed_ports(p: DataFrame, c: DataFrame) -> DataFrame:
    """Records copied by name and by place, spread over ports by key: every row reaches one port, and a copy each of two."""
    same = p.select("p_partkey", "p_name").select(*C.copy_by_name(["p_partkey", "p_name"], ["P_NAME", "P_PARTKEY", "absent"]))
    placed = R.hash_partition(same, ["P_PARTKEY"], 4)
    twice = R.to_ports(c.select("c_custkey", "c_name").select(*C.copy_by_position(["c_custkey", "c_name"], ["id", "name"])), [0, 1])
    one = placed.agg(F.count(F.lit(1)).alias("rows"), F.sum((F.col("port").between(0, 3)).cast("int")).alias("inside"), F.count("absent").alias("absent"), F.sum("P_PARTKEY").alias("keys"))
    two = twice.groupBy("port").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("keys"))
    return one.select(F.lit(-1).alias("port"), "rows", "inside", "absent", "keys").unionByName(two.select("port", "rows", F.lit(None).cast("bigint").alias("inside"), F.lit(None).cast("bigint").alias("absent"), "keys"))


QUERIES = {
    f.__name__: f
    for f in (
        route_ports, reject_reasons, expand_words, winner_per_key, rollup_summary, running_detail, retractions, month_report, fiscal_quarters, islands_of_types, reset_balances, snapshot_changes,
        outer_gaps, tariff_cascade, lookup_chain, type_versions, close_and_open, clipped_levels, generated_discounts, numbered_output, json_entries, sessions, config_changes, batches_of_rows, zipped_flows,
        settlement_states, receipt_states, tariff_operations, handled_errors, graph_parameters, mapped_keys, called_out, hashed_ports,
    )
}

_ISLANDS = "i AS (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM event_type AND rn > 1 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(event_type) OVER w AS p, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"

ORACLES = {
    "route_ports": "SELECT CAST(CASE WHEN o_orderstatus = 'P' THEN 4 WHEN o_totalprice IS NULL OR o_totalprice < 0 THEN 5 WHEN o_orderpriority = '1-URGENT' THEN 0 WHEN o_totalprice > 300000 THEN 1 WHEN year(o_orderdate) < 1994 THEN 2 ELSE 3 END AS INT) AS port, count(*) AS n, min(o_orderkey) AS first_key FROM orders GROUP BY 1",
    "reject_reasons": "WITH x AS (SELECT o_orderkey, list_filter([CASE WHEN o_totalprice < 50000 THEN 'LOW' END, CASE WHEN year(o_orderdate) < 1995 THEN 'OLD' END, CASE WHEN starts_with(o_orderpriority, '5') THEN 'SLOW' END], lambda r: r IS NOT NULL) AS l FROM orders) SELECT o_orderkey, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') END AS reasons, l[1] AS first_reason FROM x",
    "expand_words": "WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_name), ' '), lambda x: length(x) > 0) AS a FROM part), u AS (SELECT p_partkey, a, unnest(a) AS word, generate_subscripts(a, 1) AS i FROM w), d AS (SELECT p_partkey, word, min(i) AS i FROM u GROUP BY 1, 2) SELECT p_partkey, word, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS INT) AS ordinal, CAST(count(*) OVER (PARTITION BY p_partkey) AS INT) AS total FROM d",
    "winner_per_key": "SELECT l_orderkey, l_linenumber, n FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag <> 'N') DESC, l_shipdate DESC NULLS LAST, l_quantity DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1",
    "rollup_summary": "SELECT l_orderkey, count(*) AS rows, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS units, count(*) FILTER (l_shipdate > TIMESTAMP '1996-06-30') AS late, (list(l_partkey ORDER BY l_extendedprice DESC, l_linenumber DESC))[1] AS top_part FROM lineitem GROUP BY 1",
    "running_detail": "SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER w AS DOUBLE) AS so_far, CASE WHEN l_quantity < 20 THEN 'INELIGIBLE' WHEN count(*) FILTER (l_quantity >= 20) OVER w = 1 THEN 'WINNER' ELSE 'ELIGIBLE' END AS disposition, first_value(CASE WHEN l_quantity >= 20 THEN l_linenumber END IGNORE NULLS) OVER w AS winner FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)",
    "retractions": "WITH x AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id, length(event_type)) AS gone FROM events) SELECT user_id, count(*) AS left, max(event_id) AS last FROM x WHERE event_type <> 'purchase' AND (gone IS NULL OR gone < event_id) GROUP BY 1",
    "month_report": "WITH d AS (SELECT *, o_orderstatus = 'O' AND lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 'F' AS reopened FROM orders) SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS done, round(count(*) FILTER (o_orderstatus = 'O') / count(*), 6) AS open_share, count(*) FILTER (reopened) AS reopened FROM d GROUP BY 1",
    "fiscal_quarters": "WITH x AS (SELECT CAST(year(o_orderdate - INTERVAL 3 MONTH) AS INT) AS fy, CAST(quarter(o_orderdate - INTERVAL 3 MONTH) AS INT) AS fq, o_totalprice >= 100000 AS ok, CAST(o_totalprice AS DECIMAL(18,2)) AS p, CASE WHEN starts_with(o_orderpriority, '1') THEN 2 ELSE 1 END AS w FROM orders) SELECT fy, fq, count(*) FILTER (ok) AS eligible, count(*) FILTER (NOT ok) AS excluded, round(CAST(sum(p * w) FILTER (ok) AS DOUBLE) / CAST(sum(w) FILTER (ok) AS DOUBLE), 2) AS average FROM x GROUP BY 1, 2 HAVING count(*) FILTER (ok) > 0",
    "islands_of_types": f"WITH {_ISLANDS} SELECT user_id, CAST(island AS BIGINT) AS island, event_type, count(*) AS n, min(event_id) AS least_id FROM i GROUP BY ALL",
    "reset_balances": "WITH x AS (SELECT *, CAST(value AS DECIMAL(18,4)) AS v, CASE event_type WHEN 'login' THEN coalesce(CAST(value AS DECIMAL(18,4)), 0) WHEN 'logout' THEN 0 END AS s FROM events), y AS (SELECT *, count(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM x) SELECT event_id, CAST(sum(coalesce(s, CASE WHEN event_type = 'click' THEN coalesce(v, 0) END, 0)) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM y",
    "snapshot_changes": "WITH a AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS p FROM orders WHERE o_orderkey % 5 <> 0), j AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, a.o_orderkey AS ka, b.o_orderkey AS kb, array_to_string(list_filter([CASE WHEN a.s IS DISTINCT FROM b.s THEN 'o_orderstatus' END, CASE WHEN a.p IS DISTINCT FROM b.p THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') AS c FROM a FULL JOIN b USING (o_orderkey)) SELECT o_orderkey, CASE WHEN kb IS NULL THEN 'ONLY_A' WHEN ka IS NULL THEN 'ONLY_B' WHEN c = '' THEN 'UNCHANGED' ELSE 'UPDATE' END AS status, CASE WHEN ka IS NOT NULL AND kb IS NOT NULL THEN c ELSE '' END AS changed FROM j",
    "outer_gaps": "WITH s AS (SELECT l_orderkey AS k, sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS settled FROM lineitem GROUP BY 1), d AS (SELECT k, o_orderkey AS k2, coalesce(settled, 0) - coalesce(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS delta FROM orders FULL JOIN s ON k = o_orderkey) SELECT CASE WHEN k2 IS NULL THEN 'UNPLANNED' WHEN k IS NULL THEN 'WAITING' WHEN delta < 0 THEN 'SHORT' ELSE 'EXCESS' END AS state, count(*) AS n, CAST(sum(delta) AS DOUBLE) AS delta FROM d WHERE delta <> 0 GROUP BY 1",
    "tariff_cascade": "SELECT o_orderkey, CAST(CASE WHEN u THEN 1 WHEN v THEN 2 WHEN w THEN 3 END AS INT) AS level, CAST(CASE WHEN u THEN 10 WHEN v THEN 20 WHEN w THEN 30 END AS INT) AS fee FROM (SELECT o_orderkey, o_orderpriority = '1-URGENT' AND o_orderdate BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1995-12-31' AS u, o_orderdate >= TIMESTAMP '1994-06-01' AS v, o_orderdate BETWEEN TIMESTAMP '1990-01-01' AND TIMESTAMP '1996-12-31' AS w FROM orders JOIN customer ON c_custkey = o_custkey)",
    "lookup_chain": "SELECT c_custkey, n_name, upper(r_name) AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey",
    "type_versions": f"WITH {_ISLANDS}, v AS (SELECT user_id, island, event_type, arg_min(event_id, (ts, event_id)) AS valid_from, min((ts, event_id)) AS o FROM i GROUP BY 1, 2, 3) SELECT user_id, event_type, valid_from, lead(valid_from) OVER (PARTITION BY user_id ORDER BY island) AS valid_to, CAST(row_number() OVER (PARTITION BY user_id ORDER BY island) AS INT) AS version FROM v",
    "close_and_open": "WITH d AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders), x AS (SELECT * FROM d WHERE was IS DISTINCT FROM o_orderstatus) SELECT o_orderkey, 'CLOSE' AS op, was AS status FROM x WHERE was IS NOT NULL UNION ALL SELECT o_orderkey, 'OPEN', o_orderstatus FROM x",
    "clipped_levels": """WITH RECURSIVE x AS MATERIALIZED (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN -round(value) ELSE round(value) END AS d, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
        t AS (SELECT user_id, event_id, rn, least(greatest(coalesce(d, 0), 0), 100) AS level, greatest(coalesce(d, 0) - 100, 0) AS spill FROM x WHERE rn = 1
              UNION ALL SELECT x.user_id, x.event_id, x.rn, least(greatest(t.level + coalesce(x.d, 0), 0), 100), greatest(t.level + coalesce(x.d, 0) - 100, 0) FROM t JOIN x ON x.user_id = t.user_id AND x.rn = t.rn + 1)
        SELECT user_id, event_id, level, spill FROM t""",
    "generated_discounts": "SELECT id, CASE WHEN id % 2 = 0 THEN id % 10 ELSE -(id % 7) END AS discount FROM (SELECT unnest(range(1000)) AS id)",
    "numbered_output": "SELECT o_orderkey, CAST(100 + 10 * (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1) AS INT) AS seq FROM orders WHERE o_orderstatus = 'F'",
    "json_entries": "WITH k AS (SELECT event_id, props, list_sort(json_keys(props)) AS ks FROM events), u AS (SELECT event_id, props, unnest(ks) AS key, generate_subscripts(ks, 1) AS i FROM k) SELECT event_id, key, CAST(i AS INT) AS ordinal, json_extract_string(props, '$.\"' || key || '\"') AS value FROM u WHERE coalesce(json_extract_string(props, '$.\"' || key || '\"'), '') <> ''",
    "sessions": "WITH d AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM d) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS least_id FROM s GROUP BY 1, 2",
    "config_changes": "WITH d AS (SELECT *, lag(run_params) OVER (PARTITION BY sandbox ORDER BY created_at, example_id) AS old FROM setup_bundles) SELECT example_id, array_to_string(list_sort(list_filter(list_distinct(list_concat(map_keys(old), map_keys(run_params))), lambda k: old[k] IS DISTINCT FROM run_params[k])), ',') AS changed FROM d WHERE old IS NOT NULL AND run_params IS NOT NULL",
    "batches_of_rows": "WITH d AS (SELECT *, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) // 3 AS grp FROM lineitem) SELECT l_suppkey, grp, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS units FROM d GROUP BY 1, 2",
    "settlement_states": "WITH s AS (SELECT l_orderkey AS k, sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS settled FROM lineitem GROUP BY 1), d AS (SELECT k, o_orderkey AS k2, o_orderpriority = '5-LOW' AS bad, coalesce(settled, 0) - coalesce(CAST(o_totalprice AS DECIMAL(18,2)), 0) AS delta FROM orders FULL JOIN s ON k = o_orderkey), x AS (SELECT CASE WHEN bad THEN 'REPAIR' WHEN k2 IS NULL THEN 'UNPLANNED' WHEN k IS NULL THEN 'WAITING' WHEN delta < 0 THEN 'SHORT' ELSE 'EXCESS' END AS state, delta FROM d) SELECT state, count(*) AS n, CAST(sum(CASE WHEN state <> 'REPAIR' THEN delta END) AS DOUBLE) AS delta FROM x WHERE state = 'REPAIR' OR delta <> 0 GROUP BY 1",
    "receipt_states": "WITH i AS (SELECT *, CASE WHEN l_returnflag = 'A' THEN '' ELSE CAST(l_partkey % 3 AS VARCHAR) END AS id FROM lineitem), s AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, id ORDER BY l_linenumber, l_partkey, l_extendedprice) AS seen FROM i), f AS (SELECT *, id <> '' AND seen = 1 AND NOT (l_linestatus = 'F' OR l_quantity IS NULL OR l_quantity <= 5) AS fits FROM s) SELECT l_orderkey, l_linenumber, CASE WHEN id = '' THEN 'INVALID' WHEN seen > 1 THEN 'DUPLICATE' WHEN NOT fits THEN 'INELIGIBLE' WHEN count(*) FILTER (fits) OVER w = 1 THEN 'WINNER' ELSE 'ELIGIBLE' END AS state, first_value(CASE WHEN fits THEN id END IGNORE NULLS) OVER w AS winner FROM f WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)",
    "tariff_operations": "WITH d AS (SELECT *, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS was FROM orders), x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN ['CLOSE', 'CANCELLED'] WHEN o_totalprice < 20000 THEN ['ERROR'] WHEN was IS NOT DISTINCT FROM o_orderpriority THEN ['AUDIT'] WHEN was IS NULL THEN ['OPEN', 'AUDIT'] ELSE ['CLOSE', 'OPEN', 'AUDIT'] END AS a FROM d) SELECT o_orderkey, CAST(generate_subscripts(a, 1) - 1 AS INT) AS place, unnest(a) AS op FROM x",
    "handled_errors": "SELECT CASE WHEN o_orderstatus = 'P' THEN 'no number: x' END AS error, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN -1 ELSE o_custkey END) AS BIGINT) AS total, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS port FROM orders GROUP BY 1, 4",
    "graph_parameters": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' GROUP BY 1",
    "mapped_keys": "SELECT c_custkey, n_name, s_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN supplier ON s_suppkey = c_custkey AND s_nationkey = c_nationkey",
    "called_out": "SELECT p_partkey, p_size * 2 AS p_size FROM part",
    "hashed_ports": "SELECT -1 AS port, count(*) AS rows, count(*) AS inside, CAST(0 AS BIGINT) AS absent, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part UNION ALL SELECT port, count(*), NULL, NULL, CAST(sum(c_custkey) AS BIGINT) FROM customer, (SELECT unnest([0, 1]) AS port) GROUP BY port",
    "zipped_flows": "SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS rn FROM customer) FULL JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rn FROM supplier) USING (rn)",
}
