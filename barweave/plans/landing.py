"""Queries: landed files, text shaping, event tables and derived point-in-time features."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.functions import missing as ms, text as tx
from barweave.functions.tables import shared_folder
from barweave.operators import asof, base_features as bf, events as ev
from barweave.plans.context import FUND, zscore
from barweave.plans.registry import query, rounded
from barweave.plans.sqlparts import RETURNS, WEEKLY, with_
from barweave.sources import landing as ld
from barweave.sources.datasets import fresh_name
from barweave.sources.demo import quarterly_fundamentals, table, weekly_bars


# ---------------------------------------------------------------- files
@query("s4_universe_csv", "symbol:s", """SELECT DISTINCT upper(replace(n, '.', '-')) AS symbol FROM (
       SELECT CASE WHEN c_custkey % 10 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE substr(lower(c_mktsegment), 1, 4) || '.' || (c_custkey % 40) END AS n FROM customer)
       WHERE regexp_matches(n, '^[a-zA-Z]')""")
def universe_csv(spark, folder):
    key = F.col("c_custkey")
    name = F.when(key % 10 == 0, key.cast("string")).otherwise(
        F.concat(F.substring(F.lower("c_mktsegment"), 1, 4), F.lit("."), key % 40)
    )
    path = f"{shared_folder(spark)}/universe/{fresh_name()}"
    table(spark, folder, "customer").select(F.concat(F.lit(" "), name).alias("symbol")).write.csv(path, header=True)
    return ld.read_universe(spark, path)


@query("s5_trades_csv", "symbol:s trade_date:t amount_usd:d2 side:s n:i", """
SELECT 'S-' || l_suppkey AS symbol, l_shipdate AS trade_date, CASE WHEN l_linenumber = 1 THEN 0 ELSE l_extendedprice END AS amount_usd,
       CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'exchange' END AS side, count(*) AS n
FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1, 2, 3, 4""")
def trades_csv(spark, folder):
    li = table(spark, folder, "lineitem")
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    path = f"{shared_folder(spark)}/trades/{fresh_name()}"
    li.select(
        F.concat(F.lit("s."), F.col("l_suppkey")).alias("symbol"),
        F.when(line == 2, F.lit("unknown")).otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("trade_date"),
        F.when(line == 1, F.lit("")).otherwise(F.col("l_extendedprice").cast("string")).alias("amount_usd"),
        F.when(flag == "A", " BUY").when(flag == "R", "Sell ").otherwise("Exchange").alias("side"),
    ).write.csv(path, header=True)
    return ld.read_trades(spark, path).groupBy("symbol", "trade_date", "amount_usd", "side").agg(F.count(F.lit(1)).alias("n"))


@query("s7_json_payload", "event_id:i name:s k:s", """
SELECT event_id, NULL AS name, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events
UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_id % 3 = 1
UNION ALL SELECT event_id, NULL, CAST(json_extract(props, '$.k') AS VARCHAR) FROM events WHERE event_id % 3 = 2""")
def json_payload(spark, folder):
    ev_ = table(spark, folder, "events")
    i, p = F.col("event_id"), F.col("props")
    payload = (
        F.when(i % 3 == 0, F.concat(F.lit('{"meta": 1, "historical": ['), p, F.lit(', "'), F.col("event_type"), F.lit('"]}')))
        .when(i % 3 == 1, F.concat(F.lit("["), p, F.lit(', "'), F.col("event_type"), F.lit('"]')))
        .otherwise(F.concat(F.lit('{"data": ['), p, F.lit(", "), p, F.lit("]}")))
    )
    rows = ld.payload_rows(ev_.select("event_id", payload.alias("payload")))
    return rows.select(
        "event_id", F.get_json_object("item", "$.name").alias("name"), F.get_json_object("item", "$.k").alias("k")
    )


@query("s9_rate_table", "datetime:t macro_tsy_2y:d macro_tsy_10y:d", """
SELECT o_orderdate AS datetime, CASE WHEN arg_max(o_orderkey, o_orderkey) % 6 <> 0 THEN arg_max(o_totalprice / 100000, o_orderkey) END AS macro_tsy_2y,
       arg_max(o_totalprice / 50000, o_orderkey) AS macro_tsy_10y FROM orders GROUP BY 1""")
def rate_table(spark, folder):
    o = table(spark, folder, "orders")
    raw = o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderkey") % 6 == 0, "n/a").otherwise((F.col("o_totalprice") / 100000).cast("string")).alias("year2"),
        (F.col("o_totalprice") / 50000).alias("year10"),
        "o_orderkey",
    )
    return ld.rate_table(raw, "o_orderkey")


@query("s11_first_number", "o_orderkey:i number:d", """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN round(o_totalprice) / 100 WHEN 2 THEN o_orderkey * 1000 END AS number FROM orders""")
def first_number(spark, folder):
    o = table(spark, folder, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    body = (
        F.when(k % 4 == 0, F.concat(F.lit('"value": "n/a", "price": "'), F.format_number(F.floor(price), 0), F.lit('"')))
        .when(k % 4 == 1, F.concat(F.lit('"country": "7", "rate": "'), F.round(price).cast("bigint"), F.lit('%"')))
        .when(k % 4 == 2, F.concat(F.lit('"note": "none", "size": "'), k, F.lit('k"')))
        .otherwise(F.lit('"note": "text"'))
    )
    item = F.concat(F.lit('{"date": "2020-01-01", '), body, F.lit("}"))
    return o.select("o_orderkey", item.alias("item")).select("o_orderkey", ld.first_number(F.col("item")).alias("number"))


# ---------------------------------------------------------------- text
@query("p6_symbols", "c_custkey:i plain:s strict:s equity:i valuation:s", """
SELECT c_custkey, upper(replace(trim(n), '.', '-')) AS plain,
       CASE WHEN regexp_full_match(upper(replace(trim(n), '.', '-')), '[A-Z0-9\\-]{1,10}') AND upper(trim(n)) NOT IN ('NAN', 'NONE', 'NULL') THEN upper(replace(trim(n), '.', '-')) END AS strict,
       CAST(regexp_matches(upper(trim(n)), '^[A-Z]') AS INT) AS equity, regexp_replace(upper(trim(n)), '[^A-Z0-9.\\-]', '', 'g') AS valuation
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' nan ' WHEN 1 THEN c_name WHEN 2 THEN lower(substr(c_mktsegment, 1, 3)) || '.' || c_nationkey
             WHEN 3 THEN c_nationkey || 'x' ELSE ' a b$' || c_nationkey END AS n FROM customer)""")
def symbols(spark, folder):
    k = F.col("c_custkey")
    n = (
        F.when(k % 5 == 0, " nan ")
        .when(k % 5 == 1, F.col("c_name"))
        .when(k % 5 == 2, F.concat(F.lower(F.substring("c_mktsegment", 1, 3)), F.lit("."), F.col("c_nationkey")))
        .when(k % 5 == 3, F.concat(F.col("c_nationkey"), F.lit("x")))
        .otherwise(F.concat(F.lit(" a b$"), F.col("c_nationkey")))
    )
    raw = table(spark, folder, "customer").select("c_custkey", n.alias("n"))
    c = F.col("n")
    return raw.select(
        "c_custkey",
        tx.plain_symbol(c).alias("plain"),
        tx.strict_symbol(c).alias("strict"),
        tx.is_equity_symbol(c).alias("equity"),
        tx.valuation_symbol(c).alias("valuation"),
    )


@query("p7_parse_number", "o_orderkey:i number:d2", """
SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN o_orderkey * 1000.0 WHEN 2 THEN o_orderkey * 1e6 WHEN 3 THEN o_orderkey / 100.0
       WHEN 4 THEN -o_orderkey * 1e9 WHEN 5 THEN NULL ELSE o_orderkey * 1e12 END AS number FROM orders""")
def parse_number(spark, folder):
    k = F.col("o_orderkey")
    text = (
        F.when(k % 7 == 0, F.format_number(F.floor("o_totalprice"), 0))
        .when(k % 7 == 1, F.concat(k, F.lit("K")))
        .when(k % 7 == 2, F.concat(F.lit(" "), k, F.lit("m ")))
        .when(k % 7 == 3, F.concat(k, F.lit("%")))
        .when(k % 7 == 4, F.concat(F.lit("-"), k, F.lit("B")))
        .when(k % 7 == 5, F.lit("N/A"))
        .otherwise(F.concat(k, F.lit("T")))
    )
    return table(spark, folder, "orders").select("o_orderkey", tx.parse_number(text).alias("number"))


@query("p8_amount_range", "o_orderkey:i low:d2 high:d2 mid:d2", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE floor(o_totalprice) END AS low, CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice) + 5000 WHEN 1 THEN floor(o_totalprice) END AS high,
       CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice) + 2500 WHEN 1 THEN floor(o_totalprice) END AS mid FROM orders""")
def amount_range(spark, folder):
    k, p = F.col("o_orderkey"), F.floor("o_totalprice")
    text = (
        F.when(k % 3 == 0, F.concat(F.lit("$"), F.format_number(p + 5000, 0), F.lit(" - $"), F.format_number(p, 0)))
        .when(k % 3 == 1, F.concat(F.format_number(p, 0), F.lit(" USD")))
        .otherwise("undisclosed")
    )
    parsed = table(spark, folder, "orders").select("o_orderkey", tx.parse_amount_range(text).alias("r"))
    return parsed.select("o_orderkey", "r.low", "r.high", "r.mid")


WORDS = ["Purchase", "Sale (Partial)", "Exchange", "acquisition", "Disposition", "S-Sold", "received", "buy then sell"]
GRADES = ["Strong Buy", "strong sell", "Outperform", "Overweight", "Buy", "Accumulate", "Underperform", "Negative", "Sell", "Hold", "Neutral", "Reduce"]


def pick(words, key):
    return F.element_at(F.array(*map(F.lit, words)), (key % len(words) + 1).cast("int"))


def pick_sql(words, key):
    return "([" + ", ".join(f"'{w}'" for w in words) + f"])[{key} % {len(words)} + 1]"


GRADE_SQL = """CASE WHEN {x} LIKE '%strong buy%' THEN 2 WHEN {x} LIKE '%strong sell%' THEN -2 WHEN regexp_matches({x}, 'outperform|overweight') THEN 2
  WHEN regexp_matches({x}, 'buy|positive|accumulate') THEN 1 WHEN regexp_matches({x}, 'underperform|underweight|negative|reduce') THEN -1 WHEN {x} LIKE '%sell%' THEN -1 ELSE 0 END"""


@query("p9_p10_side_grade", "p_partkey:i side:s grade:x", f"""
SELECT p_partkey, CASE WHEN regexp_matches(w, 'purchase|buy|acquire|acquisition|received') THEN 'buy' WHEN regexp_matches(w, 'sale|sell|sold|dispose|disposition') THEN 'sell' ELSE 'other' END AS side,
       {GRADE_SQL.format(x="g")} AS grade FROM (SELECT p_partkey, lower({pick_sql(WORDS, "p_partkey")}) AS w, lower({pick_sql(GRADES, "p_partkey")}) AS g FROM part)""")
def side_grade(spark, folder):
    k = F.col("p_partkey")
    return table(spark, folder, "part").select(
        "p_partkey", tx.trade_side(pick(WORDS, k)).alias("side"), tx.grade_score(pick(GRADES, k)).alias("grade")
    )


@query("p11_slug", "doc_id:i slug:s model:s", """
SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(source || ' / ' || lang || '!'), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown') AS slug,
       nullif(trim(regexp_replace(regexp_replace(regexp_replace(lower(source || '  ' || lang || '!'), '\\s+', '_', 'g'), '[^a-z0-9_-]+', '', 'g'), '_+', '_', 'g'), '_'), '') AS model FROM documents""")
def slug(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.select(
        "doc_id",
        tx.slug(F.concat_ws(" / ", "source", F.concat("lang", F.lit("!")))).alias("slug"),
        tx.model_name(F.concat("source", F.lit("  "), "lang", F.lit("!"))).alias("model"),
    )


@query("p13_safe_values", "o_custkey:i ratio:d first_text:s last_price:d2", """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS p FROM orders)
SELECT o_custkey, sum(o_totalprice) / nullif(sum(o_orderkey % 4), 0) AS ratio,
       CASE WHEN o_custkey % 2 = 0 THEN max(o_orderstatus) ELSE max(o_orderpriority) END AS first_text,
       arg_max(p, o_orderkey) FILTER (WHERE p IS NOT NULL) AS last_price FROM o GROUP BY o_custkey""")
def safe_values(spark, folder):
    o = table(spark, folder, "orders")
    sparse = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice"))
    grouped = o.groupBy("o_custkey").agg(
        F.sum("o_totalprice").alias("a"),
        F.sum(F.col("o_orderkey") % 4).cast("double").alias("b"),
        F.max("o_orderstatus").alias("s"),
        F.max("o_orderpriority").alias("t"),
        F.max_by(sparse, F.when(sparse.isNotNull(), F.col("o_orderkey"))).alias("last_price"),
    )
    blank = F.when(F.col("o_custkey") % 2 == 0, F.col("s")).otherwise("")
    return grouped.select(
        "o_custkey", ms.ratio(F.col("a"), F.col("b")).alias("ratio"), ms.first_valid(blank, F.col("t")).alias("first_text"), "last_price"
    )


# ---------------------------------------------------------------- side tables
def ratio_metric(spark, folder):
    q = quarterly_fundamentals(spark, folder)
    key = F.col("symbol")
    ratios = q.where(key % 7 != 0).select("symbol", "asof_datetime", (F.col("revenue") / 1e4).alias("peRatioTTM"), F.col("mean_discount").alias("currentRatioTTM"))
    metrics = q.where(key % 5 != 0).select(
        "symbol", "asof_datetime", (F.col("revenue") / 2e4).alias("peRatioTTM"), (F.col("revenue") * 3).alias("marketCapTTM"), F.col("line_count").alias("revenueGrowthTTM")
    )
    return ratios, metrics


RATIO_METRIC = FUND.strip() + """,
ra AS (SELECT symbol, asof_datetime, revenue / 1e4 AS pe, mean_discount AS cr FROM fund WHERE symbol % 7 <> 0),
me AS (SELECT symbol, asof_datetime, revenue / 2e4 AS pe, revenue * 3 AS mc, line_count AS rg FROM fund WHERE symbol % 5 <> 0),
rm AS (SELECT coalesce(ra.symbol, me.symbol) AS symbol, coalesce(ra.asof_datetime, me.asof_datetime) AS asof_datetime, ra.pe AS pe_r, me.pe AS pe_m, cr, mc, rg
       FROM ra FULL JOIN me ON ra.symbol = me.symbol AND ra.asof_datetime = me.asof_datetime)"""


@query("e2_j5_ratio_metric_join", "symbol:i asof_datetime:t peRatioTTM_ratio:d2 peRatioTTM_metric:d2 currentRatioTTM:d marketCapTTM:d0 revenueGrowthTTM:x",
       with_(RATIO_METRIC, select="SELECT symbol, asof_datetime, pe_r AS peRatioTTM_ratio, pe_m AS peRatioTTM_metric, cr AS currentRatioTTM, mc AS marketCapTTM, rg AS revenueGrowthTTM FROM rm"))
def ratio_metric_join(spark, folder):
    return ev.join_ratio_metric(*ratio_metric(spark, folder))


@query("e1_resolved_fields", "symbol:i asof_datetime:t market_cap:d0 trailing_pe:d2 current_ratio:d revenue_growth:x beta:d",
       with_(RATIO_METRIC, select="""SELECT symbol, asof_datetime, coalesce(mc, s_acctbal) AS market_cap, coalesce(pe_r, pe_m) AS trailing_pe, coalesce(cr, s_nationkey) AS current_ratio,
       rg AS revenue_growth, s_acctbal / 1000 AS beta FROM rm LEFT JOIN supplier ON s_suppkey = symbol"""))
def resolved_fields(spark, folder):
    profile = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("symbol"), F.col("s_acctbal").alias("marketCap"), (F.col("s_acctbal") / 1000).alias("beta"), F.col("s_nationkey").alias("currentRatio")
    )
    joined = ev.join_ratio_metric(*ratio_metric(spark, folder))
    return ev.resolve_fields(joined, profile, ["market_cap", "trailing_pe", "current_ratio", "revenue_growth", "beta"])


SIDE_ROWS = """
side_rows AS (SELECT l_suppkey AS symbol, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS asof_datetime,
  CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS a, CASE WHEN l_linenumber % 3 = 0 THEN l_tax END AS b,
  l_orderkey * 1000 + l_linenumber AS seq, l_partkey FROM lineitem)"""


def side_rows(spark, folder):
    li = table(spark, folder, "lineitem")
    n = F.col("l_linenumber")
    return li.select(
        F.col("l_suppkey").alias("symbol"),
        F.date_trunc("month", "l_shipdate").alias("asof_datetime"),
        F.when(n % 2 == 0, F.col("l_discount")).alias("a"),
        F.when(n % 3 == 0, F.col("l_tax")).alias("b"),
        F.struct((F.col("l_orderkey") * 1000 + n).alias("seq"), F.col("l_partkey").alias("p"), F.col("l_extendedprice").alias("x")).alias("seq"),
    )


@query("e3_side_table", "symbol:i asof_datetime:t a:d b:d c:d", with_(SIDE_ROWS.replace("l_partkey FROM", "l_partkey, l_extendedprice FROM"), select="""
SELECT symbol, asof_datetime, arg_max(a, row(seq, l_partkey, l_extendedprice)) FILTER (WHERE a IS NOT NULL) AS a,
       arg_max(b, row(seq, l_partkey, l_extendedprice)) FILTER (WHERE b IS NOT NULL) AS b, CAST(NULL AS DOUBLE) AS c FROM side_rows GROUP BY 1, 2"""))
def side_table(spark, folder):
    return ev.normalize_side_table(side_rows(spark, folder), ["a", "b", "c"], "seq")


@query("e4_refresh", "symbol:i asof_datetime:t revenue:d2 mean_discount:d stale:i", with_(FUND, """
old AS (SELECT * FROM fund WHERE symbol % 9 <> 0), new AS (SELECT symbol, asof_datetime, revenue * 2 AS revenue, CASE WHEN symbol % 2 = 0 THEN 0.5 END AS mean_discount FROM fund WHERE symbol % 4 = 0),
fresh AS (SELECT symbol FROM old WHERE mean_discount IS NOT NULL GROUP BY 1 HAVING count(*) >= 12)""", select="""
SELECT coalesce(o.symbol, n.symbol) AS symbol, coalesce(o.asof_datetime, n.asof_datetime) AS asof_datetime, coalesce(n.revenue, o.revenue) AS revenue, coalesce(n.mean_discount, o.mean_discount) AS mean_discount,
       CASE WHEN coalesce(o.symbol, n.symbol) IN (SELECT symbol FROM fresh) THEN 0 ELSE 1 END AS stale
FROM old o FULL JOIN new n ON o.symbol = n.symbol AND o.asof_datetime = n.asof_datetime"""))
def refresh(spark, folder):
    q = quarterly_fundamentals(spark, folder).select("symbol", "asof_datetime", "revenue", "mean_discount")
    old = q.where(F.col("symbol") % 9 != 0)
    new = q.where(F.col("symbol") % 4 == 0).select(
        "symbol", "asof_datetime", (F.col("revenue") * 2).alias("revenue"), F.when(F.col("symbol") % 2 == 0, 0.5).alias("mean_discount")
    )
    merged = ev.refresh(old, new, ["revenue", "mean_discount"])
    stale = ev.stale_symbols(q, old, ["mean_discount"], 12).withColumn("stale", F.lit(1))
    return merged.join(stale, "symbol", "left").fillna(0, ["stale"])


def opinions(spark, folder):
    o = table(spark, folder, "orders")
    n = lambda p: F.sum((F.col("o_orderpriority") == p).cast("int"))
    return o.groupBy((F.col("o_custkey") % 200).alias("symbol"), F.date_trunc("month", "o_orderdate").alias("asof_datetime")).agg(
        n("1-URGENT").alias("strong_buy"), n("2-HIGH").alias("buy"), n("3-MEDIUM").alias("hold"), n("4-NOT SPECIFIED").alias("sell"), n("5-LOW").alias("strong_sell"),
        F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") / 1e5)).alias("consensus_score"),
    )


OPINIONS = """
op AS (SELECT o_custkey % 200 AS symbol, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS asof_datetime,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') + count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS b, count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM') AS h,
  count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED') + count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS s, count(*) AS t,
  max(o_totalprice / 1e5) FILTER (WHERE o_orderstatus = 'P') AS cs FROM orders GROUP BY 1, 2)"""


@query("e5_analyst_ratios", "symbol:i asof_datetime:t " + rounded("analyst_total_ratings analyst_buy_ratio analyst_hold_ratio analyst_sell_ratio analyst_net_score"),
       with_(OPINIONS, select="SELECT symbol, asof_datetime, t AS analyst_total_ratings, b / t AS analyst_buy_ratio, h / t AS analyst_hold_ratio, s / t AS analyst_sell_ratio, (b - s) / t AS analyst_net_score FROM op"))
def analyst_ratios(spark, folder):
    return ev.analyst_ratios(opinions(spark, folder))


@query("e6_rating_scores", "symbol:s asof_datetime:t rating_score:d rating_dcf_score:d", f"""
SELECT p_brand AS symbol, TIMESTAMP '2000-01-01' + INTERVAL 1 DAY * p_size AS asof_datetime,
       coalesce(CASE WHEN p_partkey % 4 = 0 THEN p_size / 10.0 END, {GRADE_SQL.format(x=f"lower({pick_sql(GRADES, 'p_partkey')})")}) AS rating_score, p_retailprice / 100 AS rating_dcf_score FROM part""")
def rating_scores(spark, folder):
    k = F.col("p_partkey")
    rows = table(spark, folder, "part").select(
        F.col("p_brand").alias("symbol"),
        F.timestamp_add("DAY", F.col("p_size"), F.lit("2000-01-01").cast("timestamp")).alias("asof_datetime"),
        F.when(k % 4 == 0, F.col("p_size") / 10.0).alias("score"),
        pick(GRADES, k).alias("recommendation"),
        (F.col("p_retailprice") / 100).alias("rating_dcf_score"),
    )
    return ev.rating_scores(rows)


@query("e7_earnings_surprise", "symbol:i asof_datetime:t " + rounded("earnings_eps_surprise earnings_eps_surprise_pct earnings_revenue_surprise_pct earnings_estimate_age_days"),
       with_(FUND, "z AS (SELECT *, lag(mean_discount) OVER w AS e, lag(revenue) OVER w AS re FROM fund WINDOW w AS (PARTITION BY symbol ORDER BY asof_datetime))", select="""
       SELECT symbol, asof_datetime, mean_discount - e AS earnings_eps_surprise, (mean_discount - e) / nullif(abs(e), 0) AS earnings_eps_surprise_pct,
              (revenue - re) / nullif(abs(re), 0) AS earnings_revenue_surprise_pct, symbol % 10 AS earnings_estimate_age_days FROM z"""))
def earnings_surprise(spark, folder):
    from barweave.functions.windows import by_symbol

    q, w = quarterly_fundamentals(spark, folder), by_symbol(order="asof_datetime")
    rows = q.select(
        "symbol", "asof_datetime", F.col("mean_discount").alias("eps"), F.lag("mean_discount").over(w).alias("eps_estimated"), "revenue",
        F.lag("revenue").over(w).alias("revenue_estimated"),
        F.timestamp_add("HOUR", (-24 * (F.col("symbol") % 10)).cast("int"), F.col("asof_datetime")).alias("updated_from"),
    )
    return ev.earnings_surprise(rows)


OLD = ["Sell", "Hold", "Buy", "Outperform"]


@query("e8_grade_changes", "symbol:i asof_datetime:t analyst_grade_net_30d:x analyst_grade_up_30d:x analyst_grade_down_30d:x", f"""
WITH g AS (SELECT o_custkey % 50 AS symbol, o_orderdate AS asof_datetime, {GRADE_SQL.format(x=f"lower({pick_sql(GRADES, 'o_orderkey')})")} - {GRADE_SQL.format(x=f"lower({pick_sql(OLD, 'o_custkey')})")} AS d FROM orders),
y AS (SELECT symbol, asof_datetime, sum(d) AS n, count(*) FILTER (WHERE d > 0) AS u, count(*) FILTER (WHERE d < 0) AS l FROM g GROUP BY 1, 2)
SELECT symbol, asof_datetime, sum(n) OVER w AS analyst_grade_net_30d, sum(u) OVER w AS analyst_grade_up_30d, sum(l) OVER w AS analyst_grade_down_30d
FROM y WINDOW w AS (PARTITION BY symbol ORDER BY asof_datetime RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)""")
def grade_changes(spark, folder):
    rows = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 50).alias("symbol"),
        F.col("o_orderdate").alias("asof_datetime"),
        pick(GRADES, F.col("o_orderkey")).alias("new_grade"),
        pick(OLD, F.col("o_custkey")).alias("previous_grade"),
    )
    return ev.grade_changes(rows)


def estimates(spark, folder):
    li = table(spark, folder, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("symbol"), F.date_trunc("quarter", "l_shipdate").alias("asof_datetime")).agg(
        *[f("l_discount").alias(f"eps_{n}") for f, n in ((F.avg, "avg"), (F.max, "high"), (F.min, "low"))],
        *[f("l_extendedprice").alias(f"revenue_{n}") for f, n in ((F.avg, "avg"), (F.max, "high"), (F.min, "low"))],
        F.max("l_quantity").alias("analyst_count"),
        F.min_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_extendedprice")).alias("price"),
    )


ESTIMATES = """
es AS (SELECT l_suppkey AS symbol, CAST(date_trunc('quarter', l_shipdate) AS TIMESTAMP) AS asof_datetime, avg(l_discount) AS ea, max(l_discount) AS eh, min(l_discount) AS el,
  avg(l_extendedprice) AS ra, max(l_extendedprice) AS rh, min(l_extendedprice) AS rl, max(l_quantity) AS ac,
  first(l_extendedprice ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)"""


@query("e9_estimate_dispersion", "symbol:i asof_datetime:t analyst_est_eps_dispersion:d analyst_est_revenue_dispersion:d",
       with_(ESTIMATES, select="SELECT symbol, asof_datetime, (eh - el) / nullif(abs(ea), 0) AS analyst_est_eps_dispersion, (rh - rl) / nullif(abs(ra), 0) AS analyst_est_revenue_dispersion FROM es"))
def estimate_dispersion(spark, folder):
    return ev.estimate_dispersion(ev.estimate_dispersion(estimates(spark, folder), "eps"), "revenue")


@query("e10_price_targets", "symbol:i asof_datetime:t price_target_mean:d4 price_target_upside:d price_target_dispersion:d price_target_analyst_count:x",
       with_(ESTIMATES, select="SELECT symbol, asof_datetime, ra AS price_target_mean, (ra - price) / abs(price) AS price_target_upside, (rh - rl) / abs(ra) AS price_target_dispersion, ac AS price_target_analyst_count FROM es"))
def price_targets(spark, folder):
    rows = estimates(spark, folder).withColumnsRenamed({"revenue_avg": "target_mean", "revenue_high": "target_high", "revenue_low": "target_low"})
    return ev.price_targets(rows)


@query("e11_consensus_grades", "symbol:i asof_datetime:t grades_consensus_score:d grades_consensus_buy_ratio:d grades_consensus_sell_ratio:d",
       with_(OPINIONS, select="SELECT symbol, asof_datetime, coalesce(cs, (b - s) / t) AS grades_consensus_score, b / t AS grades_consensus_buy_ratio, s / t AS grades_consensus_sell_ratio FROM op"))
def consensus(spark, folder):
    rows = opinions(spark, folder)
    for c in ("outperform", "overweight", "neutral", "underperform", "underweight"):
        rows = rows.withColumn(c, F.lit(None).cast("int"))
    return ev.consensus_grades(rows)


def insider_rows(spark, folder):
    li = table(spark, folder, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_suppkey").alias("symbol"),
        F.col("l_shipdate").alias("asof_datetime"),
        F.when(flag == "A", "P-Purchase").when(flag == "R", "S-Sale").otherwise("M-Exempt").alias("side"),
        F.col("l_quantity").alias("shares"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("value"),
        F.col("l_tax").alias("price"),
    )


INSIDER = """
ins AS (SELECT l_suppkey AS symbol, l_shipdate AS asof_datetime, sum(g * l_quantity) AS sh, sum(g * v) AS va, count(*) AS n, count(*) FILTER (WHERE g = 1) AS b, count(*) FILTER (WHERE g = -1) AS s
  FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS g, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice ELSE l_quantity * l_tax END AS v FROM lineitem) GROUP BY 1, 2),
insider AS (SELECT symbol, asof_datetime, sum(sh) OVER w AS insider_net_shares_30d, sum(va) OVER w AS insider_net_value_30d, sum(n) OVER w AS insider_trade_count_30d,
  sum(b) OVER w / (sum(s) OVER w + 1) AS insider_buy_sell_ratio_30d FROM ins WINDOW w AS (PARTITION BY symbol ORDER BY asof_datetime RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW))"""


@query("e12_insider_flow", "symbol:i asof_datetime:t insider_net_shares_30d:d3 insider_net_value_30d:d2 insider_trade_count_30d:x insider_buy_sell_ratio_30d:d",
       with_(INSIDER, select="SELECT * FROM insider"))
def insider(spark, folder):
    return ev.insider_flow(insider_rows(spark, folder))


@query("e13_sparse_union", "symbol:i asof_datetime:t analyst_net_score:d insider_trade_count_30d:x price_target_mean:d4",
       with_(OPINIONS, INSIDER, ESTIMATES, select="""
SELECT symbol, asof_datetime, (b - s) / t AS analyst_net_score, NULL AS insider_trade_count_30d, NULL AS price_target_mean FROM op
UNION ALL SELECT symbol, asof_datetime, NULL, insider_trade_count_30d, NULL FROM insider UNION ALL SELECT symbol, asof_datetime, NULL, NULL, ra FROM es"""))
def sparse_union(spark, folder):
    keys = ["symbol", "asof_datetime"]
    return ev.sparse_union(
        ev.analyst_ratios(opinions(spark, folder)).select(*keys, "analyst_net_score"),
        ev.insider_flow(insider_rows(spark, folder)).select(*keys, "insider_trade_count_30d"),
        price_targets(spark, folder).select(*keys, "price_target_mean"),
    )


@query("e14_parse_trades", "symbol:s trade_date:t amount_usd:d2 side:s politician:s chamber:s disclosure_lag_days:x amount_low_usd:d2 amount_high_usd:d2", """
WITH p AS (SELECT 'S-' || l_suppkey AS symbol, l_shipdate AS trade_date, CASE WHEN l_linenumber = 3 THEN 0 ELSE floor(l_extendedprice) + 500 END AS amount_usd,
  CASE l_returnflag WHEN 'A' THEN 'buy' WHEN 'R' THEN 'sell' ELSE 'other' END AS side, CASE WHEN l_linenumber % 2 = 0 THEN 'Rep ' || (l_partkey % 20) ELSE 'Ann Lee' || (l_partkey % 3) END AS politician, 'house' AS chamber,
  CAST(round(l_discount * 100) AS DOUBLE) AS disclosure_lag_days, CASE WHEN l_linenumber <> 3 THEN floor(l_extendedprice) END AS amount_low_usd, CASE WHEN l_linenumber <> 3 THEN floor(l_extendedprice) + 1000 END AS amount_high_usd,
  l_orderkey * 10000 + l_linenumber * 1000 + CAST(round(l_discount * 100) AS BIGINT) AS seq FROM lineitem WHERE l_linenumber <> 4 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '2001-01-01')
SELECT * EXCLUDE (seq, rk) FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_date, amount_usd, side, politician, chamber ORDER BY seq DESC) AS rk FROM p) WHERE rk = 1""")
def parse_trades(spark, folder):
    li = table(spark, folder, "lineitem")
    line, part, flag = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_returnflag")
    low = F.floor("l_extendedprice")
    lag = F.round(F.col("l_discount") * 100).cast("int")
    raw = li.select(
        F.when(line == 4, "a symbol too long").otherwise(F.concat(F.lit("s."), F.col("l_suppkey"))).alias("ticker"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("transactionDate"),
        F.date_format(F.date_add("l_shipdate", lag), "yyyy-MM-dd").alias("disclosureDate"),
        F.when(line == 3, "").otherwise(F.concat(F.lit("$"), F.format_number(low, 0), F.lit(" - $"), F.format_number(low + 1000, 0))).alias("amount"),
        F.when(flag == "A", "Purchase").when(flag == "R", "Sale (Full)").otherwise("Exchange").alias("type"),
        F.when(line % 2 == 0, F.concat(F.lit("Rep "), part % 20)).otherwise("").alias("representative"),
        F.lit("Ann").alias("firstName"),
        F.concat(F.lit("Lee"), part % 3).alias("lastName"),
        (F.col("l_orderkey") * 10000 + line * 1000 + lag).alias("seq"),
    )
    span = (F.lit("1996-01-01").cast("timestamp"), F.lit("2001-01-01").cast("timestamp"))
    return ev.parse_disclosed_trades(raw, F.lit("house"), F.col("seq"), *span)


# ---------------------------------------------------------------- derived features on bars
def enriched(spark, folder):
    """Bars with as-of fundamentals under the canonical names, own returns and stand-ins for flows and macro state."""
    f = quarterly_fundamentals(spark, folder).select(
        "symbol",
        "asof_datetime",
        (F.col("revenue") * 4).alias("market_cap"),
        (F.col("revenue") / 1e4).alias("trailing_pe"),
        F.col("mean_discount").alias("analyst_net_score"),
        (F.col("line_count") / 10).alias("rating_score"),
        (F.col("line_count") * 100).alias("shares_outstanding"),
        (F.col("revenue") * 0.1).alias("free_cashflow"),
        (F.col("mean_discount") * 2).alias("return_on_assets"),
        (F.col("line_count") / 100).alias("profit_margins"),
        (F.col("revenue") - 2e6).alias("insider_net_value_30d"),
    )
    bars = bf.add_returns(weekly_bars(spark, folder)).select("symbol", "datetime", "close", "volume", "ret_5")
    return asof.asof_join(bars, f, ["symbol"]).withColumns(
        {"politician_flow_30d": F.col("ret_5") * 100 - 20, "macro_surprise_abs_index": F.col("ret_5") / 2}
    )


ENRICHED = FUND.strip() + """,
side AS (SELECT symbol, asof_datetime, revenue * 4 AS market_cap, revenue / 1e4 AS trailing_pe, mean_discount AS analyst_net_score, line_count / 10 AS rating_score,
  line_count * 100 AS shares_outstanding, revenue * 0.1 AS free_cashflow, mean_discount * 2 AS return_on_assets, line_count / 100 AS profit_margins, revenue - 2e6 AS insider_net_value_30d FROM fund),
enr AS (SELECT b.symbol, b.datetime, close, volume, ret_5, s.* EXCLUDE symbol, ret_5 * 100 - 20 AS politician_flow_30d, ret_5 / 2 AS macro_surprise_abs_index
  FROM rets b ASOF LEFT JOIN side s ON b.symbol = s.symbol AND b.datetime >= s.asof_datetime),
der AS (SELECT *, 1 / nullif(trailing_pe, 0) AS earnings_yield, free_cashflow / nullif(market_cap, 0) AS free_cashflow_yield, volume / nullif(shares_outstanding, 0) AS turnover_ratio,
  close * volume AS dollar_volume, list_avg(list_filter([return_on_assets, profit_margins], lambda x : x IS NOT NULL)) AS quality_composite,
  list_avg(list_filter([analyst_net_score, rating_score], lambda x : x IS NOT NULL)) AS analyst_rating_blend FROM enr)"""


@query("e17_value_ratios", "symbol:i datetime:t earnings_yield:d free_cashflow_yield:d turnover_ratio:d quality_composite:d log_dollar_volume:d",
       with_(WEEKLY, RETURNS, ENRICHED, select="SELECT *, ln(1 + greatest(dollar_volume, 0)) AS log_dollar_volume FROM der"))
def value_ratios(spark, folder):
    return ev.add_value_ratios(enriched(spark, folder))


@query("e18_interactions", "symbol:i datetime:t analyst_rating_blend:d analyst_quality_interaction:d insider_flow_to_mcap_30d:d politician_insider_flow_alignment:x ret_5_macro_shock_adj:d",
       with_(WEEKLY, RETURNS, ENRICHED, select="""
SELECT symbol, datetime, analyst_rating_blend, analyst_net_score * quality_composite AS analyst_quality_interaction, insider_net_value_30d / nullif(market_cap, 0) AS insider_flow_to_mcap_30d,
       sign(politician_flow_30d) * sign(insider_net_value_30d) AS politician_insider_flow_alignment,
       ret_5 * (1 - least(3, greatest(0, coalesce(macro_surprise_abs_index, 0))) / 3) AS ret_5_macro_shock_adj FROM der"""))
def interactions(spark, folder):
    return ev.add_interactions(ev.add_value_ratios(enriched(spark, folder)))


W = "(PARTITION BY symbol ORDER BY datetime)"


@query("e19_symbol_deltas", "symbol:i datetime:t turnover_z_20:d5 analyst_net_score_delta_20:d rating_score_delta_20:d insider_net_value_30d_z_63:d4 politician_flow_30d_z_63:d4",
       with_(WEEKLY, RETURNS, ENRICHED, select=f"""
SELECT symbol, datetime, {zscore("turnover_ratio", 20, 5)} AS turnover_z_20, analyst_net_score - lag(analyst_net_score, 20) OVER {W} AS analyst_net_score_delta_20,
       rating_score - lag(rating_score, 20) OVER {W} AS rating_score_delta_20, {zscore("insider_net_value_30d", 63, 10)} AS insider_net_value_30d_z_63,
       {zscore("politician_flow_30d", 63, 10)} AS politician_flow_30d_z_63 FROM der"""))
def symbol_deltas(spark, folder):
    return ev.add_derived(enriched(spark, folder))
