"""Queries of the trade operators, over orders, line items, customers and events."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import finance as N
from lodestone.functions.finance import d
from lodestone.plans.base import query
from lodestone.scratch import keep

c = F.col


def half_up(x: Column) -> Column:
    """Six places by plain double arithmetic, so that quotients that end in a five agree between engines."""
    return F.floor(x * d(1e6) + d(0.5)) / d(1e6)


def _half_up(x: str) -> str:
    return f"floor(({x}) * 1000000::DOUBLE + 0.5::DOUBLE) / 1000000::DOUBLE"


def rounded(df: DataFrame, keys: list[str], **cols: Column) -> DataFrame:
    return df.select(*keys, *[F.round(x, 6).alias(n) for n, x in cols.items()])


_PDF = lambda x: f"(exp(-0.5::DOUBLE * {x} * {x}) / {math.sqrt(2 * math.pi)!r}::DOUBLE)"


def _cdf(x: str) -> str:
    t = f"(1::DOUBLE / (1::DOUBLE + 0.2316419::DOUBLE * abs({x})))"
    poly = f"(0.319381530::DOUBLE + {t} * (-0.356563782::DOUBLE + {t} * (1.781477937::DOUBLE + {t} * (-1.821255978::DOUBLE + {t} * 1.330274429::DOUBLE))))"
    tail = f"({_PDF(x)} * {t} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN 1::DOUBLE - {tail} ELSE {tail} END)"


@query("fin_norm_cdf", f"SELECT event_id, round({_cdf('x')}, 6) AS cdf, round({_PDF('x')}, 6) AS pdf FROM (SELECT event_id, value / 50.0::DOUBLE - 1.0::DOUBLE AS x FROM events)")
def _(t):
    x = c("value") / d(50) - d(1)
    return rounded(t.events, ["event_id"], cdf=N.normal_cdf(x), pdf=N.normal_pdf(x))


@query("fin_norm_pdf", f"SELECT event_id, round({_PDF('value')}, 6) AS pdf FROM events")
def _(t):
    return rounded(t.events, ["event_id"], pdf=N.normal_pdf(c("value")))


def _bs(years: float, columns: list[str], where: str = "true") -> str:
    q = math.sqrt(years)
    return f"""g AS (SELECT *, sigma * {q!r}::DOUBLE AS root, (ln(s / k) + (r + 0.5::DOUBLE * sigma * sigma) * {years!r}::DOUBLE) / (sigma * {q!r}::DOUBLE) AS d1, k * exp(-r * {years!r}::DOUBLE) AS paid FROM x WHERE {where}),
h AS (SELECT *, d1 - root AS d2 FROM g),
n AS (SELECT *, {_cdf('d1')} AS n1, {_cdf('d2')} AS n2, {_cdf('(-d1)')} AS m1, {_cdf('(-d2)')} AS m2, {_PDF('d1')} AS p1 FROM h),
o AS (SELECT *, CASE WHEN is_call THEN s * n1 - paid * n2 ELSE paid * m2 - s * m1 END AS price, CASE WHEN is_call THEN n1 ELSE n1 - 1 END AS delta, p1 / (s * root) AS gamma,
 (-s * p1 * sigma / {2 * q!r}::DOUBLE - r * paid * n2) / 365 AS theta, s * p1 * {q!r}::DOUBLE / 100 AS vega, CASE WHEN is_call THEN paid * {years!r}::DOUBLE * n2 / 100 ELSE -paid * {years!r}::DOUBLE * m2 / 100 END AS rho, greatest(0, s - k) AS intrinsic FROM n)"""


@query("fin_bs_price", f"""WITH x0 AS (SELECT p_partkey, p_retailprice AS s, p_retailprice * (0.8::DOUBLE + (p_partkey % 5) * 0.1::DOUBLE) AS k, 0.03::DOUBLE AS r, (p_partkey % 60) / 25.0::DOUBLE AS sigma, p_partkey % 2 = 0 AS is_call FROM part),
x AS (SELECT * FROM x0 WHERE s > 0 AND sigma BETWEEN 0.01 AND 2), {_bs(1.0, [])}
SELECT x0.p_partkey, {', '.join(f'round(o.{n}, 6) AS {n}' for n in ('price', 'delta', 'gamma', 'theta', 'vega', 'rho', 'intrinsic'))}, round(o.price - o.intrinsic, 6) AS time_value FROM x0 LEFT JOIN o USING (p_partkey)""")
def _(t):
    p = t.part.select("p_partkey", c("p_retailprice").alias("s"), (c("p_retailprice") * (d(0.8) + (c("p_partkey") % 5) * d(0.1))).alias("k"), ((c("p_partkey") % 60) / d(25)).alias("sigma"))
    priced = N.option_price(p.withColumns({"r": d(0.03), "is_call": c("p_partkey") % 2 == 0}))
    return rounded(priced, ["p_partkey"], **{n: c(n) for n in ("price", "delta", "gamma", "theta", "vega", "rho", "intrinsic", "time_value")})


@query("fin_bs_greeks", f"""WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice * 1.02::DOUBLE ELSE p_retailprice * 0.9::DOUBLE END AS s, p_retailprice AS k, 0.045::DOUBLE AS r, CASE WHEN p_partkey % 4 = 0 THEN 0.20::DOUBLE ELSE (p_partkey % 4) / 10.0::DOUBLE END AS sigma, p_partkey % 2 = 0 AS is_call FROM part), {_bs(0.5, [])}
SELECT p_partkey, {', '.join(f'round({n}, 6) AS {n}' for n in ('delta', 'gamma', 'theta', 'vega', 'rho'))} FROM o""")
def _(t):
    k = c("p_retailprice")
    price = F.when(c("p_partkey") % 3 == 0, d(0)).otherwise(k * d(0.9))
    given = t.part.select("p_partkey", price.alias("s"), k.alias("k"), ((c("p_partkey") % 4) / d(10)).alias("sigma"), (c("p_partkey") % 2 == 0).alias("is_call"))
    return rounded(N.trade_greeks(given), ["p_partkey"], **{n: c(n) for n in ("delta", "gamma", "theta", "vega", "rho")})


def _bond(t):
    k = c("p_partkey")
    isin = F.when(k % 11 == 0, F.lit("BAD")).otherwise(F.format_string("US%09d%d", k, k % 10))
    return t.part.select("p_partkey", isin.alias("isin"), (d(80) + (k % 40)).alias("price"), d(100).alias("face"), (d(1) + (k % 9) / d(2)).alias("coupon"), (k % 35).cast("int").alias("years"))


@query("fin_ytm")
def _(t):
    b = _bond(t).withColumn("n", F.when(c("years") > 0, c("years")).otherwise(10))
    return rounded(b, ["p_partkey"], ytm=N.yield_to_maturity(c("price"), c("face"), c("coupon"), c("n")))


_FLOWS = "SELECT p_partkey, unnest(range(1, 11)) AS t, 80.0::DOUBLE + p_partkey % 40 AS price, (1.0::DOUBLE + (p_partkey % 9) / 2.0::DOUBLE) / 100 AS cpn, 0.01::DOUBLE + (p_partkey % 7) * 0.01::DOUBLE AS y FROM part"


@query("fin_duration", f"WITH f AS ({_FLOWS}), g AS (SELECT p_partkey, sum(t * price * cpn / pow(1 + y, t)) AS w, sum(price * cpn / pow(1 + y, t)) AS p, any_value(price) AS price, any_value(y) AS y FROM f GROUP BY p_partkey) SELECT p_partkey, round((w + 10 * price / pow(1 + y, 10)) / (p + price / pow(1 + y, 10)), 6) AS macaulay, round((w + 10 * price / pow(1 + y, 10)) / (p + price / pow(1 + y, 10)) / (1 + y), 6) AS modified FROM g")
def _(t):
    y = d(0.01) + (c("p_partkey") % 7) * d(0.01)
    m = N.macaulay_duration(c("price"), c("coupon") / d(100), y, 10)
    return rounded(_bond(t), ["p_partkey"], macaulay=m, modified=m / (d(1) + y))


@query("fin_convexity", f"WITH f AS ({_FLOWS}), g AS (SELECT p_partkey, sum(t * (t + 1.0::DOUBLE) * price * cpn / pow(1 + y, t + 2)) AS w, any_value(price) AS price, any_value(y) AS y FROM f GROUP BY p_partkey) SELECT p_partkey, round((w + 110.0::DOUBLE * price / pow(1 + y, 12)) / price, 6) AS convexity FROM g")
def _(t):
    y = d(0.01) + (c("p_partkey") % 7) * d(0.01)
    return rounded(_bond(t), ["p_partkey"], convexity=N.convexity(c("price"), c("coupon") / d(100), y, 10))


@query("fin_bond_metrics")
def _(t):
    b = _bond(t).withColumn("n", F.when(c("years") > 0, c("years")).otherwise(10)).where(c("isin").rlike(N.ISIN) & (c("n") <= 30))
    b = b.withColumn("y", N.yield_to_maturity(c("price"), c("face"), c("coupon"), c("n")))
    rate = c("coupon") / d(100)
    return rounded(b, ["p_partkey", "isin"], clean=c("price"), dirty=c("price") + c("face") * d(N.ACCRUED_RATE), current_yield=rate * c("face") / c("price") * d(100), ytm_pct=c("y") * d(100), duration=N.macaulay_duration(c("price"), rate, c("y"), 10) / (d(1) + c("y")), convexity=N.convexity(c("price"), rate, c("y"), 10), spread_bps=(c("y") - d(N.BENCHMARK_YIELD)) * d(10_000))


@query("fin_dv01", "SELECT p_partkey, round((1.0::DOUBLE + p_size / 10.0::DOUBLE) * p_retailprice * 0.0001::DOUBLE, 6) AS dv01 FROM part")
def _(t):
    return rounded(t.part, ["p_partkey"], dv01=(d(1) + c("p_size") / d(10)) * c("p_retailprice") * d(1e-4))


_H = f"{N.ANNUAL_VOLATILITY / math.sqrt(N.TRADING_DAYS)!r}::DOUBLE * sqrt((1 + o_orderkey % 252)::DOUBLE) * o_totalprice"


@query("fin_var", f"SELECT o_orderkey, round(2.3263::DOUBLE * {_H}, 3) AS var99, round(1.6449::DOUBLE * {_H}, 3) AS var95, round(o_totalprice * 0.2::DOUBLE, 6) AS stress_loss, round(o_totalprice * 0.02::DOUBLE, 6) AS counterparty, 2.3263::DOUBLE * {_H} / o_totalprice * 100 > 6 AS breached FROM orders")
def _(t):
    v, days = c("o_totalprice"), 1 + c("o_orderkey") % 252
    var99 = N.value_at_risk(v, days, N.Z_99)
    return t.orders.select("o_orderkey", F.round(var99, 3).alias("var99"), F.round(N.value_at_risk(v, days, N.Z_95), 3).alias("var95"), F.round(v * d(N.STRESS_SHOCK), 6).alias("stress_loss"), F.round(v * d(0.02), 6).alias("counterparty"), (var99 / v * d(100) > N.VAR_LIMIT_PCT).alias("breached"))


@query("fin_risk_check", "WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 10000 + 0.005::DOUBLE * sqrt(l_quantity / 10000) * l_extendedprice / 1000 AS score, l_extendedprice * 20 AS pos FROM lineitem) SELECT l_orderkey, l_linenumber, round(score, 6) AS score, CASE WHEN score < 50 AND pos < 1000000 THEN 'APPROVED' ELSE 'REJECTED' END AS status, CASE WHEN pos >= 1000000 THEN 'POSITION' WHEN score >= 50 THEN 'SCORE' END AS reason FROM s")
def _(t):
    score, pos = N.risk_score(c("l_extendedprice"), c("l_quantity")), c("l_extendedprice") * 20
    status = F.when((score < 50) & (pos < 1_000_000), "APPROVED").otherwise("REJECTED")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"), status.alias("status"), F.when(pos >= 1_000_000, "POSITION").when(score >= 50, "SCORE").alias("reason"))


@query("fin_stress", "WITH s AS (SELECT o_orderkey, o_totalprice AS v, o_totalprice * (1.0::DOUBLE - (o_orderkey % 10) / 100.0::DOUBLE) AS stressed FROM orders) SELECT o_orderkey, round(v - stressed, 6) AS loss, round((v - stressed) / v * 100, 6) AS loss_pct, CASE WHEN round((v - stressed) / v * 100, 6) < 5 THEN 'WITHIN_LIMIT' ELSE 'LIMIT_BREACHED' END AS status FROM s")
def _(t):
    v = c("o_totalprice")
    loss = v - v * (d(1) - (c("o_orderkey") % 10) / d(100))
    pct = F.round(loss / v * d(100), 6)
    return t.orders.select("o_orderkey", F.round(loss, 6).alias("loss"), pct.alias("loss_pct"), F.when(pct < 5, "WITHIN_LIMIT").otherwise("LIMIT_BREACHED").alias("status"))


@query("fin_limit_breach", "SELECT l_orderkey, l_linenumber, l_quantity - 40 AS breach FROM lineitem WHERE l_quantity > 40")
def _(t):
    return t.lineitem.where("l_quantity > 40").select("l_orderkey", "l_linenumber", (c("l_quantity") - 40).alias("breach"))


_ORDER = "SELECT o_orderkey, o_totalprice * 2 AS notional, o_orderkey % 7000 AS qty, CASE WHEN o_orderkey % 3 = 0 THEN 'MARKET' ELSE 'LIMIT' END AS kind, CASE WHEN o_orderkey % 11 = 0 THEN 'TWAP' ELSE '' END AS algo FROM orders"


def _orders(t):
    k = c("o_orderkey")
    return t.orders.select("o_orderkey", (c("o_totalprice") * 2).alias("notional"), (k % 7000).alias("qty"), F.when(k % 3 == 0, "MARKET").otherwise("LIMIT").alias("kind"), F.when(k % 11 == 0, "TWAP").otherwise("").alias("algo"))


@query("fin_route", f"WITH s AS ({_ORDER}) SELECT o_orderkey, CASE WHEN notional >= 500000 THEN 'DARK_POOL' WHEN qty >= 5000 OR algo <> '' THEN 'ALGO_ENGINE:' || coalesce(nullif(algo, ''), 'VWAP') WHEN kind = 'MARKET' THEN 'DMA' ELSE 'SMART_ORDER_ROUTER' END AS route FROM s")
def _(t):
    return _orders(t).select("o_orderkey", N.route(c("notional"), c("qty"), c("kind"), c("algo")).alias("route"))


@query("fin_slippage", f"WITH s AS ({_ORDER}) SELECT o_orderkey, round(0.0002::DOUBLE * sqrt(qty / 50000.0::DOUBLE), 8) AS slippage, round(notional * (1 + 0.0002::DOUBLE * sqrt(qty / 50000.0::DOUBLE)), 4) AS fill FROM s")
def _(t):
    s = N.slippage(c("qty"))
    return _orders(t).select("o_orderkey", F.round(s, 8).alias("slippage"), F.round(c("notional") * (d(1) + s), 4).alias("fill"))


@query("fin_ioc", f"WITH s AS ({_ORDER}) SELECT o_orderkey, CASE WHEN qty > 5000 THEN trunc(qty * 0.75::DOUBLE)::BIGINT ELSE qty END AS filled, CASE WHEN qty > 5000 THEN 'CANCELLED' ELSE 'EXECUTED' END AS status FROM s")
def _(t):
    big = c("qty") > 5000
    return _orders(t).select("o_orderkey", F.when(big, (c("qty") * d(0.75)).cast("long")).otherwise(c("qty")).alias("filled"), F.when(big, "CANCELLED").otherwise("EXECUTED").alias("status"))


_RATES = {"UNITED STATES": 1.0, "GERMANY": 1.08, "FRANCE": 1.08, "UNITED KINGDOM": 1.27, "JAPAN": 0.0067}
_RATE_SQL = "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _RATES.items()) + ") r(n_name, rate)"


def _rates(t):
    return t.spark.createDataFrame(list(_RATES.items()), "n_name string, rate double")


@query("jn_fx_rate", f"SELECT s_suppkey, r.rate, CASE WHEN r.rate IS NULL THEN 'REJECTED' ELSE 'EXECUTED' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN {_RATE_SQL} USING (n_name)")
def _(t):
    return t.supplier.join(t.nation, c("s_nationkey") == c("n_nationkey")).join(_rates(t), "n_name", "left").select("s_suppkey", "rate", F.when(c("rate").isNull(), "REJECTED").otherwise("EXECUTED").alias("status"))


@query("fin_fx", "WITH s AS (SELECT c_custkey, 1 + c_custkey % 100 / 100.0::DOUBLE AS r, c_acctbal AS q, (c_custkey * 37) % 7200 AS age FROM customer) SELECT c_custkey, round(q * r, 4) AS notional, round(r * 0.99995::DOUBLE, 8) AS bid, round(r * 1.00005::DOUBLE, 8) AS ask, round((r * 1.00005::DOUBLE - r * 0.99995::DOUBLE) / r * 10000, 4) AS spread_bps, round(q * r * ((r * 1.00005::DOUBLE - r * 0.99995::DOUBLE) / r * 10000 / 10000), 4) AS fee, age > 3600 AS stale FROM s")
def _(t):
    r, q = d(1) + c("c_custkey") % 100 / d(100), c("c_acctbal")
    bps = (r * d(1.00005) - r * d(0.99995)) / r * d(10_000)
    return t.customer.select("c_custkey", F.round(q * r, 4).alias("notional"), F.round(r * d(0.99995), 8).alias("bid"), F.round(r * d(1.00005), 8).alias("ask"), F.round(bps, 4).alias("spread_bps"), F.round(q * r * (bps / d(10_000)), 4).alias("fee"), ((c("c_custkey") * 37) % 7200 > 3600).alias("stale"))


_SETTLE = "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'XX1' ELSE printf('US%09d%d', o_orderkey, o_orderkey % 10) END AS isin, o_totalprice * 1.5::DOUBLE AS amount, ['USD', 'CAD', 'AUD'][1 + o_orderkey % 3] AS ccy, o_orderdate::DATE AS day FROM orders"


def _settlements(t):
    k = c("o_orderkey")
    isin = F.when(k % 13 == 0, "XX1").otherwise(F.format_string("US%09d%d", k, k % 10))
    ccy = F.get(F.array(F.lit("USD"), F.lit("CAD"), F.lit("AUD")), (k % 3).cast("int"))
    return t.orders.select("o_orderkey", isin.alias("isin"), (c("o_totalprice") * d(1.5)).alias("amount"), ccy.alias("ccy"), F.to_date("o_orderdate").alias("day"))


@query("fin_settle_check", f"WITH s AS ({_SETTLE}), n AS (SELECT *, amount * 1.0001::DOUBLE AS need, regexp_full_match(isin, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') AS ok FROM s) SELECT o_orderkey, CASE WHEN ok AND need <= 500000 THEN 'SETTLED' ELSE 'FAILED' END AS status, CASE WHEN NOT ok THEN 'Invalid ISIN' WHEN need > 500000 THEN 'Insufficient funds' END AS reason, CASE WHEN ok AND need > 500000 THEN round(need - 500000, 4) END AS shortfall, CASE WHEN ok AND need > 500000 THEN round(need / (500000 + need) * 100, 4) END AS utilisation, CASE WHEN ok AND need <= 500000 THEN round(amount * 0.0001::DOUBLE, 4) END AS fee FROM n")
def _(t):
    s = N.settlement_state(c("isin"), c("amount"))
    return _settlements(t).select("o_orderkey", s["status"].alias("status"), s["reason"].alias("reason"), *[F.round(s[n], 4).alias(n) for n in ("shortfall", "utilisation", "fee")])


@query("flt_settlement_valid", f"WITH s AS ({_SETTLE}) SELECT o_orderkey FROM s WHERE regexp_full_match(isin, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') AND amount > 0")
def _(t):
    return _settlements(t).where(c("isin").rlike(N.ISIN) & (c("amount") > 0)).select("o_orderkey")


@query("agg_settle_batch", f"WITH s AS ({_SETTLE}), n AS (SELECT *, regexp_full_match(isin, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') AS ok FROM s) SELECT day, count(*) AS n, round(sum(amount), 4) AS total, count(*) FILTER (ok) AS n_valid, count(*) FILTER (NOT ok) AS n_invalid, round(count(*) FILTER (NOT ok) * 100.0::DOUBLE / nullif(count(*), 0), 4) AS rejection_pct, round(sum(amount) FILTER (ok AND ccy = 'USD'), 4) AS usd, round(sum(amount * 0.71::DOUBLE) FILTER (ok AND ccy = 'CAD'), 6) AS cad, round(sum(amount * 0.59::DOUBLE) FILTER (ok AND ccy = 'AUD'), 6) AS aud, round(sum(amount) FILTER (ok) * 0.0001::DOUBLE, 8) AS fee, NULL::BIGINT AS rejected FROM n GROUP BY day UNION ALL SELECT day, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, o_orderkey FROM n WHERE NOT ok")
def _(t):
    s = _settlements(t).withColumn("ok", c("isin").rlike(N.ISIN))
    cash = lambda name, rate: F.round(F.sum(F.when(c("ok") & (c("ccy") == name), c("amount") * d(rate))), 4 if rate == 1 else 6)
    totals = s.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 4).alias("total"), F.count_if("ok").alias("n_valid"), F.count_if(~c("ok")).alias("n_invalid"), F.round(F.count_if(~c("ok")) * d(100) / F.count(F.lit(1)), 4).alias("rejection_pct"), cash("USD", 1.0).alias("usd"), cash("CAD", 0.71).alias("cad"), cash("AUD", 0.59).alias("aud"), F.round(F.sum(F.when(c("ok"), c("amount"))) * d(N.FEE_RATE), 8).alias("fee"))
    # The ids that were rejected are rows of their own: a day may have any number of them.
    return totals.withColumn("rejected", F.lit(None).cast("long")).unionByName(s.where(~c("ok")).select("day", c("o_orderkey").alias("rejected")), allowMissingColumns=True)


@query("fin_journal_balance", "SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_extendedprice * (1 - l_discount), 4) AS imbalance, l_extendedprice = l_extendedprice * (1 - l_discount) AS balanced FROM lineitem")
def _(t):
    credit = c("l_extendedprice") * (1 - c("l_discount"))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(c("l_extendedprice") - credit, 4).alias("imbalance"), (c("l_extendedprice") == credit).alias("balanced"))


@query("fin_eod_check", "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS n, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM lineitem GROUP BY l_suppkey")
def _(t):
    n = F.count_if(c("l_returnflag") == "R")
    return t.lineitem.groupBy("l_suppkey").agg(n.alias("n"), F.when(n > 0, "FAILED").otherwise("PASSED").alias("status"))


@query("fin_quote", "WITH q AS (SELECT p_partkey, p_retailprice AS last, p_retailprice * 0.999::DOUBLE AS bid, p_retailprice * 1.001::DOUBLE AS ask, p_retailprice * 0.98::DOUBLE AS prev FROM part) SELECT p_partkey, round((ask - bid) / last * 10000, 4) AS spread_bps, round((ask - bid) / ((bid + ask) / 2) * 10000, 4) AS mid_bps, round((last - prev) / prev * 100, 4) AS change_pct, round((ask - bid) / prev * 100, 4) AS range_pct, round(100.0::DOUBLE / pow(1 + 0.04::DOUBLE / 2, 20), 4) AS discount_price, round(1000000 * ((ask - bid) / ((bid + ask) / 2) * 10000 / 10000), 2) AS implied_cost, round(last - (last - prev), 4) AS open, round((last - (last - (last - prev))) / (last - (last - prev)) * 100, 4) AS daily_return_pct, round(10500000 * (last / 1000), 2) AS converted_usd FROM q")
def _(t):
    last = c("p_retailprice")
    bid, ask, prev = last * d(0.999), last * d(1.001), last * d(0.98)
    mid = (ask - bid) / ((bid + ask) / 2) * d(10_000)
    return t.part.select("p_partkey", F.round((ask - bid) / last * d(10_000), 4).alias("spread_bps"), F.round(mid, 4).alias("mid_bps"), F.round((last - prev) / prev * d(100), 4).alias("change_pct"), F.round((ask - bid) / prev * d(100), 4).alias("range_pct"), F.round(d(100) / F.pow(d(1.02), d(20)), 4).alias("discount_price"), F.round(d(1_000_000) * (mid / d(10_000)), 2).alias("implied_cost"), F.round(N.open_price(last, last - prev), 4).alias("open"), F.round(N.daily_return(last, last - prev) * d(100), 4).alias("daily_return_pct"), F.round(d(10_500_000) * (last / d(1000)), 2).alias("converted_usd"))


@query("fin_cache_ttl", "SELECT event_id, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(ts) > 30 AS refetch FROM events")
def _(t):
    return t.events.select("event_id", (F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(c("ts").cast("timestamp")) > 30_000_000).alias("refetch"))


@query("fin_carry", "SELECT l_orderkey, l_linenumber, round(l_quantity * (l_extendedprice / l_quantity) * l_tax, 4) AS carry FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(c("l_quantity") * (c("l_extendedprice") / c("l_quantity")) * c("l_tax"), 4).alias("carry"))


@query("fin_basis", f"SELECT l_orderkey, {_half_up('abs(max(l_extendedprice / l_quantity) FILTER (l_linenumber = 1) - max(l_extendedprice / l_quantity) FILTER (l_linenumber = 2))')} AS basis FROM lineitem GROUP BY l_orderkey")
def _(t):
    leg = lambda n: F.max(F.when(c("l_linenumber") == n, c("l_extendedprice") / c("l_quantity")))
    return t.lineitem.groupBy("l_orderkey").agg(half_up(F.abs(leg(1) - leg(2))).alias("basis"))


@query("fin_activate", "SELECT user_id, count(*) AS bars, CASE WHEN count(*) BETWEEN 1 AND 251 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("bars"), F.when(F.count(F.lit(1)).between(1, 251), "INACTIVE").otherwise("ACTIVE").alias("status"))


@query("fin_seq_id", "SELECT c_custkey, printf('ORD-2024-%05d', row_number() OVER (ORDER BY c_custkey)) AS id FROM customer")
def _(t):
    # Numbers without one task for all rows: places within ranges, then the ranges' sizes before.
    ranged = keep(t.customer.select("c_custkey").repartitionByRange("c_custkey").withColumn("part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("part").count()
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = ranged.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("c_custkey")))
    return placed.join(before, "part").select("c_custkey", F.format_string("ORD-2024-%05d", c("n") + c("before")).alias("id"))


@query("flt_order_valid", "SELECT o_orderkey, CASE WHEN trim(s) = '' THEN 'symbol' WHEN price < 0 THEN 'price' END AS reason FROM (SELECT *, o_totalprice - 5000 AS price, CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE o_orderpriority END AS s FROM orders)")
def _(t):
    symbol = F.when(c("o_orderkey") % 17 == 0, " ").otherwise(c("o_orderpriority"))
    return t.orders.select("o_orderkey", F.when(F.trim(symbol) == "", "symbol").when(c("o_totalprice") - 5000 < 0, "price").alias("reason"))


@query("flt_by_trade_id", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7")
def _(t):
    return t.lineitem.where("l_orderkey = 7").select("l_orderkey", "l_linenumber", "l_quantity")


_CODE = "SELECT c_custkey, unnest(['US' || printf('%010d', c_custkey), printf('%07d', c_custkey), printf('%09d', c_custkey), printf('%020d', c_custkey), 'DEUTDEFF', 'BBG' || printf('%09d', c_custkey), 'EURUSD', 'eurusd', c_name]) AS code FROM customer"


@query("flt_codes", f"WITH s AS ({_CODE}) SELECT c_custkey, code, " + ", ".join(f"regexp_matches(code, '{p}') AS is_{k}" for k, p in N.CODES.items()) + " FROM s")
def _(t):
    k = c("c_custkey")
    codes = [F.format_string("US%010d", k), F.format_string("%07d", k), F.format_string("%09d", k), F.format_string("%020d", k), F.lit("DEUTDEFF"), F.format_string("BBG%09d", k), F.lit("EURUSD"), F.lit("eurusd"), c("c_name")]
    return t.customer.select("c_custkey", F.explode(F.array(*codes)).alias("code")).select("c_custkey", "code", *[c("code").rlike(p).alias(f"is_{n}") for n, p in N.CODES.items()])


@query("agg_sector", "WITH s AS (SELECT c_mktsegment AS sector, sum(c_acctbal) AS amount FROM customer GROUP BY 1) SELECT sector, round(amount, 2) AS amount, round(amount / sum(amount) OVER () * 100, 4) AS pct, amount / sum(amount) OVER () * 100 > 40 AS breach FROM s")
def _(t):
    by = t.customer.groupBy(c("c_mktsegment").alias("sector")).agg(F.sum("c_acctbal").alias("amount"))
    pct = c("amount") / c("total") * d(100)
    return by.crossJoin(t.customer.agg(F.sum("c_acctbal").alias("total"))).select("sector", F.round("amount", 2).alias("amount"), F.round(pct, 4).alias("pct"), (pct > 40).alias("breach"))


@query("agg_portfolio_pnl", "SELECT l_suppkey, round(sum(l_quantity * (p_retailprice - l_extendedprice / l_quantity)), 2) AS pnl, round(sum(l_quantity * (p_retailprice - l_extendedprice / l_quantity)) * 0.01::DOUBLE, 4) AS var FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey")
def _(t):
    gain = F.sum(c("l_quantity") * (c("p_retailprice") - c("l_extendedprice") / c("l_quantity")))
    return t.lineitem.join(t.part, c("l_partkey") == c("p_partkey")).groupBy("l_suppkey").agg(F.round(gain, 2).alias("pnl"), F.round(gain * d(0.01), 4).alias("var"))


_RETURNS = "r AS (SELECT user_id, event_id, ts, value / 1000.0::DOUBLE - 0.05::DOUBLE AS r FROM events)"


def _returns(t):
    return t.events.select("user_id", "event_id", "ts", (c("value") / d(1000) - d(0.05)).alias("r"))


@query("agg_backtest", f"WITH {_RETURNS} SELECT user_id, count(*) AS n, round((exp(sum(ln(1 + r))) - 1) * 100, 6) AS total_return, round((avg(r) - 0.045::DOUBLE / 252) / nullif(stddev_pop(r), 0) * sqrt(252), 5) AS sharpe, round(count(*) FILTER (r > 0) / count(*)::DOUBLE, 6) AS win_rate, round(coalesce(avg(r) FILTER (r > 0), 0) * 100, 6) AS avg_win, round(coalesce(avg(abs(r)) FILTER (r <= 0), 0) * 100, 6) AS avg_loss, round(sum(r) FILTER (r > 0) / nullif(sum(abs(r)) FILTER (r <= 0), 0), 6) AS profit_factor FROM r GROUP BY user_id")
def _(t):
    r, win = c("r"), c("r") > 0
    return _returns(t).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round((F.exp(F.sum(F.log(d(1) + r))) - 1) * d(100), 6).alias("total_return"),
        F.round((F.avg(r) - d(N.RISK_FREE / 252)) / F.nullif(F.stddev_pop(r), d(0)) * d(math.sqrt(252)), 5).alias("sharpe"),
        F.round(F.count_if(win) / F.count(F.lit(1)), 6).alias("win_rate"),
        F.round(F.coalesce(F.avg(F.when(win, r)), d(0)) * d(100), 6).alias("avg_win"),
        F.round(F.coalesce(F.avg(F.when(~win, F.abs(r))), d(0)) * d(100), 6).alias("avg_loss"),
        F.round(F.sum(F.when(win, r)) / F.nullif(F.sum(F.when(~win, F.abs(r))), d(0)), 6).alias("profit_factor"),
    )


@query("win_max_drawdown", f"WITH {_RETURNS}, c AS (SELECT user_id, event_id, ts, exp(sum(ln(1 + r)) OVER w) AS cum FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), p AS (SELECT *, greatest(1.0::DOUBLE, max(cum) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS peak FROM c) SELECT user_id, round(greatest(0, max((peak - cum) / peak)), 6) AS drawdown FROM p GROUP BY user_id")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cum = _returns(t).withColumn("cum", F.exp(F.sum(F.log(d(1) + c("r"))).over(w)))
    return cum.withColumn("peak", F.greatest(d(1), F.max("cum").over(w))).groupBy("user_id").agg(F.round(F.greatest(d(0), F.max((c("peak") - c("cum")) / c("peak"))), 6).alias("drawdown"))


@query("agg_vwap", "SELECT l_partkey, round(sum(l_extendedprice) / sum(l_quantity), 6) AS vwap FROM lineitem GROUP BY l_partkey")
def _(t):
    return t.lineitem.groupBy("l_partkey").agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("vwap"))


@query("win_cum_vwap", f"SELECT l_orderkey, l_linenumber, l_partkey, {_half_up('round(sum(l_extendedprice) OVER w, 4) / sum(l_quantity) OVER w')} AS vwap FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING)")
def _(t):
    w = Window.partitionBy("l_partkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", half_up(F.round(F.sum("l_extendedprice").over(w), 4) / F.sum("l_quantity").over(w)).alias("vwap"))


@query("agg_nav", "SELECT c_nationkey, round(sum(c_acctbal) FILTER (c_acctbal > 0) - coalesce(-sum(c_acctbal) FILTER (c_acctbal < 0), 0), 4) AS nav, round((sum(c_acctbal) FILTER (c_acctbal > 0) - coalesce(-sum(c_acctbal) FILTER (c_acctbal < 0), 0)) / count(*), 4) AS per_share FROM customer GROUP BY c_nationkey")
def _(t):
    nav = F.sum(F.when(c("c_acctbal") > 0, c("c_acctbal"))) - F.coalesce(-F.sum(F.when(c("c_acctbal") < 0, c("c_acctbal"))), d(0))
    return t.customer.groupBy("c_nationkey").agg(F.round(nav, 4).alias("nav"), F.round(nav / F.count(F.lit(1)), 4).alias("per_share"))


@query("agg_pnl", "SELECT l_returnflag, round(sum(l_extendedprice * l_discount) - sum(l_extendedprice * 0.0001::DOUBLE), 2) AS net FROM lineitem GROUP BY l_returnflag")
def _(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(c("l_extendedprice") * c("l_discount")) - F.sum(c("l_extendedprice") * d(0.0001)), 2).alias("net"))


@query("win_first_dup", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) > 1 AS rejected FROM orders")
def _(t):
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.orders.select("o_orderkey", "o_custkey", (n > 1).alias("rejected"))


@query("win_fault_parity", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) % 2 = 1 AS fault FROM events")
def _(t):
    n = F.row_number().over(Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", "event_type", (n % 2 == 1).alias("fault"))


@query("fin_equity_fill", f"SELECT l_orderkey, l_linenumber, l_quantity AS filled, {_half_up('l_extendedprice / l_quantity')} AS average, 'EXECUTED' AS status FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", c("l_quantity").alias("filled"), half_up(c("l_extendedprice") / c("l_quantity")).alias("average"), F.lit("EXECUTED").alias("status"))
