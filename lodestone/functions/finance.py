"""Pricing, risk, routing and settlement measures as columns. All arithmetic is in doubles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISIN = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"
# Format of each kind of code.
CODES = {"isin": ISIN, "sedol": "^[A-Z0-9]{7}$", "cusip": "^[A-Z0-9]{9}$", "lei": "^[A-Z0-9]{20}$", "swift": "^[A-Z0-9]{8}([A-Z0-9]{3})?$", "figi": "^BBG[A-Z0-9]{9}$", "pair": "^[A-Z]{6}$"}
# Parameters of the measures.
Z_99, Z_95, ANNUAL_VOLATILITY, TRADING_DAYS, VAR_LIMIT_PCT, STRESS_SHOCK = 2.3263, 1.6449, 0.15, 252, 6.0, 0.20
AVAILABLE_CASH, FEE_RATE, BENCHMARK_YIELD, ACCRUED_RATE, RISK_FREE = 500000.0, 0.0001, 0.0425, 0.005, 0.045
MOST_YTM_STEPS, YTM_CLOSE = 100, 1e-8


def d(x: float) -> Column:
    return F.lit(float(x))


def normal_pdf(x: Column) -> Column:
    return F.exp(d(-0.5) * x * x) / d(math.sqrt(2 * math.pi))


def normal_cdf(x: Column) -> Column:
    """Five-term polynomial approximation."""
    t = d(1) / (d(1) + d(0.2316419) * F.abs(x))
    poly = d(1.330274429)
    for c in (-1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = d(c) + t * poly
    tail = normal_pdf(x) * t * poly
    return F.when(x >= 0, d(1) - tail).otherwise(tail)


def with_greeks(rows: DataFrame, years: float) -> DataFrame:
    """``rows`` (s, k, r, sigma, is_call and others) with the Black-Scholes price and sensitivities.

    Theta of a put uses the call's formula, as does its intrinsic value. What several results
    share is a column of a step of its own, so that it is worked out once and the generated
    code stays small. Without a spot or a volatility all results are null.
    """
    c = F.col
    steps = rows.withColumns({"root": c("sigma") * d(math.sqrt(years)), "paid": c("k") * F.exp(-c("r") * d(years))})
    steps = steps.withColumn("d1", (F.log(c("s") / c("k")) + (c("r") + d(0.5) * c("sigma") * c("sigma")) * d(years)) / c("root"))
    steps = steps.withColumns({"n1": normal_cdf(c("d1")), "n2": normal_cdf(c("d1") - c("root")), "p1": normal_pdf(c("d1"))})
    steps = steps.withColumns({"m1": normal_cdf(-c("d1")), "m2": normal_cdf(-(c("d1") - c("root")))})
    by_kind = lambda call, put: F.when(c("is_call"), call).otherwise(put)
    out = steps.withColumns({
        "price": by_kind(c("s") * c("n1") - c("paid") * c("n2"), c("paid") * c("m2") - c("s") * c("m1")),
        "delta": by_kind(c("n1"), c("n1") - 1),
        "gamma": c("p1") / (c("s") * c("root")),
        "theta": (-c("s") * c("p1") * c("sigma") / d(2 * math.sqrt(years)) - c("r") * c("paid") * c("n2")) / d(365),
        "vega": c("s") * c("p1") * d(math.sqrt(years)) / d(100),
        "rho": by_kind(c("paid") * d(years) * c("n2") / d(100), -c("paid") * d(years) * c("m2") / d(100)),
        "intrinsic": F.when(c("s").isNotNull() & c("sigma").isNotNull(), F.greatest(d(0), c("s") - c("k"))),
    })
    return out.withColumn("time_value", c("price") - c("intrinsic")).drop("root", "paid", "d1", "n1", "n2", "m1", "m2", "p1")


def option_price(rows: DataFrame) -> DataFrame:
    """One year's greeks; null without a price or with a volatility outside 0.01 to 2."""
    ok = (F.col("s") > 0) & F.col("sigma").between(0.01, 2.0)
    return with_greeks(rows.withColumn("sigma", F.when(ok, F.col("sigma"))), 1.0)


def trade_greeks(rows: DataFrame) -> DataFrame:
    """Half a year's greeks at the fixed rate, with a spot of 1.02 strikes and a volatility of 0.2 where none is given."""
    spot = F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("k") * d(1.02))
    given = rows.withColumns({"s": spot, "sigma": F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(d(0.20)), "r": d(RISK_FREE)})
    return with_greeks(given, 0.5).drop("price", "intrinsic", "time_value")


def yield_to_maturity(price: Column, face: Column, coupon_pct: Column, periods: Column) -> Column:
    """Newton's method from the current yield; a state that has come close stays as it is."""
    coupon = face * coupon_pct / d(100)
    start = F.struct((coupon / price).alias("y"), F.lit(False).alias("done"))

    def step(s: Column, _: Column) -> Column:
        q = d(1) / (d(1) + s["y"])
        zero = F.struct(d(1).alias("disc"), d(0).alias("f"), d(0).alias("g"))
        add = lambda a, t: F.struct((a["disc"] * q).alias("disc"), (a["f"] + coupon * a["disc"] * q).alias("f"), (a["g"] - t * coupon * a["disc"] * q * q).alias("g"))
        move = F.aggregate(F.sequence(F.lit(1), periods), zero, add, lambda a: (a["f"] + face * a["disc"] - price) / (a["g"] - periods * face * a["disc"] * q))
        return F.when(s["done"], s).otherwise(F.get(F.transform(F.array(move), lambda m: F.struct((s["y"] - m).alias("y"), (F.abs(m) < YTM_CLOSE).alias("done"))), F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(MOST_YTM_STEPS)), start, step, lambda s: s["y"])


def macaulay_duration(price: Column, coupon: Column, y: Column, periods: int) -> Column:
    """Over flows that pay the price back."""
    q = d(1) / (d(1) + y)
    pv = [(t, price * coupon * F.pow(q, d(t))) for t in range(1, periods + 1)] + [(periods, price * F.pow(q, d(periods)))]
    return sum((d(t) * x for t, x in pv), d(0)) / sum((x for _, x in pv), d(0))


def convexity(price: Column, coupon: Column, y: Column, periods: int) -> Column:
    q = d(1) / (d(1) + y)
    flows = sum((d(t * (t + 1.0)) * price * coupon * F.pow(q, d(t + 2)) for t in range(1, periods + 1)), d(0))
    return (flows + d(periods * (periods + 1.0)) * price * F.pow(q, d(periods + 2))) / price


def value_at_risk(value: Column, days: Column, z: float) -> Column:
    return d(z) * d(ANNUAL_VOLATILITY / math.sqrt(TRADING_DAYS)) * F.sqrt(days.cast("double")) * value


def risk_score(value: Column, quantity: Column) -> Column:
    return value / d(10_000) + d(0.005) * F.sqrt(quantity / d(10_000)) * value / d(1_000)


def route(notional: Column, quantity: Column, kind: Column, algo: Column) -> Column:
    return (
        F.when(notional >= 500_000, "DARK_POOL")
        .when((quantity >= 5_000) | (F.coalesce(algo, F.lit("")) != ""), F.concat(F.lit("ALGO_ENGINE:"), F.coalesce(F.nullif(algo, F.lit("")), F.lit("VWAP"))))
        .when(kind == "MARKET", "DMA")
        .otherwise("SMART_ORDER_ROUTER")
    )


def slippage(quantity: Column) -> Column:
    return d(0.0002) * F.sqrt(quantity / d(50_000))


def settlement_state(isin: Column, amount: Column) -> dict[str, Column]:
    """Status, reason, shortfall and use of the cash buffer of a settlement."""
    need = amount * d(1 + FEE_RATE)
    valid = F.coalesce(isin.rlike(ISIN), F.lit(False))
    short = valid & (need > AVAILABLE_CASH)
    return {
        "status": F.when(valid & ~short, "SETTLED").otherwise("FAILED"),
        "reason": F.when(~valid, "Invalid ISIN").when(short, "Insufficient funds"),
        "shortfall": F.when(short, need - d(AVAILABLE_CASH)),
        "utilisation": F.when(short, need / (d(AVAILABLE_CASH) + need) * d(100)),
        "fee": F.when(valid & ~short, amount * d(FEE_RATE)),
    }


def open_price(close: Column, change: Column) -> Column:
    return close - change


def daily_return(close: Column, change: Column) -> Column:
    """The close against the price that the day's change gives for its beginning."""
    start = open_price(close, change)
    return (close - start) / start
