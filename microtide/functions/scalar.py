"""Scalar functions of the market vocabulary: Column expressions, evaluated in the JVM but for implied volatilities."""

from __future__ import annotations

import math
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IST_OFFSET = 19_800
#: Session bounds in seconds of the Indian day, both ends included. Fixed values.
EQUITY_SESSION = (33_300, 55_800)
CURRENCY_SESSION = (32_400, 61_200)
CURRENCIES = ("USDINR", "EURINR", "GBPINR", "JPYINR")
MONTHS = "JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC"


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def clamp(x: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least skip nulls)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def finite(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(x)


def safe_div(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def weighted_mid(bid: Column, ask: Column, bid_qty: Column, ask_qty: Column, eps: float | None = None) -> Column:
    """Quantity-weighted mid; with ``eps`` an empty book gives 0 instead of null."""
    total = bid_qty + ask_qty
    return (bid * ask_qty + ask * bid_qty) / (F.nullif(total, F.lit(0)) if eps is None else total + eps)


def spread_bps(bid: Column, ask: Column) -> Column:
    return safe_div((ask - bid) * 10_000, (ask + bid) / 2)


def ist_second(ts_sec: Column) -> Column:
    return F.pmod(ts_sec + IST_OFFSET, F.lit(86_400))


def hhmm(ts_sec: Column) -> Column:
    s = ist_second(ts_sec)
    return F.concat_ws(":", F.lpad(F.floor(s / 3600).cast("string"), 2, "0"), F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"))


def in_session(ts_sec: Column, symbol: Column, last_inclusive: bool = True) -> Column:
    currency = F.lit(False)
    for name in CURRENCIES:
        currency = currency | symbol.contains(name)
    cut = 0 if last_inclusive else 1
    s = ist_second(ts_sec)
    return F.when(currency, s.between(CURRENCY_SESSION[0], CURRENCY_SESSION[1] - cut)).otherwise(s.between(EQUITY_SESSION[0], EQUITY_SESSION[1] - cut))


def session_label(ts_sec: Column) -> Column:
    s = ist_second(ts_sec)
    return F.when(s < 35_100, "open").when(s < 52_200, "midday").otherwise("close")


def base_symbol(symbol: Column) -> Column:
    return F.regexp_replace(symbol, rf"(?i)[0-9]{{2}}({MONTHS})FUT$", "")


def instrument_class(symbol: Column) -> Column:
    return F.when(symbol.endswith("CE") | symbol.endswith("PE"), "option").when(symbol.contains("INR"), "currency").when(symbol.endswith("FUT"), "future").otherwise("equity")


def option_parts(symbol: Column) -> Column:
    """Struct of underlying, yy, mon, strike, opt_type; null if the symbol isn't an option's."""
    pattern = rf"^([A-Z&-]+?)([0-9]{{2}})({MONTHS})([0-9]+(?:\.[0-9]+)?)(CE|PE)$"
    part = lambda i: F.regexp_extract(symbol, pattern, i)
    return F.when(symbol.rlike(pattern), F.struct(part(1).alias("underlying"), part(2).cast("int").alias("yy"), part(3).alias("mon"), part(4).cast("double").alias("strike"), part(5).alias("opt_type")))


def last_business_day(d: Column) -> Column:
    """The last Monday-to-Friday day of the month."""
    end = F.last_day(d)
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def last_weekday(d: Column, weekday: int = 3) -> Column:
    """The month's last day of a weekday, Monday being 0."""
    end = F.last_day(d)
    return F.date_sub(end, F.pmod(F.weekday(end) - weekday, F.lit(7)))


def contract_code(expiry: Column) -> Column:
    return F.upper(F.concat(F.date_format(expiry, "yy"), F.date_format(expiry, "MMM"), F.lit("FUT")))


def years_to_expiry(today: Column, expiry: Column) -> Column:
    return F.greatest(F.datediff(expiry, today) / 365.0, F.lit(1 / 365.0))


def trading_days(first: Column, last: Column, holidays: list[date] | None = None) -> Column:
    days = F.filter(F.sequence(first, last), lambda d: F.weekday(d) < 5)
    return F.array_except(days, F.array(*[F.lit(h) for h in holidays])) if holidays else days


#: Rates by instrument kind: sale tax, exchange fee, regulator fee, stamp duty on purchases, brokerage per order. Fixed values.
COSTS = {
    "equity_futures": (0.0005, 0.0000173, 0.000001, 0.00002, 20.0),
    "currency_futures": (0.0, 0.000009, 0.000001, 0.00001, 20.0),
    "equity_options": (0.0005, 0.0000353, 0.000001, 0.00003, 20.0),
    "currency_options": (0.0, 0.000009, 0.000001, 0.00001, 20.0),
}
#: Service tax on brokerage and fees. Fixed value.
SERVICE_TAX = 0.18


def transaction_cost(kind: Column, side: Column, value: Column) -> Column:
    """Cost of one order: flat brokerage, exchange and regulator fees with service tax, tax on sales, stamp on purchases."""
    out = None
    for name, (sale, exchange, regulator, stamp, brokerage) in COSTS.items():
        fees = brokerage + value * exchange + value * regulator
        cost = fees * (1 + SERVICE_TAX) + F.when(F.upper(side) == "SELL", value * sale).otherwise(0.0) + F.when(F.upper(side) == "BUY", value * stamp).otherwise(0.0)
        out = F.when(kind == name, cost) if out is None else out.when(kind == name, cost)
    return out


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def norm_cdf(x: Column) -> Column:
    """Rational approximation of the normal distribution function, within 1e-7 (Zelen and Severo)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    tail = norm_pdf(x) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def _d1(s: Column, k: Column, t: Column, r: float, v: Column) -> Column:
    return (F.log(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))


def bs_price(call: Column, s: Column, k: Column, t: Column, r: float, v: Column) -> Column:
    d1 = _d1(s, k, t, r, v)
    d2 = d1 - v * F.sqrt(t)
    sign = F.when(call, 1.0).otherwise(-1.0)
    return sign * (s * norm_cdf(sign * d1) - k * F.exp(-r * t) * norm_cdf(sign * d2))


def bs_greeks(call: Column, s: Column, k: Column, t: Column, r: float, v: Column) -> dict[str, Column]:
    """delta, gamma, vega per point of volatility, theta per day."""
    d1 = _d1(s, k, t, r, v)
    d2 = d1 - v * F.sqrt(t)
    sign = F.when(call, 1.0).otherwise(-1.0)
    decay = -s * norm_pdf(d1) * v / (2 * F.sqrt(t)) - sign * r * k * F.exp(-r * t) * norm_cdf(sign * d2)
    return {
        "delta": sign * norm_cdf(sign * d1),
        "gamma": norm_pdf(d1) / (s * v * F.sqrt(t)),
        "vega": s * norm_pdf(d1) * F.sqrt(t) / 100,
        "theta": decay / 365,
    }


def price_and_vega(sign: np.ndarray, s: np.ndarray, k: np.ndarray, t: np.ndarray, r: float, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``bs_price`` and its derivative in volatility of many options at once; ``sign`` is 1 for a call, -1 for a put."""
    pdf = lambda x: np.exp(-x * x / 2) / math.sqrt(2 * math.pi)

    def cdf(x: np.ndarray) -> np.ndarray:
        u = 1 / (1 + 0.2316419 * np.abs(x))
        tail = pdf(x) * u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429))))
        return np.where(x >= 0, 1 - tail, tail)

    d1 = (np.log(s / k) + (r + v * v / 2) * t) / (v * np.sqrt(t))
    d2 = d1 - v * np.sqrt(t)
    return sign * (s * cdf(sign * d1) - k * np.exp(-r * t) * cdf(sign * d2)), s * pdf(d1) * np.sqrt(t)


def implied_vol(call: Column, price: Column, s: Column, k: Column, t: Column, r: float = 0.07, low: float = 0.001, high: float = 20.0, steps: int = 60) -> Column:
    """Bisection of the price in volatility; null below 0.999 of intrinsic value or outside the bracket."""
    intrinsic = F.greatest(F.lit(0.0), F.when(call, s - k).otherwise(k - s))

    @F.pandas_udf("double")
    def bisected(sign: pd.Series, price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series) -> pd.Series:
        sign, price, s, k, t = (x.to_numpy(float) for x in (sign, price, s, k, t))
        lo, hi = np.full(len(s), low), np.full(len(s), high)
        with np.errstate(all="ignore"):
            for _ in range(steps):
                mid = (lo + hi) / 2
                below = price_and_vega(sign, s, k, t, r, mid)[0] < price
                lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return pd.Series((lo + hi) / 2)

    found = bisected(F.when(call, 1.0).otherwise(-1.0), price, s, k, t)
    valid = (price >= 0.999 * intrinsic) & (price > 0) & (t > 0) & (found > low * 1.001) & (found < high * 0.999)
    return F.when(valid, found)


#: Characters that have several as upper case, with the one that they turn into here: their title case if that is one, else themselves.
ONE_UPPER = {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1}


def simple_upper(text: Column) -> Column:
    """Upper case that keeps the number of characters: sharp s is one capital, ligatures stay; upper() makes SS and FI of them."""
    rare = "".join(c for c in ONE_UPPER if c != "\u00df")
    pieces = F.regexp_extract_all(text, F.lit(f"[{rare}]|[^{rare}]+"), F.lit(0))
    plain = lambda t: F.upper(F.replace(t, F.lit("\u00df"), F.lit("\u1e9e")))
    made = F.transform(pieces, lambda p: F.when(p.rlike(f"^[{rare}]"), F.translate(p, rare, "".join(ONE_UPPER[c] for c in rare))).otherwise(plain(p)))
    # Ranges that hold all rare ones: long lists of characters are slow to look for.
    return F.when(text.rlike("[\u0149-\u01f0\u0390\u03b0\u0587\u1e96-\u1e9a\u1f50-\u1ffc\ufb00-\ufb17]"), F.array_join(made, "")).otherwise(plain(text))


def news_id(source: Column, headline: Column) -> Column:
    return F.substring(F.md5(F.concat(source, F.lit(":"), headline)), 1, 12)


#: Event types by the first list of which a word is in the text. Fixed values.
EVENT_WORDS = (
    ("EARNINGS", ("RESULT", "EARNING", "FINANCIAL", "QUARTERLY", "Q1", "Q2", "Q3", "Q4")),
    ("DIVIDEND", ("DIVIDEND", "INTERIM DIV", "FINAL DIV")),
    ("BOARD_MEETING", ("BOARD MEETING", "BOARD MTG")),
    ("AGM", ("AGM", "EGM", "ANNUAL GENERAL")),
    ("BONUS_SPLIT", ("BONUS", "SPLIT", "SUBDIVISION")),
    ("RIGHTS_ISSUE", ("RIGHTS", "RIGHT ISSUE")),
    ("MERGER_ACQUIRE", ("MERGER", "AMALGAMATION", "ACQUISITION", "TAKEOVER")),
)
#: (event type, days ahead at most, action, widen factor, minutes of pause); the first that fits holds. Fixed values.
EVENT_IMPACT = (
    ("EARNINGS", 0, "PAUSE", 3.0, 120),
    ("EARNINGS", 1, "WIDEN", 2.0, 0),
    ("EARNINGS", 3, "WIDEN", 1.5, 0),
    ("EARNINGS", 7, "WIDEN", 1.2, 0),
    ("MERGER_ACQUIRE", 1, "AVOID", 5.0, 0),
    ("MERGER_ACQUIRE", 7, "WIDEN", 2.5, 0),
    ("BOARD_MEETING", 0, "WIDEN", 1.5, 0),
    ("BOARD_MEETING", 2, "WIDEN", 1.2, 0),
    ("BONUS_SPLIT", 1, "WIDEN", 1.3, 0),
    ("DIVIDEND", 0, "WIDEN", 1.2, 0),
)


def event_type(text: Column) -> Column:
    """The type of a corporate event from its description; OTHER if no list fits."""
    upper, out = simple_upper(F.coalesce(text, F.lit(""))), None
    for name, words in EVENT_WORDS:
        hit = upper.rlike("|".join(words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("OTHER")


def event_impact(kind: Column, days: Column) -> Column:
    """Struct of action, widen factor and minutes of pause for an event so many days ahead (0 or more)."""
    made = lambda action, factor, pause: F.struct(F.lit(action).alias("action"), F.lit(factor).alias("factor"), F.lit(pause).alias("pause"))
    out = None
    for name, upto, action, factor, pause in EVENT_IMPACT:
        fits = (kind == name) & (days <= upto)
        out = F.when(fits, made(action, factor, pause)) if out is None else out.when(fits, made(action, factor, pause))
    return out.otherwise(made("NORMAL", 1.0, 0))


#: Bounds of the volatility index's regimes. Fixed values.
VIX_REGIMES = [(12, "LOW"), (18, "NORMAL"), (25, "HIGH")]


def currency_pressure(dxy_change: Column, crude_change: Column, vix: Column, foreign_net: Column, bank_divergence: Column) -> Column:
    """Index of pressure on the currency: weighted dollar, oil, volatility, foreign flow and bank terms."""
    return 0.30 * (dxy_change / 0.5) + 0.25 * (crude_change / 1.0) + 0.20 * (vix / 15 - 1) + 0.15 * (-foreign_net / 1000) + 0.10 * (-bank_divergence / 0.5)


def pressure_regime(index: Column) -> Column:
    return F.when(index > 0.5, "STRONG_PRESSURE").when(index > 0.2, "MILD_PRESSURE").when(index > -0.2, "NEUTRAL").when(index > -0.5, "MILD_SUPPORT").when(index.isNotNull(), "STRONG_SUPPORT")


def quote_urgency(inventory: Column, time_left: Column, max_inventory: int) -> Column:
    """1 + |q| / max_inventory * (1 - T)."""
    return 1 + F.abs(inventory) / max(1, max_inventory) * (1 - time_left)


def reservation_price(mid: Column, inventory: Column, gamma: Column, sigma: Column, time_left: Column, max_inventory: int) -> Column:
    return mid - inventory * gamma * sigma * sigma * time_left * quote_urgency(inventory, time_left, max_inventory)


def optimal_spread(mid: Column, gamma: Column, kappa: Column, sigma: Column, time_left: Column, least: float, most: float, least_share: float = 0.0005) -> Column:
    """gamma s^2 T + 2 / gamma ln(1 + gamma / kappa), at most ``most`` and at least ``least`` and ``least_share`` of mid."""
    spread = gamma * sigma * sigma * time_left + 2 / gamma * F.log(1 + gamma / kappa)
    return F.greatest(F.lit(least), mid * least_share, F.least(spread, F.lit(most)))


def regime(x: Column, bounds: list[tuple[float, str]], above: str) -> Column:
    out = None
    for bound, name in bounds:
        out = F.when(x < bound, name) if out is None else out.when(x < bound, name)
    return F.when(x.isNotNull(), out.otherwise(above))


def frac_diff_weights(d: float, size: int) -> list[float]:
    """Binomial weights of (1 - B)^d, the current row's first."""
    out = [1.0]
    for k in range(1, size):
        out.append(-out[-1] * (d - k + 1) / k)
    return out


def round_to(x: Column, step: float) -> Column:
    """To the nearest multiple, halves to even."""
    return F.bround(x / step) * step
