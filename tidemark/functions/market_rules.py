"""Exchange rules as column expressions: boards, price limits, lots, fees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code prefixes of the boards and their limit thresholds in percent,
# with a tolerance of 2 % of the nominal 10/20/30 limit.
GROWTH_PREFIXES = ("300", "301")
STAR_PREFIXES = ("688", "689")
NORTH_PREFIXES = ("43", "82", "83", "87", "88", "92")
MAIN_LIMIT, WIDE_LIMIT, NORTH_LIMIT = 9.8, 19.6, 29.4


def board(code: Column) -> Column:
    three, two = F.substring(code, 1, 3), F.substring(code, 1, 2)
    return (
        F.when(three.isin(*GROWTH_PREFIXES), "chinext")
        .when(three.isin(*STAR_PREFIXES), "star")
        .when(two.isin(*NORTH_PREFIXES), "bse")
        .otherwise("main")
    )


def limit_threshold(code: Column) -> Column:
    b = board(code)
    return F.when(b.isin("chinext", "star"), WIDE_LIMIT).when(b == "bse", NORTH_LIMIT).otherwise(MAIN_LIMIT)


def is_limit_up(change_pct: Column, code: Column) -> Column:
    return F.coalesce(change_pct >= limit_threshold(code), F.lit(False))


def is_limit_down(change_pct: Column, code: Column) -> Column:
    return F.coalesce(change_pct <= -limit_threshold(code), F.lit(False))


# Dates of the rule changes.
CHINEXT_REFORM = "2020-08-24"
MAIN_REGISTRATION = "2023-04-10"
TRANSFER_FEE_MODELLED = "2015-08-01"
TRANSFER_FEE_UNIFIED = "2022-04-29"
STAMP_TAX_HALVED = "2023-08-28"


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def band_ratios(board: Column, session: Column, listed: Column, listing_no: Column, st: Column) -> tuple[Column, Column]:
    """Upper and lower daily limit ratios; NULL where the session trades without a limit."""
    plain = F.when(st, F.lit(0.05)).otherwise(F.lit(0.10))
    reformed = listed >= day(CHINEXT_REFORM)
    registered = listed >= day(MAIN_REGISTRATION)

    def side(first_day: float) -> Column:
        return (
            F.when(board == "stock_etf", 0.10)
            .when(board == "star", F.when(listing_no > 5, 0.20))
            .when(
                board == "chinext",
                F.when(~(reformed & (listing_no <= 5)), F.when(session >= day(CHINEXT_REFORM), 0.20).otherwise(plain)),
            )
            .when(board == "bse", F.when(listing_no > 1, 0.30))
            .otherwise(
                F.when(
                    ~(registered & (listing_no <= 5)),
                    F.when(~registered & (listing_no == 1), first_day).otherwise(plain),
                )
            )
        )

    return side(0.44), side(0.36)


def price_band(previous_close: Column, upper: Column, lower: Column) -> tuple[Column, Column]:
    """Limits rounded half up to the cent."""
    p = previous_close.cast("decimal(18,2)")
    up = F.round(p * (1 + upper.cast("decimal(4,2)")), 2)
    down = F.round(p * (1 - lower.cast("decimal(4,2)")), 2)
    return up.cast("decimal(18,2)"), down.cast("decimal(18,2)")


def lot_rule(board: Column) -> tuple[Column, Column]:
    """Minimum buy quantity and increment of a board."""
    minimum = F.when(board == "star", 200).otherwise(100)
    step = F.when(board.isin("star", "bse"), 1).otherwise(100)
    return minimum, step


def floor_buy_quantity(board: Column, maximum: Column) -> Column:
    minimum, step = lot_rule(board)
    return F.when(maximum < minimum, 0).otherwise(minimum + F.floor((maximum - minimum) / step) * step)


def fee_components(side: Column, exchange: Column, traded: Column, gross: Column, rate: str = "0.0003", least: str = "5") -> dict[str, Column]:
    """Commission, stamp tax and transfer fee, each rounded half up to the cent.

    A transfer fee outside the modelled dates stays NULL.
    """
    def cents(x: Column) -> Column:
        return F.round(x, 2).cast("decimal(18,2)")

    def dec(x: str) -> Column:
        return F.lit(x).cast("decimal(10,6)")

    commission = F.greatest(gross * dec(rate), F.lit(least).cast("decimal(18,2)"))
    stamp = F.when(side == "buy", dec("0")).when(traded >= day(STAMP_TAX_HALVED), dec("0.0005")).otherwise(dec("0.001"))
    transfer = F.when(traded >= day(TRANSFER_FEE_UNIFIED), dec("0.00001")).when(
        (exchange != "BJ") & (traded >= day(TRANSFER_FEE_MODELLED)), dec("0.00002")
    )
    return {"commission": cents(commission), "stamp_tax": cents(gross * stamp), "transfer_fee": cents(gross * transfer)}


def friction_price(raw: Column, side: str, bps: float, absolute: float, upper: Column, lower: Column) -> Column:
    """Price after slippage in basis points and in money, kept inside the limits."""
    d = 1 if side == "buy" else -1
    p = raw * (1 + d * bps / 10000) + d * absolute
    return F.greatest(F.least(p, upper), lower)


def tick_price(price: Column, side: str, tick: float = 0.01) -> Column:
    """Whole ticks: down for a buy, up for a sell."""
    n = F.round(price / tick, 6)
    return (F.floor(n) if side == "buy" else F.ceil(n)) * tick
