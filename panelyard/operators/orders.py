"""From target weights to whole-share orders, and the guards that stand before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(x: Column) -> Column:
    """The nearest whole number, halves away from zero."""
    return (F.signum(x) * F.floor(F.abs(x) + F.lit(0.5))).cast("bigint")


def valid_price(price: Column, symbol: Column) -> Column:
    """The price, where it is finite and above zero; anything else ends the query with the symbol's name."""
    fit = price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < float("inf"))
    return F.when(fit, price).otherwise(F.raise_error(F.concat(F.lit("no valid price for "), F.coalesce(symbol.cast("string"), F.lit("null")))).cast("double"))


def to_share_orders(trades: DataFrame, prices: DataFrame, capital: float, *, min_notional: float) -> DataFrame:
    """(asset, symbol, shares, price, notional) for (asset, weight) and (asset, symbol, price): trades of signed weights of ``capital``.

    A trade that rounds to no share, or is worth less than ``min_notional``, isn't sent. Rows come in the order of asset.
    """
    met = trades.join(prices, "asset", "left").withColumn("price", valid_price(F.col("price"), F.coalesce(F.col("symbol").cast("string"), F.col("asset").cast("string"))))
    sized = met.withColumn("shares", whole(F.col("weight") * F.lit(float(capital)) / F.col("price"))).withColumn("notional", F.abs("shares") * F.col("price"))
    return sized.where((F.col("shares") != 0) & (F.col("notional") >= min_notional)).select("asset", "symbol", "shares", "price", "notional").orderBy("asset")


def check_paper_account(account: str, port: int, *, allowed: bool, paper_ports: tuple[int, ...] = (4002, 7497), prefix: str = "DU") -> None:
    """Only a paper account, on a paper port, with the switch on."""
    if not allowed or port not in paper_ports or not account.startswith(prefix):
        raise PermissionError("orders need the switch, a paper port and a paper account")


def daily_shares_cap(panel: DataFrame, shares: DataFrame, *, close: str = "close") -> DataFrame:
    """``panel`` with the latest known shares outstanding as of each date and the capitalisation, |close| times shares.

    ``shares`` are (asset, date, shares) reports; a report holds from its date until the next one. Reports and panel
    rows share one partition and sort by asset, so the as-of join is a window and no range join.
    """
    reports = shares.select("asset", "date", F.col("shares").cast("double").alias("_s"), F.lit(0).alias("_k"))
    rows = panel.withColumn("_s", F.lit(None).cast("double")).withColumn("_k", F.lit(1))
    from pyspark.sql import Window

    behind = Window.partitionBy("asset").orderBy("date", "_k").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(reports, allowMissingColumns=True).withColumn("shares", F.last("_s", ignorenulls=True).over(behind))
    return both.where("_k = 1").withColumn("cap", F.abs(F.col(close)) * F.col("shares")).drop("_s", "_k")
