"""Company facts from parsed documents: one row a symbol, each value from one
named period, never filled in from another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.series import r6
from barloom.sources.documents import earnings, number, statements

c = F.col

#: Items of an income statement, first choice first.
EBIT_ITEMS = ("ebit", "operatingIncome")
#: Items of a balance sheet for each part of the capital, first choice first.
BALANCE_ITEMS = {
    "current_assets": ("totalCurrentAssets",),
    "cash": ("cashAndShortTermInvestments", "cash"),
    "current_liabilities": ("totalCurrentLiabilities",),
    "current_debt": ("shortLongTermDebt", "shortTermDebt"),
    "net_ppe": ("propertyPlantEquipment",),
}


def _first(items: tuple[str, ...]) -> F.Column:
    return F.coalesce(*[number(c("items")[x]) for x in items])


def _latest(rows: DataFrame) -> DataFrame:
    """Each symbol's row of the latest ``day``."""
    others = [x for x in rows.columns if x != "symbol"]
    return rows.groupBy("symbol").agg(F.max_by(F.struct(*others), "day").alias("r")).select("symbol", "r.*")


def ebit(docs: DataFrame) -> DataFrame:
    """``symbol, ebit, ebit_day, ebit_item``: the latest year that has earnings
    before interest and tax, or else operating income."""
    item = F.coalesce(*[F.when(number(c("items")[x]).isNotNull(), F.lit(x)) for x in EBIT_ITEMS])
    rows = statements(docs, "Income_Statement").select("symbol", "day", _first(EBIT_ITEMS).alias("ebit"), item.alias("ebit_item"))
    return _latest(rows.where("ebit is not null")).withColumnRenamed("day", "ebit_day")


def balance(docs: DataFrame) -> DataFrame:
    """The parts of the capital of the latest year that has any of them."""
    parts = [_first(items).alias(k) for k, items in BALANCE_ITEMS.items()]
    rows = statements(docs, "Balance_Sheet").select("symbol", "day", *parts)
    return _latest(rows.where(F.coalesce(*BALANCE_ITEMS).isNotNull())).withColumnRenamed("day", "balance_day")


def quarters(docs: DataFrame, apart: int = 364, within: int = 45) -> DataFrame:
    """``symbol, eps_now, eps_day, eps_ago, ago_day``: the latest quarter and the
    one nearest to a year before it (the later of two), at most ``within`` days off."""
    rows = earnings(docs)
    now = _latest(rows).withColumnRenamed("day", "eps_day").withColumnRenamed("eps", "eps_now")
    off = F.abs(F.datediff("day", F.date_sub("eps_day", apart)))
    before = rows.join(now, "symbol").where(c("day") < c("eps_day")).withColumn("off", off).where(c("off") <= within)
    ago = before.groupBy("symbol").agg(F.min_by(F.struct("eps", "day"), F.struct("off", (-F.unix_date("day")).alias("x"))).alias("r"))
    ago = ago.select("symbol", c("r.eps").alias("eps_ago"), c("r.day").alias("ago_day"))
    return now.join(ago, "symbol", "left").select("symbol", "eps_now", "eps_day", "eps_ago", "ago_day")


def annual_history(docs: DataFrame, most: int = 5) -> DataFrame:
    """``symbol, year, eps`` of the latest ``most`` reported years."""
    back = Window.partitionBy("symbol").orderBy(F.desc("day"))
    rows = earnings(docs, "Annual").withColumn("k", F.row_number().over(back)).where(c("k") <= most)
    return rows.select("symbol", F.year("day").cast("long").alias("year"), "eps")


def forward_growth(docs: DataFrame) -> DataFrame:
    """``symbol, growth``: analysts' growth over the next five years, in percent."""
    growth = F.round(number(c("d.Earnings.Trend")["+5y"]["growth"]) * 100, 6)
    return docs.select("symbol", growth.alias("growth")).where("growth is not null")


def valuation(docs: DataFrame) -> DataFrame:
    """One row a symbol with the inputs of the screens; what a document lacks is
    null.  ``docs`` are parsed documents, one a symbol."""
    take = lambda section, item, name: number(c(f"d.{section}")[item]).alias(name)
    base = docs.select(
        "symbol", c("d.General")["Sector"].alias("sector"), c("d.General")["CurrencyCode"].alias("financial_currency"), c("d.General")["PriceCurrency"].alias("price_currency"),
        take("Highlights", "ReturnOnEquityTTM", "roe"), take("Highlights", "MarketCapitalization", "market_cap"), take("Highlights", "PERatio", "pe"),
        take("Highlights", "DebtToEquity", "debt_to_equity"), take("Highlights", "TotalDebt", "total_debt"), take("Highlights", "TotalCash", "total_cash"),
        take("Valuation", "EnterpriseValue", "enterprise_value"), take("Valuation", "ForwardPE", "forward_pe"),
        take("SharesStats", "SharesFloat", "shares_float"), take("Holders", "Institutions", "holders"),
    )
    for part in (quarters(docs), ebit(docs), balance(docs), forward_growth(docs)):
        base = base.join(part, "symbol", "left")
    return base


def _band(x: F.Column) -> F.Column:
    return F.when(x <= 60, "Moderate").when(x <= 80, "Elevated").when(x <= 100, "High").when(x.isNotNull(), "Exceeds earnings")


def payout_bases(docs: DataFrame, pays: DataFrame, as_of: str) -> DataFrame:
    """Payout on three bases, and the first that holds: the fiscal year, the last
    four reported quarters (whose ends lie 200 to 330 days apart), and dividends
    paid against net income of one year's cash-flow statement.

    Dividends count by ex-date in the twelve months to the period's end.  Earnings
    of zero or less are not meaningful, and hide the cash basis.
    """
    day = F.lit(as_of).cast("date")
    past = pays.where(c("ex_date") <= day).select("symbol", "ex_date", "amount")
    fiscal = _latest(earnings(docs, "Annual").where(c("day") <= day)).select("symbol", c("day").alias("stop"), c("eps").alias("fiscal_eps"))
    back = Window.partitionBy("symbol").orderBy(F.desc("day"))
    four = earnings(docs).where(c("day") <= day).withColumn("k", F.row_number().over(back)).where("k <= 4")
    four = four.groupBy("symbol").agg(
        F.count("*").alias("n"), F.max("day").alias("stop"), F.datediff(F.max("day"), F.min("day")).alias("span"), F.sum("eps").alias("ttm_eps")
    )
    four = four.where((c("n") == 4) & c("span").between(200, 330)).select("symbol", "stop", "ttm_eps")

    def ratio(eps: DataFrame, name: str) -> DataFrame:
        """Dividends of the year to ``stop`` over the earnings."""
        met = eps.join(past, "symbol", "left")
        inside = (c("ex_date") > F.add_months("stop", -12)) & (c("ex_date") <= c("stop"))
        g = met.groupBy("symbol", "stop", f"{name}_eps").agg(F.coalesce(F.sum(F.when(inside, c("amount"))), F.lit(0.0)).alias("paid"))
        return g.select("symbol", f"{name}_eps", F.when(c(f"{name}_eps") > 0, c("paid") / c(f"{name}_eps") * 100).alias(f"{name}_payout"))

    income = statements(docs, "Income_Statement").select("symbol", "day", number(c("items")["netIncome"]).alias("income2"))
    cash = statements(docs, "Cash_Flow").select(
        "symbol", "day", number(c("items")["dividendsPaid"]).alias("out"), number(c("items")["netIncome"]).alias("income1")
    )
    cash = cash.join(income, ["symbol", "day"], "left").withColumn("income", F.coalesce("income1", "income2")).where("out is not null and income is not null")
    cash = _latest(cash.select("symbol", "day", "out", "income")).select(
        "symbol", F.lit(True).alias("has_cash"), F.when(c("income") > 0, F.abs("out") / c("income") * 100).alias("cash_payout")
    )
    df = docs.select("symbol").join(ratio(fiscal, "fiscal"), "symbol", "left").join(ratio(four, "ttm"), "symbol", "left").join(cash, "symbol", "left")
    lost = (c("fiscal_eps") <= 0) | (c("ttm_eps") <= 0)
    basis = F.when(c("fiscal_payout").isNotNull(), "fiscal_year").when(c("ttm_payout").isNotNull(), "trailing_twelve_months").when(F.coalesce(lost, F.lit(False)), None).when(c("cash_payout").isNotNull(), "aggregate_cash_basis")
    value = F.when(basis == "fiscal_year", c("fiscal_payout")).when(basis == "trailing_twelve_months", c("ttm_payout")).when(basis == "aggregate_cash_basis", c("cash_payout"))
    status = F.when(basis.isNotNull(), "available").when(F.coalesce(lost, F.lit(False)), "not_meaningful").otherwise("unavailable")
    return df.select(
        "symbol", *[r6(x).alias(x) for x in ("fiscal_payout", "ttm_payout", "cash_payout")], basis.alias("basis"), r6(value).alias("payout_percent"),
        status.alias("status"), _band(F.round(value, 2)).alias("band")
    )
