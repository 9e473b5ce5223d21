"""Company documents of the stock universe, made from the part table.

Each field is one expression over a brand's ``n`` parts and total size ``s``,
the same text in Spark SQL and DuckDB; some fields are missing for some brands.
``documents`` puts the fields into JSON as a provider would (numbers as texts,
marks of absence, older periods beside the latest), and ``fundamentals`` reads
them back through the operators on documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import facts
from barloom.sources.bars import stored, table
from barloom.sources.documents import parsed

FIELDS = {
    "sector": "CASE s % 6 WHEN 0 THEN 'Financials' WHEN 1 THEN 'Utilities' WHEN 2 THEN 'Energy' WHEN 3 THEN 'Technology' WHEN 4 THEN 'Industrials' END",
    "eps_now": "CASE WHEN s % 11 = 0 THEN NULL ELSE (s % 97 - 20) / 10 END",
    "eps_ago": "CASE WHEN s % 13 = 0 THEN NULL ELSE (s % 53 - 10) / 10 END",
    "roe": "CASE WHEN s % 17 = 0 THEN NULL ELSE (s % 40) / 100 END",
    "shares_float": "CASE WHEN s % 7 = 0 THEN NULL ELSE (s % 50) * 1000000 END",
    "holders": "CASE WHEN s % 19 = 0 THEN NULL ELSE s % 8 END",
    "ebit": "CASE WHEN s % 23 = 0 THEN NULL ELSE s % 900 - 50 END",
    "market_cap": "s % 7000 + 100",
    "enterprise_value": "CASE WHEN s % 3 = 0 THEN NULL ELSE s % 6000 + 50 END",
    "total_debt": "s % 800",
    "total_cash": "s % 500",
    "current_assets": "s % 1500 + 200",
    "cash": "s % 300",
    "current_liabilities": "s % 900 + 50",
    "current_debt": "s % 100",
    "net_ppe": "s % 2000 - 100",
    "price_currency": "'USD'",
    "financial_currency": "CASE WHEN s % 10 = 0 THEN 'EUR' ELSE 'USD' END",
    "growth": "CASE WHEN s % 9 = 0 THEN NULL ELSE s % 25 END",
    "forward_pe": "CASE WHEN s % 12 = 0 THEN NULL ELSE s % 40 - 3 END",
    "debt_to_equity": "CASE WHEN s % 14 = 0 THEN NULL ELSE (s % 300 - 10) / 100 END",
    "pe": "CASE WHEN s % 15 = 0 THEN NULL ELSE s % 45 - 4 END",
}
FUNDAMENTALS_SQL = "facts AS (SELECT p_brand AS symbol, " + ", ".join(f"{x} AS {k}" for k, x in FIELDS.items()) + " FROM (SELECT p_brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand))"
#: Annual earnings per share for 1997 to 2001.
EPS_SQL = "CASE WHEN (s + y) % 29 = 0 THEN NULL ELSE (s * (y - 1990) % 61) / 10 - 1 END"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("symbol"))
    return parts.agg(F.count("*").alias("n"), F.sum(F.col("p_size").cast("long")).alias("s"))


def _map(**items: str) -> str:
    return "map(" + ", ".join(f"'{k}', CAST({x} AS STRING)" for k, x in items.items()) + ")"


_NONE = "CAST(NULL AS STRING)"
_EVEN = "s % 2 = 0"
#: Sections of a document as Spark SQL over the fields.
SECTIONS = {
    "General": _map(Sector="sector", CurrencyCode="financial_currency", PriceCurrency="price_currency"),
    "Highlights": _map(
        ReturnOnEquityTTM="coalesce(CAST(roe AS STRING), 'NA')", MarketCapitalization="market_cap", PERatio="pe", DebtToEquity="debt_to_equity",
        TotalDebt="total_debt", TotalCash="total_cash"
    ),
    "Valuation": _map(EnterpriseValue="coalesce(CAST(enterprise_value AS STRING), 'None')", ForwardPE="forward_pe"),
    "SharesStats": _map(SharesFloat="shares_float"),
    "Holders": _map(Institutions="holders"),
    "Financials": f"""named_struct(
        'Income_Statement', named_struct('yearly', map(
            '2000-12-31', {_map(ebit="ebit + 77", operatingIncome="ebit + 99")},
            '2001-12-31', {_map(ebit=f"CASE WHEN {_EVEN} THEN CAST(ebit AS STRING) ELSE 'NA' END", operatingIncome=f"CASE WHEN {_EVEN} THEN CAST(ebit + 5 AS STRING) ELSE CAST(ebit AS STRING) END")},
            'not a date', {_map(ebit="1")})),
        'Balance_Sheet', named_struct('yearly', map(
            '2001-12-31', {_map(totalCurrentAssets="'None'", cash=_NONE, inventory="5")},
            '1999-12-31', {_map(totalCurrentAssets="1", cash="1", totalCurrentLiabilities="1")},
            '2000-12-31', {_map(totalCurrentAssets="current_assets", cashAndShortTermInvestments=f"CASE WHEN {_EVEN} THEN CAST(cash AS STRING) ELSE '-' END", cash=f"CASE WHEN {_EVEN} THEN '3' ELSE CAST(cash AS STRING) END",
                totalCurrentLiabilities="current_liabilities", shortTermDebt="current_debt", propertyPlantEquipment="net_ppe")})))""",
    "Earnings": f"""named_struct(
        'History', map_filter(map(
            '2001-12-31', {_map(date="'2001-12-31'", epsActual=_NONE)},
            '2001-09-30', {_map(date="'2001-09-30'", epsActual="eps_now")},
            'latest but two', {_map(date="'2001-06-30'", epsActual="'0.5'")},
            '2000-09-30', {_map(epsActual="coalesce(CAST(eps_ago AS STRING), 'n/a')")}), (k, v) -> eps_now IS NOT NULL OR k = '2001-12-31'),
        'Annual', map_from_entries(transform(sequence(1997L, 2001L), y -> struct(concat(y, '-12-31'), map('epsActual', CAST({EPS_SQL} AS STRING))))),
        'Trend', map('0y', map('growth', '0.5'), '+5y', map('growth', CAST(growth / 100 AS STRING))))""",
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, doc``: one JSON document for each brand, made once."""
    return stored(spark, "documents", [f"{sf_dir}/part.parquet"], lambda: _documents(spark, sf_dir), bucketed=False)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = _sizes(spark, sf_dir).selectExpr("symbol", "s", *[f"{x} AS {k}" for k, x in FIELDS.items()])
    return fields.selectExpr("symbol", f"to_json(named_struct({', '.join(f'{k!r}, {x}' for k, x in SECTIONS.items())})) AS doc")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields, read from the documents and kept."""
    return stored(spark, "facts", [f"{sf_dir}/part.parquet"], lambda: _facts(spark, sf_dir), bucketed=False)


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = _sizes(spark, sf_dir).selectExpr(*[f"{x} AS {k}" for k, x in FIELDS.items()]).schema
    found = facts.valuation(parsed(documents(spark, sf_dir)))
    return found.select("symbol", *[F.col(k).cast(types[k].dataType).alias(k) for k in FIELDS])


def annual_eps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``symbol, year, eps``."""
    return facts.annual_history(parsed(documents(spark, sf_dir)))


#: Funds whose document has yearly earnings, and those that have quarters.
YEARLY, QUARTERLY = ("AF", "NF"), ("AF", "NO", "RO")


def fund_documents(bars: DataFrame) -> DataFrame:
    """``symbol, doc`` of the funds: earnings and cash flow from highest closes."""
    m = F.floor(F.max("close"))
    years = bars.groupBy("symbol", F.year("date").alias("y")).agg(m.alias("m"))
    fiscal = years.where(F.col("symbol").isin(*YEARLY)).selectExpr(
        "symbol", "concat(y, '-12-31') AS k", "map('epsActual', CAST((m - 1500) / 20 AS STRING)) AS v"
    )
    ends = F.last_day(F.add_months(F.date_trunc("quarter", "date").cast("date"), 2))
    four = bars.where(F.col("symbol").isin(*QUARTERLY)).groupBy("symbol", ends.alias("q")).agg(m.alias("m")).selectExpr(
        "symbol", "CAST(q AS STRING) AS k", "map('epsActual', CAST(m / 200 AS STRING)) AS v"
    )
    cash = years.selectExpr(
        "symbol", "concat(y, '-12-31') AS k",
        "map('dividendsPaid', CAST(-(m % 29) - 1 AS STRING), 'netIncome', CASE WHEN m % 2 = 0 THEN CAST(m % 97 AS STRING) END) AS v"
    )
    income = years.selectExpr("symbol", "concat(y, '-12-31') AS k", "map('netIncome', CAST(m % 97 AS STRING)) AS v")
    out = bars.select("symbol").distinct()
    for name, rows in (("fiscal", fiscal), ("four", four), ("cash", cash), ("income", income)):
        out = out.join(rows.groupBy("symbol").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(name)), "symbol", "left")
    return out.selectExpr(
        "symbol",
        "to_json(named_struct('Earnings', named_struct('Annual', fiscal, 'History', four), 'Financials', named_struct('Cash_Flow', named_struct('yearly', cash), 'Income_Statement', named_struct('yearly', income)))) AS doc",
    )
