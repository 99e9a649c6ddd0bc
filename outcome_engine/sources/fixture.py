"""``ventures_raw``: a dirty venture table derived from the driver's ``customer`` and ``orders``.

Test data only.  One row per customer; the order history gives an amount
(total price), a round count (number of orders) and dates.  Every kind of dirt
the cleaner handles is present: null names, ``-`` amounts, mixed-case status,
lower-case countries, padded and empty category items, an unparsable date and
first funding before founding.

The per-column definitions are SQL expressions that run unchanged in Spark and
DuckDB, so the Spark fixture and the oracle's first CTE are the same data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_table

# The category words and country codes the fixture draws from.
_CATEGORY_WORDS = ("software,biotechnology,e-commerce,saas,mobile,health  care,games,ai,b2b,"
                   "it services,iot,clean technology,big data,hr,finance,education")
_COUNTRY_CODES = "USA,GBR,CAN,DEU,FRA,IND,CHN,BRA,ISR,ESP,NLD,SWE"


def _url(suffix: str, upper: bool = False) -> str:
    head, tail = ("'HTTP://V'", f"'{suffix.upper()}'") if upper else ("'http://v'", f"'{suffix}'")
    return f"concat({head},cast(c_custkey as string),{tail})"


# (column, SQL expression over customer c_* and per-customer order stats n, tot, d0, d1)
FIXTURE_COLUMNS: tuple[tuple[str, str], ...] = (
    ("k", "c_custkey"),
    ("name", "case when c_custkey%97=0 then null else c_name end"),
    ("homepage_url",
     f"case c_custkey%7 when 0 then null when 1 then {_url('.com')} when 2 then {_url('.org')} "
     f"when 3 then {_url('.net')} when 4 then {_url('.io', upper=True)} when 5 then {_url('.co')} "
     f"else {_url('.de')} end"),
    ("category_list",
     f"case when c_custkey%19=0 then null when c_custkey%37=0 then 'null' else concat(' ',split_part('{_CATEGORY_WORDS}',',',cast(c_custkey%16+1 as int)),"
     f"case when c_custkey%3>0 then concat('|',split_part('{_CATEGORY_WORDS}',',',cast((c_custkey*7+5)%16+1 as int))) else '' end,"
     "case when c_custkey%7=3 then '||analytics ' else '' end) end"),
    ("funding_total_usd",
     "case when c_custkey%11=0 or tot is null then '-' else cast(cast(cast(round(tot,2) as decimal(14,2))"
     "*cast(case cast(floor(c_custkey/7) as int)%5 when 0 then 0.01 when 1 then 0.1 when 2 then 1 when 3 then 10 "
     "else 50 end as decimal(4,2)) as decimal(18,4)) as string) end"),
    ("status",
     "case when c_custkey%101=0 then 'NA' else case (c_custkey*37)%10 when 0 then 'acquired' when 1 then 'acquired' when 2 then "
     "(case when c_nationkey<12 then 'ipo' else 'closed' end) when 3 then "
     "(case when cast(floor(c_custkey/7) as int)%5=4 then 'acquired' else 'closed' end) when 4 then "
     "(case when cast(floor(c_custkey/7) as int)%5<3 then 'Closed' else 'acquired' end) else 'operating' end end"),
    ("country_code",
     f"case when c_nationkey=24 then null when c_custkey%31=0 then 'N/A' else lower(split_part('{_COUNTRY_CODES}',',',cast(c_nationkey%12+1 as int))) end"),
    ("state_code", "case when c_custkey%4=0 then null else concat('s',cast(c_custkey%9 as string)) end"),
    ("city", "case when c_custkey%6=0 then null else concat('City ',cast(c_custkey%40 as string)) end"),
    ("funding_rounds", "case when c_custkey%23=0 then null else n end"),
    ("founded_at",
     "case when c_custkey%13=0 then null else cast(d0+cast((c_custkey%21)*365-c_custkey%900+"
     "(case when c_custkey%50=7 then 1000 else 0 end) as int) as string) || (case when c_custkey%17=0 then 'T08:30:00' else '' end) end"),
    ("first_funding_at", "cast(d0+cast((c_custkey%21)*365 as int) as string)"),
    ("last_funding_at",
     "case when c_custkey%29=0 then 'n/a-date' else cast(d1+cast((c_custkey%21)*365 as int) as string) end"),
)

_ORDER_STATS_SQL = ("select o_custkey k, count(*) n, sum(o_totalprice) tot, min(cast(o_orderdate as date)) d0, "
                    "max(cast(o_orderdate as date)) d1 from orders group by o_custkey")

VENTURES_RAW_SQL = (
    f"with o as ({_ORDER_STATS_SQL}) select "
    + ", ".join(f"{expr} {name}" for name, expr in FIXTURE_COLUMNS)
    + " from customer left join o on c_custkey=o.k"
)


def ventures_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dirty venture table, one row per customer (column pruning reaches both scans)."""
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", "o_orderdate")
    # Partial (map-side) aggregation before the shuffle on o_custkey; the join
    # with customer reuses that hash partitioning.
    stats = (orders.groupBy(F.col("o_custkey").alias("ok"))
             .agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("tot"),
                  F.min(F.col("o_orderdate").cast("date")).alias("d0"),
                  F.max(F.col("o_orderdate").cast("date")).alias("d1")))
    joined = customer.join(stats, customer.c_custkey == stats.ok, "left")
    return joined.select(*[F.expr(expr).alias(name) for name, expr in FIXTURE_COLUMNS])
