"""Receipt texts rendered from orders, customer, lineitem and part, in Spark and in DuckDB.

The truth about every text follows from the source columns, so most checks need no pattern
matching of their own (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEMPLATE = """
with it as (
 select l_orderkey k, {body} body
 from lineitem join part on l_partkey=p_partkey
 join (select o_orderkey, substr('$£€₱¥',cast(o_orderkey%5 as int)+1,1) sym from orders) s
   on s.o_orderkey=l_orderkey
 group by l_orderkey),
b as (select o_orderkey k, c_name vendor, cast(o_orderdate as date) d, o_totalprice total,
  case when o_orderkey%17=0 then o_totalprice+1 else floor(o_totalprice*8)/{hundred} end tax,
  substr('$£€₱¥',cast(o_orderkey%5 as int)+1,1) sym, coalesce(body,'') body
 from orders join customer on o_custkey=c_custkey left join it on it.k=o_orderkey),
t as (select *, concat(vendor,{nl},'Date: ',
   case k%4 when 0 then {iso} when 1 then {slashed} when 2 then {day_month} else {month_day} end,
   {nl},body,{nl},'Subtotal  ',sym,{total},{nl},'Tax  ',sym,{tax},{nl},
   case when k%10=3 then '' else concat('TOTAL  ',sym,{total},{nl}) end) txt from b)
"""

# The copy and the re-scan of an order come as rows of their own.
_UNION = """select concat('r_',lpad(cast(k as {string}),20,'0'),'.txt') source_file,
  case when k%13=0 then '' else txt end text from t
union all
select concat('r_',lpad(cast(k as {string}),20,'0'),'_copy.txt'),
  case when k%13=0 then '' else txt end from t where k%7=0
union all
select concat('r_',lpad(cast(k as {string}),20,'0'),'_scan.txt'),
  concat(upper(vendor),{nl},{nl},'Date: ',{iso},{nl},'TOTAL  ',sym,{total},{nl})
from t where k%11=0 and k%10<>3 and k%13<>0
"""

# The same rows out of one pass over the rendered orders.
_EXPLODED = """select inline(array_compact(array(
 named_struct('source_file',concat('r_',lpad(cast(k as {string}),20,'0'),'.txt'),
  'text',case when k%13=0 then '' else txt end),
 case when k%7=0 then named_struct('source_file',concat('r_',lpad(cast(k as {string}),20,'0'),'_copy.txt'),
  'text',case when k%13=0 then '' else txt end) end,
 case when k%11=0 and k%10<>3 and k%13<>0 then
  named_struct('source_file',concat('r_',lpad(cast(k as {string}),20,'0'),'_scan.txt'),
   'text',concat(upper(vendor),{nl},{nl},'Date: ',{iso},{nl},'TOTAL  ',sym,{total},{nl})) end)))
from t
"""

_SPARK = (_TEMPLATE + _EXPLODED).format(
    body="array_join(transform(array_sort(collect_list(struct(l_linenumber, l_partkey, l_suppkey,"
    " l_extendedprice, concat(p_name,'  ',s.sym,format_number(l_extendedprice,2)) as t))),"
    " x -> x.t),'\\n')",
    hundred="100D",
    nl="'\\n'",
    iso="date_format(d,'yyyy-MM-dd')",
    slashed="date_format(d,'MM/dd/yyyy')",
    day_month="date_format(d,'dd MMM yyyy')",
    month_day="date_format(d,'MMM dd, yyyy')",
    total="format_number(total,2)",
    tax="format_number(tax,2)",
    string="string",
)

TEXTS_SQL = (_TEMPLATE + _UNION).format(
    body="string_agg(concat(p_name,'  ',s.sym,format('{:,.2f}',l_extendedprice)), chr(10)"
    " order by l_linenumber,l_partkey,l_suppkey,l_extendedprice)",
    hundred="100.0",
    nl="chr(10)",
    iso="strftime(d,'%Y-%m-%d')",
    slashed="strftime(d,'%m/%d/%Y')",
    day_month="strftime(d,'%d %b %Y')",
    month_day="strftime(d,'%b %d, %Y')",
    total="format('{:,.2f}',total)",
    tax="format('{:,.2f}',tax)",
    string="varchar",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def receipt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_file, text) for every order, with copies and re-scans."""
    tables = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "part")}
    query = _SPARK
    for name in tables:
        query = query.replace(f"from {name} ", f"from {{{name}}} ").replace(
            f"join {name} ", f"join {{{name}}} "
        )
    query = query.replace("from orders)", "from {orders})")
    return spark.sql(query, **tables)
