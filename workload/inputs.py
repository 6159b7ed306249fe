"""Inputs the queries share, all derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import review
from tillroll.operators.extract import read_receipts
from workload.receipts import receipt_texts, table

RUN_ID = 7
CREATED_AT = "2026-01-05 00:00:00"


def base_key() -> Column:
    """Order key out of a receipt file name."""
    return F.substring("source_file", 3, 20).cast("bigint")


def receipts(spark: SparkSession, sf_dir: str, options=None) -> DataFrame:
    texts = receipt_texts(spark, sf_dir)
    return read_receipts(texts, options) if options else read_receipts(texts)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.lpad(F.col("doc_id").cast("string"), 20, "0"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").withColumn("source_file", name)


def event_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as processed files: every quarter of an hour is a run, errors have failed."""
    events = table(spark, sf_dir, "events")
    return review.flag_for_review(
        events.select(
            F.concat(F.lit("event_"), F.lpad(F.col("event_id").cast("string"), 20, "0")).alias("source_file"),
            F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("vendor"),
            F.date_format("ts", "yyyy-MM-dd").alias("date"),
            F.col("value").alias("total"),
            F.array(F.concat(F.lit("event "), F.col("event_type"))).alias("warnings"),
            F.lit(None).cast("string").alias("duplicate_of"),
            (F.col("event_type") == "error").alias("extraction_failed"),
            F.floor(F.unix_timestamp("ts") / 900).cast("bigint").alias("run_id"),
            "event_id",
        )
    )


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = review.run_summary(event_receipts(spark, sf_dir), "run_id")
    return summary.select(
        F.timestamp_seconds(F.col("run_id") * 900).alias("started_at"),
        "files_processed", "flagged_count", "duplicate_count",
        F.lit("rule_based").alias("engine"), "run_id",
    )


def event_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.flagged_items(event_receipts(spark, sf_dir), F.lit(CREATED_AT))


def event_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review requests for a third of all events, flagged or not, some of them twice."""
    rows = event_receipts(spark, sf_dir).where("event_id % 3 = 0")
    ids = rows.select(
        review.item_id(F.col("run_id"), F.col("source_file")).alias("item_id"), "source_file", "event_id"
    )
    return ids.unionByName(ids.where("event_id % 2 = 0"))


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, _ = review.apply_reviews(
        event_flagged(spark, sf_dir), event_reviews(spark, sf_dir), F.lit(CREATED_AT)
    )
    return known


# Replies by order key: what the model wrote, and how often it was asked.
_REPLY = """
select o_orderkey k, concat('r_',lpad(cast(o_orderkey as string),20,'0'),'.png') source_file,
  case when o_orderkey%11=4 then 'nope'
       when o_orderkey%11=5 then '[1]'
       else concat(
         case when o_orderkey%2=0 then '```json\\n' else '' end,
         '{{"vendor": "  ',c_name,' ", "date": "',date_format(o_orderdate,'yyyy-MM-dd'),
         '", "total": ',
         case when o_orderkey%3=0 then concat('"$',format_number(o_totalprice,2),'"')
              when o_orderkey%3=1 then replace(format_number(o_totalprice,2),',','')
              else '"USD 5"' end,
         ', "tax": ', case when o_orderkey%5=0 then 'true' else '1.5' end,
         ', "currency": ', case when o_orderkey%7=0 then 'null' else '"EUR"' end,
         ', "line_items": [{{"description": " ',o_orderpriority,'", "amount": "1,000.50"}}, "junk"]}}',
         case when o_orderkey%2=0 then '\\n```' else '' end) end reply
from {orders} join {customer} on o_custkey=c_custkey
"""
_ATTEMPTS = """
with r as ({reply}),
good as (select k, source_file,
  to_json(named_struct('candidates', array(named_struct('content', named_struct('parts',
    array(named_struct('text', reply))))))) body from r)
select source_file, inline(transform(case
    when k%23=0 then array(named_struct('n', 0, 'status', 400, 'body', '{{"error": {{"message": "bad key", "status": "DENIED"}}}}'))
    when k%19=0 then array(named_struct('n', 0, 'status', 429, 'body', '{{"error": {{"status": "RESOURCE_EXHAUSTED"}}}}'),
      named_struct('n', 1, 'status', 200, 'body', body))
    when k%29=0 then array(named_struct('n', 0, 'status', 200, 'body', '{{"candidates": []}}'))
    when k%31=0 then array(named_struct('n', 0, 'status', 0, 'body', '{{"error": "network error"}}'),
      named_struct('n', 1, 'status', 503, 'body', 'no json'))
    else array(named_struct('n', 0, 'status', 200, 'body', body)) end,
  a -> named_struct('seq', k*10+a.n, 'status', a.status, 'body', a.body))), k
from good where k is not null
"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REPLY, orders=table(spark, sf_dir, "orders"), customer=table(spark, sf_dir, "customer"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of 16 runs (source_file, seq, status, body, k, run_id)."""
    rows = spark.sql(
        _ATTEMPTS.replace("{reply}", _REPLY),
        orders=table(spark, sf_dir, "orders"),
        customer=table(spark, sf_dir, "customer"),
    )
    return rows.withColumn("run_id", F.col("k") % 16)


def served_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts as one run (source_file, content_hash, seq, status, body, k). Files that fail
    come last, as the run would have stopped at a failure before its first success."""
    k = F.col("k")
    fails = (k % 23 == 0) | (k % 29 == 0) | (k % 31 == 0)
    return responses(spark, sf_dir).drop("run_id").withColumns(
        {
            "seq": F.col("seq") + F.when(fails, F.lit(1 << 40)).otherwise(F.lit(0)),
            "content_hash": F.md5(k.cast("string")),
        }
    )


def bare_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with bare NaN and Infinity, and with their names inside strings."""
    return spark.sql(
        """
        select concat('n_',lpad(cast(o_orderkey as string),20,'0'),'.png') source_file,
          concat('{{"vendor": ', case o_orderkey%4 when 0 then 'NaN' when 1 then '"NaN, \\\\" Infinity"'
              when 2 then '-Infinity' else '"x"' end,
            ', "date": "Infinity", "note": [NaN, Infinity , -Infinity], "total": ',
            format_number(o_totalprice, '0.00'), ', "currency": ',
            case when o_orderkey%5=0 then '-NaN' when o_orderkey%5=1 then 'Infinity' else 'null' end,
            ', "line_items": [NaN, {{"description": Infinity, "amount": 2}}]}}') reply
        from {orders}
        """,
        orders=table(spark, sf_dir, "orders"),
    )


def mixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts whose bytes do not decide their fields, six per order, and one more per order
    that all have the same bytes and no fields."""
    return spark.sql(
        """
        with rows as (select o_orderkey k, concat('m_',lpad(cast(o_orderkey as string),20,'0')) n
                      from {orders}),
        kinds as (select k, n, inline(array(
            struct('a', 'h1', 1D), struct('b', 'h1', 2D), struct('c', 'h2', 2D),
            struct('d', 'h3', 2D), struct('e', 'h2', 3D), struct('f', 'h4', 3D),
            struct('z', cast(null as string), cast(null as double)))) as (part, h, total) from rows)
        select concat(n,'_',part) source_file, case when total is null then null when part in ('d','f') then upper(n) else concat(' ',n) end vendor,
          '2026-01-05' date, total, array('read') warnings,
          case when h is null then md5('') else md5(concat(n,h)) end content_hash,
          cast(null as string) duplicate_of
        from kinds
        """,
        orders=table(spark, sf_dir, "orders"),
    )
