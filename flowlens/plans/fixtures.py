"""Views over the given tables that the queries run on (FIXTURES.md section 2).

Each fixture exists twice: as a DataFrame builder for Spark and as SQL text
for the DuckDB oracle. Both must produce identical rows.

``flows``: orders x customer x nation, plus lineitem totals per order. The
line-item aggregate shuffles lineitem by l_orderkey once; orders is shuffled
by o_orderkey for the join, so the aggregate side needs no second exchange.
``nation`` is a fixed 25-row dimension and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.tables import read_table

# Feature roles of the flows fixture (fixed values)
FLOW_CATEGORICAL = ["protocol", "service", "flag"]
FLOW_BINARY = ["overdrawn"]
FLOW_NUMERIC = ["n_lines", "qty", "amount", "max_discount", "total", "balance"]
FLOW_CONSTANT = ["always_zero"]
FLOW_TARGET = "attack_type"
FLOW_COLUMNS = (["row_id"] + FLOW_CATEGORICAL + FLOW_BINARY + FLOW_CONSTANT + FLOW_NUMERIC + [FLOW_TARGET])
BENIGN = "normal"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    # Money is summed exactly as integer cents (bigint): the same value a decimal(18,2) sum
    # gives, without the slow wide-decimal aggregation buffer.
    def cents(c):
        return F.floor(F.col(c) * F.lit(100.0) + F.lit(0.5))

    lines = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines_"),
        F.sum(cents("l_quantity")).alias("qty_c"),
        F.sum(cents("l_extendedprice")).alias("amount_c"),
        F.max("l_discount").alias("max_discount_"))
    cn = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
    j = (o.join(cn, o.o_custkey == cn.c_custkey, "inner")
         .join(lines, o.o_orderkey == lines.l_orderkey, "left"))
    amount_c = F.coalesce(F.col("amount_c"), F.lit(0).cast("bigint"))
    label = (F.when(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 1) == "0", "spoof")
             .when(amount_c >= 26000000, "flood")
             .when(F.col("c_acctbal") < 0, "probe")
             .otherwise("normal"))
    return j.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_orderpriority").alias("protocol"),
        F.col("c_mktsegment").alias("service"),
        F.when(F.col("n_regionkey").isNull(), "none").otherwise(F.col("n_regionkey").cast("string")).alias("flag"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).cast("int").alias("overdrawn"),
        F.lit(0).cast("bigint").alias("always_zero"),
        F.coalesce(F.col("n_lines_"), F.lit(0).cast("bigint")).alias("n_lines"),
        (F.coalesce(F.col("qty_c"), F.lit(0).cast("bigint")) / F.lit(100.0)).alias("qty"),
        (amount_c / F.lit(100.0)).alias("amount"),
        F.coalesce(F.col("max_discount_"), F.lit(0.0)).alias("max_discount"),
        F.col("o_totalprice").alias("total"),
        F.col("c_acctbal").alias("balance"),
        label.alias("attack_type"))


FLOWS_SQL = """
select o.o_orderkey as row_id, o.o_orderpriority as protocol, c.c_mktsegment as service,
  case when n.n_regionkey is null then 'none' else cast(n.n_regionkey as varchar) end as flag,
  cast(case when c.c_acctbal < 0 then 1 else 0 end as int) as overdrawn,
  cast(0 as bigint) as always_zero,
  coalesce(l.n_lines, 0) as n_lines,
  floor(cast(coalesce(l.qty, 0) as double) * 1e2 + 0.5) / 1e2 as qty,
  floor(cast(coalesce(l.amount, 0) as double) * 1e2 + 0.5) / 1e2 as amount,
  coalesce(l.max_discount, 0e0) as max_discount,
  o.o_totalprice as total, c.c_acctbal as balance,
  case when substr(md5(cast(o.o_orderkey as varchar)), 1, 1) = '0' then 'spoof'
       when coalesce(l.amount, 0) >= 260000 then 'flood'
       when c.c_acctbal < 0 then 'probe' else 'normal' end as attack_type
from orders o join customer c on c.c_custkey = o.o_custkey
left join nation n on n.n_nationkey = c.c_nationkey
left join (select l_orderkey, count(*) as n_lines, sum(cast(l_quantity as decimal(18,2))) as qty,
  sum(cast(l_extendedprice as decimal(18,2))) as amount, max(l_discount) as max_discount
  from lineitem group by l_orderkey) l on l.l_orderkey = o.o_orderkey
"""


def flows_table(spark: SparkSession, sf_dir: str, labelled: bool = False) -> DataFrame:
    """flows written once to the shared checkpoint folder, for queries that pass over it
    several times (a quantile probe, counts, then the rows)."""
    from flowlens.session import materialize
    return materialize(labelled_flows(spark, sf_dir) if labelled else flows(spark, sf_dir), "flows")


def labelled_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flows + label = 0 for the benign class, else 1."""
    from flowlens.functions.labels import binarize_equals
    return binarize_equals(flows(spark, sf_dir), FLOW_TARGET, BENIGN, "label")


LABELLED_FLOWS_SQL = f"""
select *, case when attack_type = '{BENIGN}' then 0 else 1 end as label from ({FLOWS_SQL}) f
"""


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a scored set: score = value, label = 1 for error events."""
    e = read_table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return e.select(F.col("event_id").alias("row_id"), "user_id", "event_type",
                    F.col("value").alias("score"),
                    F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"))


SCORED_EVENTS_SQL = """
select event_id as row_id, user_id, event_type, value as score,
  case when event_type = 'error' then 1 else 0 end as label from events
"""


def labelled_docs(spark: SparkSession, sf_dir: str, target: str = "toxic") -> DataFrame:
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return d.join(lab, "doc_id").select(F.col("doc_id").alias("row_id"), "text", "lang", "source", "n_chars",
                                       "quality", "toxic", F.col(target).alias("label"))


def labelled_docs_sql(target: str = "toxic") -> str:
    return f"""
select d.doc_id as row_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, l.{target} as label
from documents d join labels l on l.doc_id = d.doc_id
"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("vec"),
                    F.col("label").alias("digit"),
                    F.when(F.col("label") >= 5, 1).otherwise(0).alias("label"))


VECTORS_SQL = """
select vec_id as row_id, cast(embedding as double[]) as vec, label as digit,
  case when label >= 5 then 1 else 0 end as label from embeddings
"""
