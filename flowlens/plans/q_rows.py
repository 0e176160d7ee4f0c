"""Queries: row selection, projections, label rules, key joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.functions.exprs import rnd
from flowlens.operators import scale as S
from flowlens.operators.naive_bayes import bernoulli_nb, gaussian_nb
from flowlens.plans import fixtures as fx
from flowlens.plans import sqlgen as sg
from flowlens.plans.catalog import query
from flowlens.plans.common import bnb_sql
from flowlens.plans.q_models import FEATS, GNB_PRED_SQL, _gnb_pred, scaled_parts

FL = f"with flows as ({fx.FLOWS_SQL})"
LF = f"with lf as ({fx.LABELLED_FLOWS_SQL})"
ALL = ", ".join(fx.FLOW_COLUMNS)


def head_n(df, n: int, key: str = "row_id"):
    """First n rows in key order (a bare limit is not deterministic)."""
    return df.orderBy(key).limit(n)


@query("head_n", sql=FL + f"\nselect {ALL} from flows order by row_id limit 10000")
def q_head_n(spark, sf):
    return head_n(fx.flows(spark, sf), 10000)


def drop_redundant(df, cols):
    return df.drop(*cols)


@query("drop_redundant", sql=FL + f"\nselect {', '.join(c for c in fx.FLOW_COLUMNS if c != 'always_zero')} from flows")
def q_drop_redundant(spark, sf):
    return drop_redundant(fx.flows(spark, sf), ["always_zero"])


def split_xy(df, target: str, key: str = "row_id"):
    """(features, target) by column name; the key stays on both sides."""
    return df.drop(target), df.select(key, target)


X_COLS = [c for c in fx.FLOW_COLUMNS if c != "attack_type"]


@query("split_xy", sql=FL + f"""
select 'x' as part, {', '.join(X_COLS)}, cast(null as varchar) as attack_type from flows
union all select 'y', row_id, {', '.join('null' for _ in X_COLS[1:])}, attack_type from flows""")
def q_split_xy(spark, sf):
    """Both halves, tagged: the feature rows and the (key, target) rows."""
    x, y = split_xy(fx.flows(spark, sf), "attack_type")
    return (x.withColumn("part", F.lit("x")).unionByName(y.withColumn("part", F.lit("y")), allowMissingColumns=True)
            .select("part", *X_COLS, "attack_type"))


def label_last(df, target: str):
    return df.select(*[c for c in df.columns if c != target], target)


@query("label_last", sql=LF + f"\nselect {ALL}, label from lf")
def q_label_last(spark, sf):
    return label_last(fx.labelled_flows(spark, sf), "label")


@query("binarize_equals", sql=FL + "\nselect row_id, attack_type, case when attack_type = 'normal' then 0 else 1 end as label from flows")
def q_binarize_equals(spark, sf):
    return L.binarize_equals(fx.flows(spark, sf).select("row_id", "attack_type"), "attack_type", "normal")


@query("binarize_prefix", sql=FL + "\nselect row_id, service, case when starts_with(lower(service), 'auto') then 0 else 1 end as label from flows")
def q_binarize_prefix(spark, sf):
    return L.binarize_prefix(fx.flows(spark, sf).select("row_id", "service"), "service", "AUTO")


@query("decode_label", sql=LF + "\nselect row_id, label, case when label = 0 then 'normal' else 'anomaly' end as label_name from lf")
def q_decode_label(spark, sf):
    return L.decode_label(fx.labelled_flows(spark, sf).select("row_id", "label"))


@query("cast_binary", sql=FL + "\nselect row_id, cast(balance < 0 as int) as in_debt, cast(max_discount > 0.05 as int) as big_discount, "
       "cast(n_lines as int) as n_lines from flows")
def q_cast_binary(spark, sf):
    df = fx.flows(spark, sf).select("row_id", (F.col("balance") < 0).alias("in_debt"),
                                    (F.col("max_discount") > 0.05).alias("big_discount"), "n_lines")
    return L.cast_binary(df, ["in_debt", "big_discount", "n_lines"])


@query("class_subset", sql=FL + f"\nselect {ALL} from flows where attack_type = 'flood'")
def q_class_subset(spark, sf):
    return L.class_subset(fx.flows(spark, sf), "attack_type", "flood")


@query("threshold", sql=f"""with se as ({fx.SCORED_EVENTS_SQL}),
st as (select min(score) as lo, max(score) as hi from se),
s as (select row_id, label, (score - lo) / (case when hi = lo then 1e0 else hi - lo end) as score from se cross join st)
select row_id, label, {sg.r('score')} as score, case when score > 0.5 then 1 else 0 end as pred from s""")
def q_threshold(spark, sf):
    se = S.score_minmax(fx.scored_events(spark, sf).select("row_id", "label", "score"), "score")
    return L.threshold(se, "score", 0.5).select("row_id", "label", rnd("score").alias("score"), "pred")


@query("mispredicted", sql=GNB_PRED_SQL + "\nselect row_id, label, pred from nb where pred <> label")
def q_mispredicted(spark, sf):
    return L.mispredicted(_gnb_pred(spark, sf))


def combine_scores(a, b, key: str = "row_id"):
    """Bring two scorers' outputs together by key; a key that only one of them has fails the job
    (the reference refuses score lists of different length)."""
    here, there = F.lit(True).alias("__a"), F.lit(True).alias("__b")
    both = a.select("*", here).join(b.select("*", there), key, "full")
    alone = F.raise_error(F.concat(F.lit("scored by one scorer only: "), F.col(key).cast("string"))).cast("boolean")
    ok = F.when(F.col("__a").isNull() | F.col("__b").isNull(), alone).otherwise(F.lit(True))
    return both.where(ok).drop("__a", "__b")


@query("combine_scores", sql=GNB_PRED_SQL + ",\n" + bnb_sql("tr", "te", FEATS)
       + "\nselect nb.row_id, nb.label, nb.pred as pred_gaussian, bp.pred as pred_bernoulli from nb join bp on bp.row_id = nb.row_id")
def q_combine_scores(spark, sf):
    train, test = scaled_parts(spark, sf)
    g = gaussian_nb(train, test, FEATS).withColumnRenamed("pred", "pred_gaussian")
    b = bernoulli_nb(train, test, FEATS).select("row_id", F.col("pred").alias("pred_bernoulli"))
    return combine_scores(g, b)
