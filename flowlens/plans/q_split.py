"""Queries: exact splits, samples, folds and batches."""

from __future__ import annotations

from flowlens.operators import split as S
from flowlens.plans import fixtures as fx
from flowlens.plans import sqlgen as sg
from flowlens.plans.catalog import query

LF = f"with lf as ({fx.LABELLED_FLOWS_SQL})"
SEED = 42


@query("stratified_split", sql=LF + "," + sg.split_ctes("lf", "label", "0.2", SEED) + "\nselect row_id, label, split from sp")
def stratified_split(spark, sf):
    df = fx.flows_table(spark, sf, labelled=True).select("row_id", "label")
    return S.stratified_split(df, "row_id", "label", "0.2", SEED)


@query("random_split", sql=LF + "," + sg.split_ctes("lf", None, "0.2", SEED) + "\nselect row_id, split from sp")
def random_split(spark, sf):
    return S.random_split(fx.flows_table(spark, sf, labelled=True).select("row_id"), "row_id", "0.2", SEED)


def _sample_sql(frac="0.035"):
    f = sg.frac(frac)
    return LF + f""",
n as (select count(*) as n from lf),
k as (select n * {f.numerator} // {f.denominator} as q, n * {f.numerator} % {f.denominator} as r from n),
kk as (select q + case when 2 * r > {f.denominator} or (2 * r = {f.denominator} and q % 2 = 1) then 1 else 0 end as keep from k),
rk as (select row_id, attack_type, row_number() over (order by {sg.h(SEED)}, row_id) as rn from lf)
select row_id, attack_type from rk cross join kk where rn <= keep"""


@query("sample_fraction", sql=_sample_sql())
def sample_fraction(spark, sf):
    df = fx.flows_table(spark, sf, labelled=True).select("row_id", "attack_type")
    return S.sample_fraction(df, "row_id", "0.035", SEED)


@query("exact_quota_rank", sql=LF + f"""
select row_id, label, row_number() over (partition by label order by {sg.h(SEED)}, row_id) as rank,
  count(*) over (partition by label) as class_n from lf""")
def exact_quota_rank(spark, sf):
    return S.exact_quota_rank(fx.flows_table(spark, sf, labelled=True).select("row_id", "label"), "row_id", "label", SEED)


def _folds_sql(k=5, label="attack_type"):
    def upto(m, i):
        return f"(({m}) - {i} + {k - 1}) // {k}"
    bounds = []
    acc = []
    for i in range(k - 1):
        acc.append(f"({upto('s + c', i)} - {upto('s', i)})")
        bounds.append(f"{' + '.join(acc)} as b{i}")
    fold = " + ".join(f"case when r > b{i} then 1 else 0 end" for i in range(k - 1))
    return LF + f""",
cs as (select {label} as cls, count(*) as c, min(row_id) as fk from lf group by {label}),
cs2 as (select cls, c, coalesce(sum(c) over (order by fk rows between unbounded preceding and 1 preceding), 0) as s from cs),
bd as (select cls, {', '.join(bounds)} from cs2),
rk as (select row_id, {label}, row_number() over (partition by {label} order by row_id) as r from lf)
select rk.row_id, rk.{label}, cast({fold} as int) as fold from rk join bd on bd.cls = rk.{label}"""


@query("stratified_folds", sql=_folds_sql())
def stratified_folds(spark, sf):
    df = fx.flows_table(spark, sf).select("row_id", "attack_type")
    return S.stratified_folds(df, "row_id", "attack_type", 5)


@query("shuffle_batches", sql=LF + f"""
select row_id, cast((row_number() over (order by {sg.h(SEED * 1000003)}, row_id) - 1) // 32 as bigint) as batch from lf""")
def shuffle_batches(spark, sf):
    return S.shuffle_batches(fx.flows_table(spark, sf, labelled=True).select("row_id"), "row_id", 32, SEED, 0)
