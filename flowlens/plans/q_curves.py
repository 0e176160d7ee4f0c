"""Queries: ROC / PR points, AUROC, average precision on scored events."""

from __future__ import annotations

from flowlens.operators import curves as C
from flowlens.plans import fixtures as fx
from flowlens.plans import sqlgen as sg
from flowlens.plans.catalog import query

CUM_SQL = f"""with se as ({fx.SCORED_EVENTS_SQL}),
st as (select cast(score as double) as score, cast(sum(case when label = 1 then 1 else 0 end) as bigint) as pos,
  cast(sum(case when label = 1 then 0 else 1 end) as bigint) as neg from se where score is not null group by score),
tot as (select sum(pos) as p, sum(neg) as n from st),
cum as (select score, pos, neg,
  sum(pos) over (order by score desc rows between unbounded preceding and current row) as tp,
  sum(neg) over (order by score desc rows between unbounded preceding and current row) as fp from st)"""


@query("roc_points", sql=CUM_SQL + f""",
nb as (select *, lag(tp) over (order by score desc) as tp_p, lead(tp) over (order by score desc) as tp_n,
  lag(fp) over (order by score desc) as fp_p, lead(fp) over (order by score desc) as fp_n from cum)
select cast(null as double) as threshold, 0e0 as fpr, 0e0 as tpr
union all
select score as threshold, {sg.r(sg.sdiv('fp', 'tot.n', 'null'))} as fpr, {sg.r(sg.sdiv('tp', 'tot.p', 'null'))} as tpr
from nb cross join tot
where tp_p is null or tp_n is null or (tp_n - 2 * tp + tp_p) <> 0 or (fp_n - 2 * fp + fp_p) <> 0""")
def roc_points(spark, sf):
    return C.roc_points(fx.scored_events(spark, sf))


@query("pr_points", sql=CUM_SQL + f"""
select score as threshold, {sg.r(sg.sdiv('tp', 'tp + fp'))} as precision, {sg.r(sg.sdiv('tp', 'tot.p', '1e0'))} as recall
from cum cross join tot
union all
select cast(null as double), 1e0, 0e0""")
def pr_points(spark, sf):
    return C.pr_points(fx.scored_events(spark, sf))


@query("auroc", sql=CUM_SQL + f"""
select {sg.r('sum(pos * ((tot.n - fp) + neg / 2e0)) / (tot.p * tot.n)')} as auroc,
  cast(any_value(tot.p) as bigint) as n_pos, cast(any_value(tot.n) as bigint) as n_neg
from cum cross join tot group by tot.p, tot.n""")
def auroc(spark, sf):
    return C.auroc(fx.scored_events(spark, sf))


@query("average_precision", sql=CUM_SQL + f"""
select {sg.r('sum(pos / cast(tot.p as double) * (cast(tp as double) / (tp + fp)))')} as average_precision
from cum cross join tot group by tot.p""")
def average_precision(spark, sf):
    return C.average_precision(fx.scored_events(spark, sf))
