"""Queries: profiling and aggregations, set operations (2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.exprs import rnd
from flowlens.operators import profile as P
from flowlens.operators import quantile_sketch as QS
from flowlens.plans import fixtures as fx
from flowlens.plans import sqlgen as sg
from flowlens.plans.catalog import query

FL = f"with flows as ({fx.FLOWS_SQL})"
NUM = fx.FLOW_NUMERIC
CAT = fx.FLOW_CATEGORICAL


def _union(cols, body):
    return "\nunion all\n".join(body(c) for c in cols)


@query("label_distribution", sql=FL + "\nselect attack_type, count(*) as n from flows group by attack_type")
def label_distribution(spark, sf):
    return P.label_distribution(fx.flows(spark, sf), "attack_type")


@query("label_share", sql=f"""with lf as ({fx.LABELLED_FLOWS_SQL}),
c as (select label, count(*) as n from lf group by label),
t as (select label, n * 100 as prod, sum(n) over () as tot from c),
u as (select label, prod, tot, floor(prod / tot) as q from t)
select label, cast((q + case when 2 * (prod - q * tot) > tot or (2 * (prod - q * tot) = tot and q % 2 = 1)
  then 1 else 0 end) / 100e0 as double) as share from u""")
def label_share(spark, sf):
    return P.label_share(fx.labelled_flows(spark, sf), "label", 2)


@query("category_cardinality", sql=FL + "\n" + _union(
    CAT + ["attack_type"], lambda c: f"select '{c}' as column, count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as n_distinct from flows"))
def category_cardinality(spark, sf):
    return P.category_cardinality(fx.flows(spark, sf), CAT + ["attack_type"])


@query("top_categories", sql=FL + "\nselect service, count(*) as n from flows group by service order by n desc, service asc limit 5")
def top_categories(spark, sf):
    return P.top_categories(fx.flows(spark, sf), "service", 5)


@query("describe", sql=FL + "\n" + _union(NUM, lambda c: f"""select '{c}' as column, count({c}) as count,
  {sg.r(f'avg({c})')} as mean, {sg.r(f'stddev_samp({c})')} as std, {sg.r(f'min({c})')} as min,
  {sg.r(f'quantile_cont({c}, 0.25)')} as q25, {sg.r(f'quantile_cont({c}, 0.5)')} as q50,
  {sg.r(f'quantile_cont({c}, 0.75)')} as q75, {sg.r(f'max({c})')} as max from flows"""))
def describe(spark, sf):
    return P.describe(fx.flows_table(spark, sf), NUM)


# The sketch's answers differ between runs within its bound, so SQL states the exact columns and the bound
SKETCH_PROBS = [0.01, 0.25, 0.5, 0.75, 0.99]


@query("quantile_sketch", sql=FL + "\n" + _union(
    [(c, p) for c in NUM + fx.FLOW_CONSTANT for p in SKETCH_PROBS], lambda cp: f"""select '{cp[0]}' as column, {cp[1]}e0 as p,
  count({cp[0]}) as n, {sg.r(f'avg({cp[0]})')} as mean, {sg.r(f'min({cp[0]})')} as min, {sg.r(f'max({cp[0]})')} as max,
  true as within_bound from flows"""))
def quantile_sketch(spark, sf):
    """States per protocol, merged, asked for five quantiles, whose ranks a second pass audits."""
    df, cols = fx.flows_table(spark, sf), NUM + fx.FLOW_CONSTANT
    merged = QS.merge(QS.states(df, cols, by=["protocol"]))
    audited = QS.rank_errors(df, QS.quantiles(merged, SKETCH_PROBS))
    return audited.select("column", "p", "n", *[rnd(c, 6).alias(c) for c in ("mean", "min", "max")],
                          (F.col("rank_error") <= F.lit(QS.rank_bound(QS.DEFAULT_K))).alias("within_bound"))


@query("distinct_values", sql=FL + "\nselect distinct protocol from flows")
def distinct_values(spark, sf):
    return P.distinct_values(fx.flows(spark, sf), "protocol")


@query("shape", sql=FL + f"\nselect count(*) as n_rows, cast({len(fx.FLOW_COLUMNS)} as bigint) as n_cols from flows")
def shape(spark, sf):
    return P.shape(fx.flows(spark, sf))


CONST_CANDIDATES = fx.FLOW_BINARY + fx.FLOW_CONSTANT + NUM + CAT


@query("constant_columns", sql=FL + '\nselect "column" from (' + _union(
    CONST_CANDIDATES, lambda c: f"select '{c}' as column, min({c}) is not distinct from max({c}) as k from flows") + ") x where k")
def constant_columns(spark, sf):
    return P.constant_columns(fx.flows(spark, sf), CONST_CANDIDATES)


@query("batch_stats", sql=FL + ",\nlong as (" + _union(NUM, lambda c: f"select cast({c} as double) as v from flows")
       + f")\nselect {sg.r('min(v)')} as min, {sg.r('max(v)')} as max, {sg.r('stddev_samp(v)')} as std, count(v) as n_cells from long")
def batch_stats(spark, sf):
    return P.batch_stats(fx.flows(spark, sf), NUM)


@query("label_counter", sql=f"with lf as ({fx.LABELLED_FLOWS_SQL})\nselect label, count(*) as n from lf group by label")
def label_counter(spark, sf):
    return P.label_counter(fx.labelled_flows(spark, sf), "label")


@query("histogram_by_label", sql=f"""with se as ({fx.SCORED_EVENTS_SQL}),
rg as (select event_type, min(score) as lo, max(score) as hi, (max(score) - min(score)) / 10e0 as w from se group by event_type),
c as (select se.event_type, cast(case when rg.w = 0 then 0 else least(floor((se.score - rg.lo) / rg.w), 9) end as int) as bin,
  count(*) as n from se join rg on rg.event_type = se.event_type where se.score is not null group by all),
g as (select event_type, lo, hi, w, cast(unnest(range(0, 10)) as int) as bin from rg)
select g.event_type, g.bin, {sg.r('g.lo + g.bin * g.w')} as lo,
  {sg.r('case when g.bin = 9 then g.hi else g.lo + (g.bin + 1) * g.w end')} as hi,
  cast(coalesce(c.n, 0) as bigint) as n
from g left join c on c.event_type = g.event_type and c.bin = g.bin""")
def histogram_by_label(spark, sf):
    return P.histogram_by_label(fx.scored_events(spark, sf), "score", "event_type", 10)


@query("density_by_label", sql=f"""with se as ({fx.SCORED_EVENTS_SQL}),
st as (select label, count(*) as n, stddev_samp(score) as sd, min(score) as mn, max(score) as mx from se
  where score is not null group by label),
st2 as (select *, pow(cast(n as double), -0.2) * sd as h from st),
st3 as (select *, mn - 3e0 * h as a, mx + 3e0 * h as b from st2 where h > 0),
dv as (select label, score as x, count(*) as c from se where score is not null group by all),
pts as (select dv.label, dv.x, dv.c, st3.n, st3.h, st3.a, st3.b, unnest(range(0, 200)) as i from dv join st3 on st3.label = dv.label),
agg as (select label, i, sum(c * exp(-0.5 * ((a + (b - a) * i / 199e0 - x) / h) * ((a + (b - a) * i / 199e0 - x) / h))) as s,
  any_value(n) as n, any_value(h) as h, any_value(a) as a, any_value(b) as b from pts group by label, i)
select label, cast(i as int) as i, {sg.r('a + (b - a) * i / 199e0', 9)} as x,
  {sg.r('s / (n * h * sqrt(2 * pi()))', 9)} as density from agg""")
def density_by_label(spark, sf):
    return P.density_by_label(fx.scored_events(spark, sf), "score", "label", 200)


@query("density_binned", sql=f"""with se as ({fx.SCORED_EVENTS_SQL}),
st as (select label, count(*) as n, stddev_samp(score) as sd, min(score) as mn, max(score) as mx from se
  where score is not null group by label),
st2 as (select *, pow(cast(n as double), -0.2) * sd as h from st),
st3 as (select *, mn - 3e0 * h as a, mx + 3e0 * h as b from st2 where h > 0),
u as (select se.label, (se.score - a) / (0.002e0 * h) as pos from se join st3 on st3.label = se.label where se.score is not null),
bins as (select label, cast(floor(pos) as bigint) as k, count(*) as m, sum(pos - floor(pos)) as f from u group by all),
bd as (select label, k, m - f as c from bins union all select label, k + 1, f from bins),
dv as (select label, k, sum(c) as c from bd group by all),
pts as (select dv.label, a + cast(k as double) * (0.002e0 * h) as x, dv.c, st3.n, st3.h, st3.a, st3.b,
  unnest(range(0, 200)) as i from dv join st3 on st3.label = dv.label),
agg as (select label, i, sum(c * exp(-0.5 * ((a + (b - a) * i / 199e0 - x) / h) * ((a + (b - a) * i / 199e0 - x) / h))) as s,
  any_value(n) as n, any_value(h) as h, any_value(a) as a, any_value(b) as b from pts group by label, i)
select label, cast(i as int) as i, {sg.r('a + (b - a) * i / 199e0', 9)} as x,
  {sg.r('s / (n * h * sqrt(2 * pi()))', 9)} as density, {sg.r('0.0000005e0 / (h * sqrt(2 * pi()))', 12)} as error_bound from agg""")
def density_binned(spark, sf):
    return P.density_binned(fx.scored_events(spark, sf), "score", "label", 200)


# Set operations: a price-band category (total // 100, a few thousand values, rare at the
# top) compared between the two sides of the exact 80/20 split of flows.
def _bands(spark, sf):
    from flowlens.plans.common import split_flows
    sp = split_flows(spark, sf).select("split", F.floor(F.col("total") / 100).cast("bigint").alias("band"))
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


def _bands_sql():
    from flowlens.plans.common import split_flows_sql
    return split_flows_sql() + """,
b as (select split, cast(floor(total / 100) as bigint) as band from sp),
tr as (select * from b where split = 'train'), te as (select * from b where split = 'test')"""


@query("missing_categories", sql=_bands_sql() + "\nselect distinct band from tr where band not in (select band from te)")
def missing_categories(spark, sf):
    tr, te = _bands(spark, sf)
    return P.missing_categories(tr, te, "band")


@query("unseen_categories", sql=_bands_sql() + "\nselect distinct band from te where band not in (select band from tr)")
def unseen_categories(spark, sf):
    tr, te = _bands(spark, sf)
    return P.unseen_categories(tr, te, "band")


@query("auto_histogram_by_label", sql=f"""with se as ({fx.SCORED_EVENTS_SQL}),
st as (select event_type, count(*) as n, min(score) as lo, max(score) as hi, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) as q
  from se where score is not null group by event_type),
w as (select *, (hi - lo) / (log2(cast(n as double)) + 1) as sw, 2 * q / pow(cast(n as double), 1e0 / 3) as fw from st),
b as (select event_type, lo, hi, cast(case when hi = lo then 1 else ceil((hi - lo) / least(greatest(fw, (hi - lo) / sqrt(cast(n as double)) / 2), sw)) end as bigint) as bins from w),
r as (select event_type, bins, case when hi = lo then lo - 0.5 else lo end as lo, case when hi = lo then hi + 0.5 else hi end as hi from b),
c as (select se.event_type, cast(least(floor((score - lo) / (hi - lo) * bins), bins - 1) as bigint) as bin, count(*) as n
  from se join r on r.event_type = se.event_type where score is not null group by all),
g as (select *, unnest(range(bins)) as bin from r)
select g.event_type, g.bin, {sg.r('lo + g.bin * ((hi - lo) / bins)')} as lo,
  {sg.r('case when g.bin = bins - 1 then hi else lo + (g.bin + 1) * ((hi - lo) / bins) end')} as hi, cast(coalesce(c.n, 0) as bigint) as n
from g left join c on c.event_type = g.event_type and c.bin = g.bin""")
def auto_histogram_by_label(spark, sf):
    from flowlens.operators.auto_bins import auto_histogram
    return auto_histogram(fx.scored_events(spark, sf), "score", "event_type")
