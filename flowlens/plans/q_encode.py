"""Queries: encoders, scalers, correlation and reduction."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.exprs import rnd
from flowlens.operators import encode as E
from flowlens.operators import scale as S
from flowlens.plans import fixtures as fx
from flowlens.plans import sqlgen as sg
from flowlens.plans.catalog import query
from flowlens.plans.common import split_flows, split_flows_sql

FL = f"with flows as ({fx.FLOWS_SQL})"
CAT = fx.FLOW_CATEGORICAL
NUM = fx.FLOW_NUMERIC

# Values of the TPC-H dimension columns behind the categorical flow features (fixed values)
CATEGORY_VALUES = {
    "protocol": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "service": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "flag": ["0", "1", "2", "3", "4"],
}


def _codes_sql(cols, src="flows", keep="row_id"):
    parts = ", ".join(f"cast(dense_rank() over (order by {c}) - 1 as int) as {c}" for c in cols)
    return f"select {keep}, {parts} from {src}"


@query("label_encode", sql=FL + "\n" + _codes_sql(CAT))
def label_encode(spark, sf):
    df = fx.flows(spark, sf).select("row_id", *CAT)
    return E.apply_label_encode(df, E.fit_label_encode(df, CAT))


@query("label_encode_target", sql=FL + "\n" + _codes_sql(["attack_type"]))
def label_encode_target(spark, sf):
    df = fx.flows(spark, sf).select("row_id", "attack_type")
    return E.apply_label_encode(df, E.fit_label_encode(df, ["attack_type"]))


@query("sorted_categories", sql=FL + "\nselect service as value, cast(row_number() over (order by service) - 1 as int) as code "
       "from (select distinct service from flows) d")
def sorted_categories(spark, sf):
    return E.sorted_categories(fx.flows(spark, sf), "service")


@query("encode_lookup", sql=FL + "\nselect row_id, service, cast(dense_rank() over (order by service) - 1 as int) as service_code from flows")
def encode_lookup(spark, sf):
    df = fx.flows(spark, sf).select("row_id", "service")
    return E.encode_lookup(df, "service", E.fit_label_encode(df, ["service"]))


def _dummies_sql(cols, values=CATEGORY_VALUES):
    out = []
    for c in cols:
        for v in values[c]:
            out.append(f"cast(case when {c} = '{v}' then 1 else 0 end as double) as \"{c}_{v}\"")
    return ", ".join(out)


@query("one_hot", sql=FL + f"\nselect row_id, {_dummies_sql(CAT)} from flows")
def one_hot(spark, sf):
    df = fx.flows(spark, sf).select("row_id", *CAT)
    return E.one_hot(df, E.fit_one_hot(df, CAT))


@query("one_hot_sparse", sql="""with et as (select event_type as v, row_number() over (order by event_type) - 1 as code
  from (select distinct event_type from events where event_type is not null) x),
u as (select v, row_number() over (order by v) - 1 as code
  from (select distinct cast(user_id as varchar) as v from events where user_id is not null) x),
n as (select (select count(*) from et) as n_et, (select count(*) from u) as n_u)
select event_id, cast(n_et + n_u as bigint) as size, concat_ws(',', et.code, u.code + n_et) as ones
from events e cross join n left join et on et.v = e.event_type left join u on u.v = cast(e.user_id as varchar)""")
def one_hot_sparse(spark, sf):
    """Positions of the ones of each event's type and user, whose dictionary grows with the table."""
    from flowlens.sources.tables import read_table
    cols = ["event_type", "user_id"]
    ev = read_table(spark, sf, "events", "event_id", *cols)
    out = E.one_hot_sparse(ev, E.fit_one_hot(ev, cols), cols)
    return out.select("event_id", F.col("one_hot.size").alias("size"),
                      F.array_join(F.col("one_hot.ones").cast("array<string>"), ",").alias("ones"))


@query("one_hot_align", sql=split_flows_sql() + f"\nselect row_id, {_dummies_sql(CAT)} from sp where split = 'test'")
def one_hot_align(spark, sf):
    sp = split_flows(spark, sf)
    fit = E.fit_one_hot(sp.where(F.col("split") == "train"), CAT)          # train dictionary only
    return E.one_hot_align(sp.where(F.col("split") == "test").select("row_id", *CAT), fit)


@query("dummies_of_object_cols", sql=FL + f"\nselect row_id, {_dummies_sql(['protocol', 'service'])} from flows")
def dummies_of_object_cols(spark, sf):
    return E.dummies_of_object_cols(fx.flows(spark, sf).select("row_id", "protocol", "service"))


@query("attach_encoded", sql=FL + f"\nselect row_id, {', '.join(NUM)}, {_dummies_sql(CAT)} from flows")
def attach_encoded(spark, sf):
    raw = fx.flows_table(spark, sf).select("row_id", *CAT, *NUM)        # both sides of the key join read it
    enc = E.one_hot(raw.select("row_id", *CAT), E.fit_one_hot(raw, CAT))
    return E.attach_encoded(raw, enc, "row_id", CAT)


def _scaled_cols(df, cols, digits=6):
    return df.select("row_id", *[rnd(c, digits).alias(c) for c in cols])


@query("standard_scale", sql=split_flows_sql() + f""",
st as (select {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in NUM)} from sp where split = 'train')
select row_id, {', '.join(sg.r(f'(cast({c} as double) - m_{c}) / (case when s_{c} = 0 then 1e0 else s_{c} end)') + f' as {c}' for c in NUM)}
from sp cross join st where split = 'test'""")
def standard_scale(spark, sf):
    sp = split_flows(spark, sf)
    fit = S.fit_standard_scale(sp.where(F.col("split") == "train"), NUM)
    return _scaled_cols(S.apply_standard_scale(sp.where(F.col("split") == "test"), fit), NUM)


@query("zscore_sample", sql=FL + f""",
st as (select {', '.join(f'avg({c}) as m_{c}, stddev_samp({c}) as s_{c}' for c in NUM)} from flows)
select row_id, {', '.join(sg.r(f'(cast({c} as double) - m_{c}) / (case when s_{c} = 0 then 1e0 else s_{c} end)') + f' as {c}' for c in NUM)}
from flows cross join st""")
def zscore_sample(spark, sf):
    df = fx.flows(spark, sf)
    return _scaled_cols(S.apply_zscore_sample(df, S.fit_zscore_sample(df, NUM)), NUM)


@query("minmax_scale", sql=split_flows_sql() + f""",
st as (select {', '.join(f'min({c}) as lo_{c}, max({c}) as hi_{c}' for c in NUM)} from sp where split = 'train')
select row_id, {', '.join(sg.r(f'(cast({c} as double) - lo_{c}) / (case when hi_{c} = lo_{c} then 1e0 else hi_{c} - lo_{c} end)') + f' as {c}' for c in NUM)}
from sp cross join st where split = 'test'""")
def minmax_scale(spark, sf):
    sp = split_flows(spark, sf)
    fit = S.fit_minmax_scale(sp.where(F.col("split") == "train"), NUM)
    return _scaled_cols(S.apply_minmax_scale(sp.where(F.col("split") == "test"), fit), NUM)


@query("score_minmax", sql=f"""with se as ({fx.SCORED_EVENTS_SQL}),
st as (select min(score) as lo, max(score) as hi from se)
select row_id, label, {sg.r('(score - lo) / (case when hi = lo then 1e0 else hi - lo end)')} as score from se cross join st""")
def score_minmax(spark, sf):
    se = fx.scored_events(spark, sf).select("row_id", "label", "score")
    out = S.score_minmax(se, "score")
    return out.select("row_id", "label", rnd("score").alias("score"))


SPEARMAN_COLS = NUM + fx.FLOW_CONSTANT


def _spearman_sql():
    cols = SPEARMAN_COLS
    ranks = ", ".join(
        f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2e0 as r_{c}" for c in cols)
    pairs = []
    for a in cols:
        for b in cols:
            pairs.append(f"select '{a}' as a, '{b}' as b, {sg.r(f'case when isnan(corr(r_{a}, r_{b})) then null else corr(r_{a}, r_{b}) end')} as rho from rk")
    return FL + f",\nrk as (select {ranks} from flows)\n" + "\nunion all\n".join(pairs)


@query("spearman_matrix", sql=_spearman_sql())
def spearman_matrix(spark, sf):
    return E.spearman_matrix(fx.flows_table(spark, sf), SPEARMAN_COLS, "row_id")


@query("sorted_correlations", sql="select * from (" + _spearman_sql() + ") m where a < b order by rho desc nulls last, a, b")
def sorted_correlations(spark, sf):
    return E.sorted_correlations(E.spearman_matrix(fx.flows_table(spark, sf), SPEARMAN_COLS, "row_id"))


@query("average_rank", sql=FL + "\n" + "\nunion all\n".join(
    f"select row_id, '{c}' as \"column\", cast({c} as double) as value, "
    f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2e0 as rank from flows" for c in NUM))
def average_rank(spark, sf):
    return E.average_rank(fx.flows_table(spark, sf), NUM, "row_id")


# ---------------------------------------------------------------- PCA on the 64-d vectors

DIM = 64


def _vector_parts(spark, sf):
    """Vectors split 80/20 (exact, stratified by the binary label), min-max scaled per
    dimension with the train ranges: (train, test) with ``vec`` array<double>."""
    from flowlens.operators import vectors as V
    from flowlens.operators.split import stratified_split
    from flowlens.plans.common import materialize
    sp = materialize(stratified_split(fx.vectors(spark, sf), "row_id", "label", "0.2", 42), "vectors-split")
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    mm = V.fit_minmax_vec(train)
    return V.apply_minmax_vec(train, mm), V.apply_minmax_vec(test, mm)


@query("pca_fit_apply")
def pca_fit_apply(spark, sf):
    """Full PCA on the min-max scaled train vectors, centred projections of the test vectors."""
    train, test = _vector_parts(spark, sf)
    fit = E.fit_pca_vec(train, "vec")
    return E.apply_pca_vec(test, fit, "vec", keep=("row_id", "label"))


@query("cumulative_variance")
def cumulative_variance(spark, sf):
    train, _ = _vector_parts(spark, sf)
    return E.cumulative_variance(E.pca_variance_frame(spark, E.fit_pca_vec(train, "vec")))


@query("latent_dim")
def latent_dim(spark, sf):
    train, _ = _vector_parts(spark, sf)
    return E.latent_dim(E.cumulative_variance(E.pca_variance_frame(spark, E.fit_pca_vec(train, "vec"))), 0.90)
