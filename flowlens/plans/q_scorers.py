"""Queries: one-class scorers, blend, blend accuracy on the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import metrics as M
from flowlens.operators import scorers as SC
from flowlens.plans import fixtures as fx
from flowlens.plans import sqlgen as sg
from flowlens.plans.catalog import query
from flowlens.plans.q_encode import DIM, _vector_parts



def _scaled_vectors_sql() -> str:
    """CTEs: vx (columns x0..), sp (split), mm (train min/max), sv (scaled, with split)."""
    cols = ", ".join(f"vec[{i + 1}] as x{i}" for i in range(DIM))
    mm = ", ".join(f"min(x{i}) as lo{i}, max(x{i}) as hi{i}" for i in range(DIM))
    sc = ", ".join(f"(x{i} - lo{i}) / (case when hi{i} = lo{i} then 1e0 else hi{i} - lo{i} end) as x{i}" for i in range(DIM))
    return (f"with v0 as ({fx.VECTORS_SQL}),\nvx as (select row_id, label, {cols} from v0),"
            + sg.split_ctes("vx", "label", "0.2", 42)
            + f",\nmm as (select {mm} from sp where split = 'train'),\nsv as (select row_id, label, split, {sc} from sp cross join mm)")


def _fit_sql(name: str, cls: int) -> str:
    stats = ", ".join(f"avg(x{i}) as m{i}, var_pop(x{i}) as v{i}" for i in range(DIM))
    floor = "greatest(" + ", ".join(f"var_pop(x{i})" for i in range(DIM)) + ")"
    return f"{name} as (select {stats}, case when {floor} > 0 then 1e-9 * {floor} else 1e-9 end as eps from sv where split = 'train' and label = {cls})"


def _dist_sql(fit: str, sign: str) -> str:
    const = " + ".join(f"0.5 * ln(2 * pi() * ({fit}.v{i} + {fit}.eps))" for i in range(DIM))
    quad = " + ".join(f"(t.x{i} - {fit}.m{i}) * (t.x{i} - {fit}.m{i}) / ({fit}.v{i} + {fit}.eps)" for i in range(DIM))
    return f"{sign} * (({const}) + 0.5 * ({quad}))"


def _blend_sql() -> str:
    return _scaled_vectors_sql() + ",\n" + _fit_sql("fb", 0) + ",\n" + _fit_sql("fa", 1) + f""",
raw as (select t.row_id, t.label, {_dist_sql('fb', '1e0')} as sb, {_dist_sql('fa', '-1e0')} as sa
  from (select * from sv where split = 'test') t cross join fb cross join fa),
rg as (select min(sb) as lb, max(sb) as hb, min(sa) as la, max(sa) as ha from raw),
nrm as (select row_id, label, (sb - lb) / (case when hb = lb then 1e0 else hb - lb end) as sb,
  (sa - la) / (case when ha = la then 1e0 else ha - la end) as sa from raw cross join rg),
bl as (select *, (1.5 * sb + 0.5 * sa) / 2e0 as blend from nrm),
pr as (select row_id, label, {sg.r('sb')} as score_benign, {sg.r('sa')} as score_anomaly, {sg.r('blend')} as blend,
  case when blend > 0.5 then 1 else 0 end as pred from bl)"""


@query("one_class_scorer", sql=_scaled_vectors_sql() + ",\n" + _fit_sql("fb", 0) + f"""
select t.row_id, t.label, {sg.r(_dist_sql('fb', '1e0'))} as score from (select * from sv where split = 'test') t cross join fb""")
def one_class_scorer(spark, sf):
    """Benign-class scorer (fitted on label 0 train rows) applied to every test row."""
    from flowlens.functions.exprs import rnd
    train, test = _vector_parts(spark, sf)
    s = SC.one_class_scorer_vec(train.where(F.col("label") == 0), test, "vec", 1.0)
    return s.select("row_id", "label", rnd("score").alias("score"))


def _blend(spark, sf):
    train, test = _vector_parts(spark, sf)
    return SC.two_scorer_blend_vec(train, test, "vec")


@query("blend_scores", sql=_blend_sql() + "\nselect * from pr")
def blend_scores(spark, sf):
    return _blend(spark, sf)


@query("accuracy_of_blend", sql=_blend_sql() + f"""
select count(*) as n, {sg.r(sg.sdiv('sum(case when pred = label then 1 else 0 end)', 'count(*)'))} as accuracy from pr""")
def accuracy_of_blend(spark, sf):
    from flowlens.functions.exprs import rnd, safe_div
    b = _blend(spark, sf)
    right = F.sum(F.when(F.col("pred") == F.col("label"), 1).otherwise(0))
    return b.agg(F.count(F.lit(1)).alias("n"), rnd(safe_div(right, F.count(F.lit(1)))).alias("accuracy"))


@query("match_counts", sql=_blend_sql() + f"""
select cast(sum(case when pred = label then 1 else 0 end) as bigint) as n_right,
  cast(sum(case when pred = label then 0 else 1 end) as bigint) as n_wrong,
  {sg.r(sg.sdiv('sum(case when pred = label then 1 else 0 end)', 'count(*)'))} as accuracy from pr""")
def match_counts(spark, sf):
    return M.match_counts(_blend(spark, sf))


def _norms_sql() -> str:
    means = ", ".join(f"avg(x{i}) as m{i}" for i in range(DIM))
    square = " + ".join(f"(t.x{i} - c.m{i}) * (t.x{i} - c.m{i})" for i in range(DIM))
    return _scaled_vectors_sql() + f""",
c as (select {means} from sv where split = 'train')
select t.row_id, {sg.r(square, 4)} as square_norm from (select * from sv where split = 'test') t cross join c"""


@query("pca_row_norms", sql=_norms_sql())
def pca_row_norms(spark, sf):
    """All components together are a rotation: the projections of a row have the norm of the
    centred row itself, which SQL can state without an eigen-decomposition."""
    from flowlens.functions.exprs import rnd
    from flowlens.plans.q_encode import pca_fit_apply
    square = F.aggregate("pcs", F.lit(0.0), lambda acc, x: acc + x * x)
    return pca_fit_apply(spark, sf).select("row_id", rnd(square, 4).alias("square_norm"))


@query("pca_variance_total", sql="select 64 as components, 1e0 as total, true as descending")
def pca_variance_total(spark, sf):
    """The explained-variance ratios add up to 1 and never grow."""
    from flowlens.functions.exprs import rnd
    from pyspark.sql import Window
    from flowlens.plans.q_encode import cumulative_variance
    before = F.lag("ratio").over(Window.orderBy("component"))          # one row per dimension
    rows = cumulative_variance(spark, sf).withColumn("before", before)
    return rows.agg(F.count("*").cast("int").alias("components"), rnd(F.sum("ratio")).alias("total"),
                    F.bool_and(F.col("before").isNull() | (F.col("ratio") <= F.col("before") + 1e-12)).alias("descending"))


def _moments_sql() -> str:
    values = ", ".join(f"x{i}" for i in range(DIM))
    return _scaled_vectors_sql() + f""",
u as (select row_id, unnest([{values}]) as x, unnest(range({DIM})) as i from sv where split = 'train'),
m as (select i, avg(x) as m from u group by i),
z as materialized (select row_id, u.i, x - m as x from u join m on m.i = u.i),
c as materialized (select a.i, b.i as j, sum(a.x * b.x) / (count(*) - 1) as c from z a join z b on b.row_id = a.row_id group by a.i, b.i),
c2 as materialized (select a.i, b.j, sum(a.c * b.c) as c from c a join c b on b.i = a.j group by a.i, b.j)
select 1 as power, {sg.r('sum(c)', 8)} as moment from c where i = j union all select 2, {sg.r('sum(c * c)', 8)} from c
union all select 3, {sg.r('sum(c.c * c2.c)', 8)} from c join c2 on c2.i = c.i and c2.j = c.j union all select 4, {sg.r('sum(c * c)', 8)} from c2"""


@query("pca_moments", sql=_moments_sql())
def pca_moments(spark, sf):
    """Sums of powers of the eigenvalues, which SQL gets as traces of powers of the covariance matrix."""
    from flowlens.functions.exprs import rnd
    from flowlens.operators import pca as P
    train, _ = _vector_parts(spark, sf)
    values = P.fit(train, "vec")["eigenvalues"]
    rows = [(k, float((values ** k).sum())) for k in range(1, 5)]
    return spark.createDataFrame(rows, "power int, moment double").select("power", rnd("moment", 8).alias("moment"))


@query("pca_residuals", sql=f"select cast(unnest(range({DIM})) as int) as component, 0e0 as residual, true as ordered")
def pca_residuals(spark, sf):
    """|C v - eigenvalue * v| of each component in the 8th digit, C v summed over the rows once more, and
    whether the eigenvalues fall."""
    from flowlens.functions.exprs import rnd
    from flowlens.operators import pca as P
    train, _ = _vector_parts(spark, sf)
    fit = P.fit(train, "vec")
    values = fit["eigenvalues"].tolist()
    rows = [(i, float(r), i == 0 or values[i] <= values[i - 1]) for i, r in enumerate(P.residuals(train, fit, "vec"))]
    return spark.createDataFrame(rows, "component int, residual double, ordered boolean").withColumn("residual", rnd("residual", 8))


# ---------------------------------------------------------------- low-rank one-class scores

FIXED_RANK = 4


def _fixed_basis_sql() -> str:
    from flowlens.operators.low_rank import cosine_basis
    means = ", ".join(f"avg(x{i}) as m{i}" for i in range(DIM))
    square = " + ".join(f"(t.x{i} - c.m{i}) * (t.x{i} - c.m{i})" for i in range(DIM))
    dots = ", ".join("(" + " + ".join(f"({v!r}) * (t.x{i} - c.m{i})" for i, v in enumerate(row)) + f") as d{k}"
                     for k, row in enumerate(cosine_basis(DIM, FIXED_RANK).tolist()))
    left = " - ".join(["square", *[f"d{k} * d{k}" for k in range(FIXED_RANK)]])
    return _scaled_vectors_sql() + f""",
c as (select {means} from sv where split = 'train' and label = 0),
p as (select t.row_id, t.label, {square} as square, {dots} from (select * from sv where split = 'test') t cross join c)
select row_id, label, {sg.r(left)} as score from p"""


@query("low_rank_fixed_basis", sql=_fixed_basis_sql())
def low_rank_fixed_basis(spark, sf):
    """Distance of every test row from the benign mean plus four given components (cosine waves)."""
    from flowlens.functions.exprs import rnd
    from flowlens.operators import low_rank as L
    train, test = _vector_parts(spark, sf)
    fit = L.fit_with_basis(train.where(F.col("label") == 0), L.cosine_basis(DIM, FIXED_RANK))
    return L.score(test, {"score": fit}).withColumn("score", rnd("score"))


@query("low_rank_blend")
def low_rank_blend(spark, sf):
    """The two-scorer blend on distances from each class's own subspace (components that hold 90 % of
    its variance); eigenvectors are beyond SQL, tests compare with numpy."""
    from flowlens.operators import low_rank as L
    train, test = _vector_parts(spark, sf)
    return L.two_scorer_blend(train, test)
