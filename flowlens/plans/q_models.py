"""Queries: classical models and the scoreboard."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from flowlens.operators.metrics import binary_metrics, confusion_matrix
from flowlens.operators.naive_bayes import bernoulli_nb, gaussian_nb
from flowlens.operators.scale import apply_standard_scale, fit_standard_scale
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import query
from flowlens.plans.common import (FEATS, bnb_sql, confusion_sql, encoded_flows, encoded_flows_sql, gnb_sql,
                                   metrics_select, scaled_sql)


def scaled_flows(spark, sf):
    """Encoded flows, every model feature standard-scaled by the train part."""
    en = encoded_flows(spark, sf)
    fit = fit_standard_scale(en.where(F.col("split") == "train"), FEATS)
    return apply_standard_scale(en, fit)


def scaled_parts(spark, sf, scaled=None):
    scaled = scaled_flows(spark, sf) if scaled is None else scaled
    return scaled.where(F.col("split") == "train"), scaled.where(F.col("split") == "test")


def _gnb_pred(spark, sf):
    train, test = scaled_parts(spark, sf)
    return gaussian_nb(train, test, FEATS)


SCALED_SQL = encoded_flows_sql() + ",\n" + scaled_sql("en", FEATS, "sc")
PARTS_SQL = SCALED_SQL + """,
tr as (select * from sc where split = 'train'), te as (select * from sc where split = 'test')"""
GNB_PRED_SQL = PARTS_SQL + ",\n" + gnb_sql("tr", "te", FEATS)


@query("gaussian_nb_scoreboard", sql=GNB_PRED_SQL + f",\nconf as ({confusion_sql('nb')})\n"
       + metrics_select("conf", keep="'gaussian_nb' as model, "))
def gaussian_nb_scoreboard(spark, sf):
    """Flagship: flows -> binary label -> exact 80/20 split -> standard scale (train fit)
    -> Gaussian NB -> confusion -> metric row."""
    pred = _gnb_pred(spark, sf)
    return binary_metrics(confusion_matrix(pred), keep=(F.lit("gaussian_nb").alias("model"),))


@query("gaussian_nb", sql=GNB_PRED_SQL + "\nselect row_id, label, pred from nb")
def q_gaussian_nb(spark, sf):
    return _gnb_pred(spark, sf)


@query("bernoulli_nb", sql=PARTS_SQL + ",\n" + bnb_sql("tr", "te", FEATS) + "\nselect row_id, label, pred from bp")
def q_bernoulli_nb(spark, sf):
    """On scaled features: a feature is on where it is above its train mean."""
    train, test = scaled_parts(spark, sf)
    return bernoulli_nb(train, test, FEATS)


# ---------------------------------------------------------------- metric operators on fixed predictions

from flowlens.operators import classifiers as CL  # noqa: E402
from flowlens.operators import exact_tree as ET  # noqa: E402
from flowlens.operators import metrics as M  # noqa: E402
from flowlens.operators import newton as NW  # noqa: E402
from flowlens.operators.knn import knn_classify, knn_top_k  # noqa: E402
from flowlens.operators.naive_bayes import gaussian_nb_logits  # noqa: E402
from flowlens.plans import sqlgen as sg  # noqa: E402
from flowlens.functions.exprs import rnd  # noqa: E402
from flowlens.plans.common import materialize  # noqa: E402


@query("confusion_matrix", sql=GNB_PRED_SQL + "\n" + confusion_sql("nb"))
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(_gnb_pred(spark, sf))


@query("binary_metrics", sql=GNB_PRED_SQL + f",\nconf as ({confusion_sql('nb')})\n" + metrics_select("conf"))
def q_binary_metrics(spark, sf):
    return M.binary_metrics(M.confusion_matrix(_gnb_pred(spark, sf)))


def _rates_sql():
    def r(a, b):
        return sg.r(sg.sdiv(a, b, "null"))
    return (GNB_PRED_SQL + f",\nconf as ({confusion_sql('nb')})\n"
            + f"""select tn, fp, fn, tp, {r('tp', 'tp + fn')} as tpr, {r('tn', 'tn + fp')} as tnr,
  {r('tp', 'tp + fp')} as ppv, {r('tn', 'tn + fn')} as npv, {r('fp', 'fp + tn')} as fpr,
  {r('fn', 'tp + fn')} as fnr, {r('fp', 'tp + fp')} as fdr from conf""")


@query("derived_rates", sql=_rates_sql())
def q_derived_rates(spark, sf):
    return M.derived_rates(M.confusion_matrix(_gnb_pred(spark, sf)))


@query("micro_f1", sql=GNB_PRED_SQL + f",\nconf as ({confusion_sql('nb')})\nselect {sg.r(sg.sdiv('tp + tn', 'tn + fp + fn + tp'))} as micro_f1 from conf")
def q_micro_f1(spark, sf):
    return M.micro_f1(M.confusion_matrix(_gnb_pred(spark, sf)))


@query("r2_of_labels", sql=GNB_PRED_SQL + f",\nconf as ({confusion_sql('nb')})\nselect r2 from ({metrics_select('conf')}) m")
def q_r2_of_labels(spark, sf):
    return M.r2_of_labels(M.confusion_matrix(_gnb_pred(spark, sf)))


# ---------------------------------------------------------------- probabilities from logits

def softmax_p1(l0, l1):
    """P(class 1) from two logits, max-subtracted; argmax with the first index winning ties."""
    m = F.greatest(l0, l1)
    e0, e1 = F.exp(l0 - m), F.exp(l1 - m)
    return e1 / (e0 + e1), F.when(l1 > l0, 1).otherwise(0)


@query("predict_proba", sql=GNB_PRED_SQL.rsplit(",\nnb as", 1)[0] + f""",
lg as (select row_id, label, max(case when cls = 0 then ll end) as l0, max(case when cls = 1 then ll end) as l1
  from nb_ll group by row_id, label)
select row_id, label, {sg.r('exp(l1 - greatest(l0, l1)) / (exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1)))')} as p1,
  case when l1 > l0 then 1 else 0 end as pred from lg""")
def q_predict_proba(spark, sf):
    train, test = scaled_parts(spark, sf)
    lg = gaussian_nb_logits(train, test, FEATS)
    p1, pred = softmax_p1(F.col("logit_0"), F.col("logit_1"))
    return lg.select("row_id", "label", rnd(p1).alias("p1"), pred.alias("pred"))


# ---------------------------------------------------------------- kNN on the 64-d vectors

VEC_SPLIT_SQL = f"with vx as ({fx.VECTORS_SQL})," + sg.split_ctes("vx", "label", "0.2", 42)
KNN_SQL = VEC_SPLIT_SQL + """,
tr as (select * from sp where split = 'train'), te as (select * from sp where split = 'test'),
pairs as (select te.row_id as test_id, tr.row_id as train_id, list_distance(te.vec, tr.vec) as d, tr.label as train_label
  from te cross join tr),
rk as (select *, row_number() over (partition by test_id order by d, train_id) as rank from pairs)"""


def _vec_split(spark, sf):
    from flowlens.operators.split import stratified_split
    sp = materialize(stratified_split(fx.vectors(spark, sf), "row_id", "label", "0.2", 42))
    return sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")


@query("knn_top_k", sql=KNN_SQL + f"\nselect test_id, train_id, {sg.r('d')} as distance, rank, train_label from rk where rank <= 5")
def q_knn_top_k(spark, sf):
    tr, te = _vec_split(spark, sf)
    return knn_top_k(tr, te, "vec", "row_id", "label", 5)


@query("knn", sql=KNN_SQL + """,
v as (select test_id, train_label, count(*) as votes from rk where rank <= 5 group by all),
b as (select test_id, train_label, row_number() over (partition by test_id order by votes desc, train_label asc) as r from v)
select te.row_id, te.label, b.train_label as pred from te join b on b.test_id = te.row_id and b.r = 1""")
def q_knn(spark, sf):
    tr, te = _vec_split(spark, sf)
    return knn_classify(tr, te, "vec", "row_id", "label", 5)


# ---------------------------------------------------------------- trees, forest, logistic regression

@query("decision_tree")
def q_decision_tree(spark, sf):
    train, test = scaled_parts(spark, sf)
    return ET.decision_tree(train, test, FEATS)


_SPLIT_PARTS = " union all ".join(f"select {i} as c, '{c}' as name, cast({c} as double) as v, label from tr" for i, c in enumerate(FEATS))


@query("tree_first_split", sql=PARTS_SQL + f""",
cells as ({_SPLIT_PARTS}),
vals as (select c, name, v, cast(count(*) as double) as n, cast(sum(label) as double) as p from cells group by all),
run as (select *, sum(n) over w as n0, sum(p) over w as p0, lead(v) over (partition by c order by v) as nv,
  sum(n) over (partition by c) as an, sum(p) over (partition by c) as ap from vals window w as (partition by c order by v rows between unbounded preceding and current row)),
best as (select *, (p0 * p0 + (n0 - p0) * (n0 - p0)) / n0 + ((ap - p0) * (ap - p0) + ((an - n0) - (ap - p0)) * ((an - n0) - (ap - p0))) / (an - n0) as s
  from run where nv is not null order by s desc, c, v limit 1)
select name as "column", {sg.r('v + (nv - v) / 2')} as threshold, cast(n0 as bigint) as n0, cast(p0 as bigint) as p0,
  cast(an - n0 as bigint) as n1, cast(ap - p0 as bigint) as p1 from best""")
def q_tree_first_split(spark, sf):
    """The root of the decision tree, by the level-wise split search over all rows."""
    train, _ = scaled_parts(spark, sf)
    return ET.root_split(train, FEATS)


@query("random_forest")
def q_random_forest(spark, sf):
    train, test = scaled_parts(spark, sf)
    return ET.random_forest(train, test, FEATS)


NEWTON_STEPS = 10


def _newton_sql(cols: list[str], steps: int = NEWTON_STEPS) -> str:
    """CTEs up to ``nw{steps}``: one row of weights w0.. (intercept last), by Newton steps written out; each solves
    its normal equations by elimination."""
    d = len(cols) + 1
    x = [f"cast({c} as double)" for c in cols] + ["1e0"]
    out = [f"xs as materialized (select cast(label as double) as y, {', '.join(f'{e} as x{i}' for i, e in enumerate(x))} from tr)",
           f"nw0 as materialized (select {', '.join(f'0e0 as w{i}' for i in range(d))})"]
    for t in range(steps):
        z = " + ".join(f"x{i} * w{i}" for i in range(d))
        g = [f"sum((p - y) * x{i})" + (f" + any_value(w{i})" if i < d - 1 else "") + f" as r{i}" for i in range(d)]
        h = [f"sum(p * (1 - p) * x{i} * x{j})" + (" + 1e0" if i == j < d - 1 else "") + f" as a{i}_{j}" for i in range(d) for j in range(i, d)]
        out.append(f"nz{t} as (select *, 1e0 / (1e0 + exp(-({z}))) as p from xs cross join nw{t})")
        out.append(f"ne{t}_0 as materialized (select {', '.join(g + h)} from nz{t})")
        for k in range(d - 1):                 # the matrix is symmetric: only its upper half is kept
            a = [f"a{i}_{j} - a{k}_{i} / a{k}_{k} * a{k}_{j} as a{i}_{j}" for i in range(k + 1, d) for j in range(i, d)]
            r = [f"r{i} - a{k}_{i} / a{k}_{k} * r{k} as r{i}" for i in range(k + 1, d)]
            done = [f"a{i}_{j}" for i in range(k + 1) for j in range(i, d)] + [f"r{i}" for i in range(k + 1)]
            out.append(f"ne{t}_{k + 1} as materialized (select {', '.join(a + r + done)} from ne{t}_{k})")
        last = f"ne{t}_{d - 1}"
        for i in range(d - 1, -1, -1):
            rest = "".join(f" - a{i}_{j} * s{j}" for j in range(i + 1, d))
            out.append(f"nb{t}_{i} as materialized (select *, (r{i}{rest}) / a{i}_{i} as s{i} from {last})")
            last = f"nb{t}_{i}"
        out.append(f"nw{t + 1} as materialized (select {', '.join(f'w{i} - s{i} as w{i}' for i in range(d))} from nw{t} cross join {last})")
    return ",\n".join(out)


_LR_Z = " + ".join([f"cast({c} as double) * w{i}" for i, c in enumerate(FEATS)] + [f"w{len(FEATS)}"])


@query("logistic_regression", sql=PARTS_SQL + ",\n" + _newton_sql(FEATS) + f""",
sz as (select row_id, label, {_LR_Z} as z from te cross join nw{NEWTON_STEPS})
select row_id, label, case when z > 0 then 1 else 0 end as pred, {sg.r('1e0 / (1e0 + exp(-z))')} as p1 from sz""")
def q_logistic_regression(spark, sf):
    train, test = scaled_parts(spark, sf)
    return NW.logistic_regression(train, test, FEATS)


@query("logistic_weights", sql=PARTS_SQL + ",\n" + _newton_sql(FEATS) + "\n" + "\nunion all ".join(
    f"select '{c}' as feature, {sg.r(f'w{i}')} as weight, 0e0 as gradient from nw{NEWTON_STEPS}" for i, c in enumerate(FEATS + ["intercept"])))
def q_logistic_weights(spark, sf):
    """The weights, and the gradient of the objective at them in the 8th digit after the point."""
    train, _ = scaled_parts(spark, sf)
    got = NW.fit(train, FEATS)
    rows = [(c, float(w), float(g)) for c, w, g in zip(FEATS + ["intercept"], got["weights"], got["gradient"])]
    out = spark.createDataFrame(rows, "feature string, weight double, gradient double")
    return out.select("feature", rnd("weight").alias("weight"), rnd(F.abs("gradient"), 8).alias("gradient"))


QUALITY_FLOOR = 0.02      # accuracy above that of always naming the larger class


@query("tree_quality", sql=PARTS_SQL + """
select m as model, (select count(*) from te) as n, (select count(*) from te where label = 1) as positives, true as better
  from (values ('decision_tree'), ('random_forest'), ('logistic_regression')) v(m)""")
def q_tree_quality(spark, sf):
    """What SQL can say of the fits: every test row is scored once with its own label, and the
    accuracy beats the majority class by ``QUALITY_FLOOR``."""
    scaled = materialize(scaled_flows(spark, sf), "flows-scaled")
    train, test = scaled_parts(spark, sf, scaled)
    out = None
    models = [("decision_tree", ET.decision_tree), ("random_forest", ET.random_forest), ("logistic_regression", NW.logistic_regression)]
    for (name, _), pred in zip(models, CL.at_once(spark, *[partial(fn, train, test, FEATS) for _, fn in models])):
        right = F.avg((F.col("pred") == F.col("label")).cast("double"))
        positive = F.avg(F.col("label").cast("double"))
        row = pred.agg(F.lit(name).alias("model"), F.count_distinct("row_id").alias("n"),
                       F.sum("label").cast("bigint").alias("positives"),
                       (right >= F.greatest(positive, 1 - positive) + QUALITY_FLOOR).alias("better"))
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------- cross-validation

def _folded_train(spark, sf, scaled=None):
    """Scaled train part of the exact split with 5 unshuffled stratified folds."""
    from flowlens.operators.split import stratified_folds
    train, _ = scaled_parts(spark, sf, scaled)
    return materialize(stratified_folds(train, "row_id", "label", 5), "folds")


def _folds_cte(src="tr0", label="label", k=5):
    def upto(m, i):
        return f"(({m}) - {i} + {k - 1}) // {k}"
    bounds, acc = [], []
    for i in range(k - 1):
        acc.append(f"({upto('s + c', i)} - {upto('s', i)})")
        bounds.append(f"{' + '.join(acc)} as b{i}")
    fold = " + ".join(f"case when r > b{i} then 1 else 0 end" for i in range(k - 1))
    return f"""cs as (select {label} as cls, count(*) as c, min(row_id) as fk from {src} group by {label}),
cs2 as (select cls, c, coalesce(sum(c) over (order by fk rows between unbounded preceding and 1 preceding), 0) as s from cs),
bd as (select cls, {', '.join(bounds)} from cs2),
rk0 as (select *, row_number() over (partition by {label} order by row_id) as r from {src}),
fx as (select rk0.* exclude (r), cast({fold} as int) as fold from rk0 join bd on bd.cls = rk0.{label})"""


def _cv_ctes(kind: str, cols: list[str], p: str) -> str:
    """CTEs ending in ``{p}_acc`` (fold, n, n_right, accuracy): k-fold CV of a naive Bayes
    model over ``fx`` (rows with their fold); each fold's model sees the other folds."""
    if kind == "gaussian":
        stats = ", ".join(f"avg(cast(x.{c} as double)) as m{i}, var_pop(cast(x.{c} as double)) as v{i}"
                          for i, c in enumerate(cols))
        eps = "1e-9 * greatest(" + ", ".join(f"var_pop(cast(x.{c} as double))" for c in cols) + ")"
        terms = " + ".join(f"(-0.5 * ln(2 * pi() * (s.v{i} + e.eps)) - 0.5 * (cast(x.{c} as double) - s.m{i}) ^ 2 / (s.v{i} + e.eps))"
                           for i, c in enumerate(cols))
    else:
        stats = ", ".join(f"sum(case when x.{c} > 0 then 1 else 0 end) as o{i}" for i, c in enumerate(cols))
        eps = "0e0"
        terms = " + ".join(f"(case when x.{c} > 0 then ln((s.o{i} + 1e0) / (s.n + 2e0)) else ln(1e0 - (s.o{i} + 1e0) / (s.n + 2e0)) end)"
                           for i, c in enumerate(cols))
    return f"""{p}_fl as (select unnest(range(0, 5)) as f),
{p}_st as (select fl.f, x.label as cls, count(*) as n, {stats} from {p}_fl fl join fx x on x.fold <> fl.f group by fl.f, x.label),
{p}_ep as (select fl.f, {eps} as eps, count(*) as tot from {p}_fl fl join fx x on x.fold <> fl.f group by fl.f),
{p}_ll as (select x.row_id, x.fold, x.label, s.cls, ln(s.n / e.tot) + {terms} as ll
  from fx x join {p}_st s on s.f = x.fold join {p}_ep e on e.f = x.fold),
{p}_pr as (select * from (select *, row_number() over (partition by row_id order by ll desc, cls asc) as rn from {p}_ll) y where rn = 1),
{p}_acc as (select fold, count(*) as n, cast(sum(case when label = cls then 1 else 0 end) as bigint) as n_right,
  {sg.r(sg.sdiv('sum(case when label = cls then 1 else 0 end)', 'count(*)'))} as accuracy from {p}_pr group by fold)"""


FOLDS_SQL = PARTS_SQL + ",\ntr0 as (select * from tr),\n" + _folds_cte()


def _cv_gnb_sql():
    return FOLDS_SQL + ",\n" + _cv_ctes("gaussian", FEATS, "g") + "\nselect * from g_acc"


def _board_sql(name, conf, acc):
    return (f"select '{name}' as model, (select {sg.r('avg(accuracy)')} from {acc}) as train_accuracy, "
            f"r2 as test_r2_score, accuracy, precision_benign as benign_precision, "
            f"precision_anomaly as anomaly_precision, recall, f1 as f1_score, fpr as \"FPR\" "
            f"from ({metrics_select(conf)}) m")


def _nb_scoreboard_sql():
    return (FOLDS_SQL + ",\n" + _cv_ctes("gaussian", FEATS, "g") + ",\n" + _cv_ctes("bernoulli", FEATS, "b") + ",\n"
            + gnb_sql("tr", "te", FEATS) + ",\n" + bnb_sql("tr", "te", FEATS) + f""",
gconf as ({confusion_sql('nb')}), bconf as ({confusion_sql('bp')})
{_board_sql('gaussian_nb', 'gconf', 'g_acc')}
union all
{_board_sql('bernoulli_nb', 'bconf', 'b_acc')}""")


@query("cv_accuracy", sql=_cv_gnb_sql())
def q_cv_accuracy(spark, sf):
    """5-fold (unshuffled, stratified) CV accuracy of Gaussian NB on the train part."""
    return CL.cv_accuracy(CL.cv_predict_nb(_folded_train(spark, sf), FEATS, "label", "fold", "gaussian"))


# ---------------------------------------------------------------- scoreboards

def _mean_accuracy(cv):
    """Mean fold accuracy: k numbers, read on the driver and attached as a literal."""
    return rnd(F.lit(cv.agg(F.avg("accuracy")).first()[0]).cast("double"))


def _nb_scoreboard(spark, sf, scaled=None, folded=None):
    scaled = materialize(scaled_flows(spark, sf), "flows-scaled") if scaled is None else scaled
    folded = _folded_train(spark, sf, scaled) if folded is None else folded
    train, test = scaled_parts(spark, sf, scaled)
    rows = []
    for name, kind in (("gaussian_nb", "gaussian"), ("bernoulli_nb", "bernoulli")):
        cv = CL.cv_accuracy(CL.cv_predict_nb(folded, FEATS, "label", "fold", kind))
        pred = (gaussian_nb if kind == "gaussian" else bernoulli_nb)(train, test, FEATS)
        m = M.binary_metrics(M.confusion_matrix(pred), keep=(F.lit(name).alias("model"),))
        rows.append(M.scoreboard_columns(m.withColumn("train_accuracy", _mean_accuracy(cv))))
    return rows[0].unionByName(rows[1])


@query("scoreboard_columns", sql=_nb_scoreboard_sql())
def q_scoreboard_columns(spark, sf):
    """Scoreboard layout (headers over their own values) for the two naive Bayes models."""
    return _nb_scoreboard(spark, sf)


@query("model_scoreboard")
def q_model_scoreboard(spark, sf):
    """All six classical models: cv accuracy on the train part, test metrics on the 20 % part."""
    scaled = materialize(scaled_flows(spark, sf), "flows-scaled")     # read by every model
    folded = _folded_train(spark, sf, scaled)
    train, test = scaled_parts(spark, sf, scaled)
    out = _nb_scoreboard(spark, sf, scaled, folded)

    def knn_fit_predict(tr, te, cols, label, key):
        def with_vec(df):
            return df.select(key, label, F.array(*[F.col(c).cast("double") for c in cols]).alias("vec"))
        return knn_classify(with_vec(tr), with_vec(te), "vec", key, label, 5)

    def model_row(name, fn):
        pred, accuracy = CL.at_once(spark, lambda: fn(train, test, FEATS, "label", "row_id"),
                                    lambda: _mean_accuracy(CL.cv_accuracy(CL.cv_predict_mllib(fn, folded, FEATS, "label", "fold", "row_id", 5))))
        m = M.binary_metrics(M.confusion_matrix(pred), keep=(F.lit(name).alias("model"),))
        return M.scoreboard_columns(m.withColumn("train_accuracy", accuracy))

    models = [("decision_tree", ET.decision_tree), ("knn", knn_fit_predict),
              ("random_forest", ET.random_forest), ("logistic_regression", NW.logistic_regression)]
    for row in CL.at_once(spark, *[partial(model_row, *m) for m in models]):
        out = out.unionByName(row)
    return out
