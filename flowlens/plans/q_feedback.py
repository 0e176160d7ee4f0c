"""Queries: text classifier and the feedback loop
on documents x labels (label = toxic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.exprs import rnd
from flowlens.functions.text import TOKEN_PATTERN
from flowlens.operators import feedback as FB
from flowlens.operators.metrics import epoch_metrics
from flowlens.operators.textmodel import text_classifier
from flowlens.plans import fixtures as fx
from flowlens.plans import sqlgen as sg
from flowlens.plans.catalog import query
from flowlens.plans.common import materialize, metrics_select, confusion_sql
from flowlens.operators.split import stratified_split

PAT = TOKEN_PATTERN.replace("'", "''")
CORRECTION_WEIGHT = 2.0


# ---------------------------------------------------------------- Spark side

def _docs(spark, sf):
    d = fx.labelled_docs(spark, sf).select("row_id", "text", "label")
    return materialize(stratified_split(d, "row_id", "label", "0.2", 42))


def _initial(spark, sf):
    sp = _docs(spark, sf)
    train, test = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "test")
    parts = FB.feedback_eval_split(test.select("row_id", "label"), "row_id", "label", FB.EVAL_FRACTION, 42)
    pred = text_classifier(train, test, keep=("text",))
    pred = materialize(pred.join(parts.select("row_id", "part"), "row_id"))
    return train, pred


def _refit(spark, sf):
    train, pred = _initial(spark, sf)
    corr = FB.collect_corrections(pred.where(F.col("part") == "feedback"))
    refit_train = FB.refit_frame(train, corr, ["row_id", "text", "label"], CORRECTION_WEIGHT, "union")
    evalp = pred.where(F.col("part") == "eval")
    after = materialize(text_classifier(refit_train, evalp, weight="weight"))
    return train, pred, refit_train, after


def _round(df):
    return df.select("row_id", "label", "pred", rnd("log_odds").alias("log_odds"), rnd("p1").alias("p1"))


# ---------------------------------------------------------------- SQL side

DOC_SPLIT = f"with d0 as ({fx.labelled_docs_sql('toxic')}),\nd as (select row_id, text, label from d0)," + \
    sg.split_ctes("d", "label", "0.2", 42)


def nb_sql(train: str, test: str, p: str, weight: str = "1e0") -> str:
    """CTE ``{p}`` (row_id, label, pred, log_odds, p1): multinomial NB fitted on ``train``."""
    return f"""{p}_trc as (select row_id, tok, count(*) as tf from
  (select row_id, unnest(regexp_extract_all(text, '{PAT}')) as tok from {train}) x group by all),
{p}_w as (select row_id, label as cls, {weight} as w from {train}),
{p}_pri as (select cls, sum(w) as n from {p}_w group by cls),
{p}_prl as (select cls, ln(n / (select sum(n) from {p}_pri)) as lp from {p}_pri),
{p}_ct as (select w.cls, t.tok, sum(t.tf * w.w) as c from {p}_trc t join {p}_w w on w.row_id = t.row_id group by all),
{p}_voc as (select distinct tok from {p}_trc),
{p}_v as (select count(*) as v from {p}_voc),
{p}_ctot as (select cls, sum(c) as tot from {p}_ct group by cls),
{p}_model as (select voc.tok, pr.cls, ln((coalesce(ct.c, 0) + 1e0) / (coalesce(ctot.tot, 0) + 1e0 * v.v)) as logp
  from {p}_voc voc cross join {p}_pri pr cross join {p}_v v
  left join {p}_ct ct on ct.cls = pr.cls and ct.tok = voc.tok left join {p}_ctot ctot on ctot.cls = pr.cls),
{p}_tec as (select row_id, tok, count(*) as tf from
  (select row_id, unnest(regexp_extract_all(text, '{PAT}')) as tok from {test}) x group by all),
{p}_s as (select t.row_id, coalesce(sum(case when m.cls = 0 then t.tf * m.logp end), 0) as s0,
  coalesce(sum(case when m.cls = 1 then t.tf * m.logp end), 0) as s1
  from {p}_tec t join {p}_model m on m.tok = t.tok group by t.row_id),
{p}_l as (select te.row_id, te.label, (select lp from {p}_prl where cls = 0) + coalesce(s.s0, 0) as l0,
  (select lp from {p}_prl where cls = 1) + coalesce(s.s1, 0) as l1 from {test} te left join {p}_s s on s.row_id = te.row_id),
{p} as (select row_id, label, case when l1 > l0 then 1 else 0 end as pred, l1 - l0 as log_odds,
  case when l1 - l0 >= 0 then 1e0 / (1e0 + exp(-(l1 - l0))) else exp(l1 - l0) / (1e0 + exp(l1 - l0)) end as p1 from {p}_l)"""


def _parts_sql():
    return sg.split_ctes("te_all", "label", "0.7", 42, name="fe")


BASE_SQL = (DOC_SPLIT + ",\ntr as (select * from sp where split = 'train'), te_all as (select row_id, text, label from sp where split = 'test'),\n"
            + nb_sql("tr", "te_all", "m0") + ",\n" + _parts_sql()[1:] + """,
pred as (select m0.*, case when fe.split = 'test' then 'eval' else 'feedback' end as part, te_all.text
  from m0 join fe on fe.row_id = m0.row_id join te_all on te_all.row_id = m0.row_id)""")

REFIT_SQL = BASE_SQL + f""",
corr as (select row_id, text, label from pred where part = 'feedback' and pred <> label),
rt as (select row_id, text, label, 1e0 as weight from tr union all select row_id, text, label, {CORRECTION_WEIGHT}e0 from corr),
ev as (select row_id, text, label from pred where part = 'eval'),
{nb_sql('rt', 'ev', 'm1', 'weight')},
before as (select * from pred where part = 'eval')"""


def _out(src):
    return f"select row_id, label, pred, {sg.r('log_odds')} as log_odds, {sg.r('p1')} as p1 from {src}"


@query("text_classifier", sql=BASE_SQL + "\n" + _out("m0"))
def q_text_classifier(spark, sf):
    _, pred = _initial(spark, sf)
    return _round(pred)


@query("feedback_eval_split", sql=DOC_SPLIT + ",\nte_all as (select row_id, text, label from sp where split = 'test')," + _parts_sql()[1:]
       + "\nselect row_id, label, case when split = 'test' then 'eval' else 'feedback' end as part from fe")
def q_feedback_eval_split(spark, sf):
    test = _docs(spark, sf).where(F.col("split") == "test").select("row_id", "label")
    return FB.feedback_eval_split(test, "row_id", "label", FB.EVAL_FRACTION, 42)


@query("feedback_records", sql=BASE_SQL + """
select row_id, substr(text, 1, 200) as text, pred as predicted, label as actual,
  case when pred = label then 1 else 0 end as correct, label as corrected_label from pred where part = 'feedback'""")
def q_feedback_records(spark, sf):
    _, pred = _initial(spark, sf)
    return FB.feedback_records(pred.where(F.col("part") == "feedback"))


@query("collect_corrections", sql=BASE_SQL + "\nselect row_id, label, pred from pred where part = 'feedback' and pred <> label")
def q_collect_corrections(spark, sf):
    _, pred = _initial(spark, sf)
    return FB.collect_corrections(pred.where(F.col("part") == "feedback")).select("row_id", "label", "pred")


@query("refit_on_corrections", sql=REFIT_SQL + "\n" + _out("m1"))
def q_refit_on_corrections(spark, sf):
    *_, after = _refit(spark, sf)
    return _round(after)


# ---- the reference's other variants: refit on the corrections alone, and an unstratified split with
# 80 % feedback. Without corrections the model is kept.

ONLY_SQL = BASE_SQL + f""",
corr as (select row_id, text, label from pred where part = 'feedback' and pred <> label),
rt as (select row_id, text, label, {CORRECTION_WEIGHT}e0 as weight from corr),
ev as (select row_id, text, label from pred where part = 'eval'),
{nb_sql('rt', 'ev', 'm1', 'weight')},
kinds as (select count(distinct label) as k, min(label) as one from corr),
kept as (select row_id, label, pred, log_odds, p1 from pred where part = 'eval'),
after as (select * from kept, kinds where k = 0
  union all select m1.*, kinds.* from m1, kinds where k = 2
  union all select row_id, label, one as pred, case when one = 1 then 1e9 else -1e9 end as log_odds, cast(one as double) as p1, k, one
    from ev, kinds where k = 1)"""


@query("refit_on_corrections_only", sql=ONLY_SQL + "\n" + _out("after"))
def q_refit_on_corrections_only(spark, sf):
    """The reference's retraining: the mistakes of the feedback part are the whole training set."""
    train, pred = _initial(spark, sf)
    corr = FB.collect_corrections(pred.where(F.col("part") == "feedback"))
    evalp = pred.where(F.col("part") == "eval")
    before = evalp.select("row_id", "label", "pred", "log_odds", "p1")
    return _round(FB.refit(train, corr, evalp, before, ["row_id", "text", "label"], CORRECTION_WEIGHT, "corrections_only"))


@query("feedback_eval_split_plain", sql=DOC_SPLIT + """,
te_all as (select row_id, label from sp where split = 'test'),
rk as (select *, row_number() over (order by md5('42#' || cast(row_id as varchar)), row_id) as r, count(*) over () as n from te_all)
select row_id, label, case when r > n - (n * 2 + 9) // 10 then 'eval' else 'feedback' end as part from rk""")
def q_feedback_eval_split_plain(spark, sf):
    """Unstratified: 80 % of the scored test rows give feedback, 20 % evaluate."""
    test = _docs(spark, sf).where(F.col("split") == "test").select("row_id", "label")
    return FB.feedback_eval_split(test, "row_id", None, FB.PLAIN_EVAL_FRACTION, 42)


def _eval_sql(src: str, stage: str) -> str:
    cum = f"""{stage}_st as (select cast(log_odds as double) as score, cast(sum(label) as bigint) as pos,
  cast(sum(1 - label) as bigint) as neg from {src} group by log_odds),
{stage}_tot as (select sum(pos) as p, sum(neg) as n from {stage}_st),
{stage}_cum as (select score, pos, neg, sum(pos) over (order by score desc rows between unbounded preceding and current row) as tp,
  sum(neg) over (order by score desc rows between unbounded preceding and current row) as fp from {stage}_st),
{stage}_auc as (select {sg.r('sum(pos * ((t.n - fp) + neg / 2e0)) / (t.p * t.n)')} as auroc,
  {sg.r('sum(pos / cast(t.p as double) * (cast(tp as double) / (tp + fp)))')} as average_precision
  from {stage}_cum cross join {stage}_tot t group by t.p, t.n),
{stage}_conf as ({confusion_sql(src)}),
{stage}_m as ({metrics_select(stage + '_conf', keep=f"'{stage}' as stage, ")})"""
    return cum


@query("evaluate_after_feedback", sql=REFIT_SQL + ",\n" + _eval_sql("m1", "after")
       + "\nselect * from after_m cross join after_auc")
def q_evaluate_after_feedback(spark, sf):
    *_, after = _refit(spark, sf)
    return FB.evaluate(after, "after")


@query("before_after_report", sql=REFIT_SQL + ",\n" + _eval_sql("before", "before") + ",\n" + _eval_sql("m1", "after")
       + "\nselect * from before_m cross join before_auc union all select * from after_m cross join after_auc")
def q_before_after_report(spark, sf):
    _, pred, _, after = _refit(spark, sf)
    return FB.before_after_report(pred.where(F.col("part") == "eval"), after)


@query("epoch_metrics", sql=REFIT_SQL + f""",
{nb_sql('rt', 'tr', 'm2', 'weight')},
{nb_sql('tr', 'tr', 'm3')},
rounds as (select 0 as round, * from m3 union all select 1, * from m2),
ll as (select *, -(label * ln(greatest(least(p1, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least(p1, 1 - 1e-15), 1e-15))) as loss from rounds)
select round, count(*) as n, {sg.r(sg.sdiv('sum(case when label = pred then 1 else 0 end)', 'count(*)'))} as accuracy,
  {sg.r(sg.sdiv('2 * sum(case when label = 1 and pred = 1 then 1 else 0 end)', '2 * sum(case when label = 1 and pred = 1 then 1 else 0 end) + sum(case when label = 0 and pred = 1 then 1 else 0 end) + sum(case when label = 1 and pred = 0 then 1 else 0 end)'))} as f1,
  {sg.r('avg(loss)')} as mean_loss from ll group by round""")
def q_epoch_metrics(spark, sf):
    """Accuracy, F1 and mean log-loss on the training rows after each fitting round
    (round 0: initial fit; round 1: refit with the weighted corrections)."""
    train, _, refit_train, _ = _refit(spark, sf)
    r0 = text_classifier(train, train).withColumn("round", F.lit(0))
    r1 = text_classifier(refit_train, train, weight="weight").withColumn("round", F.lit(1))
    both = r0.unionByName(r1).withColumn("loss", FB.log_loss())
    return epoch_metrics(both, "round", "label", "pred", "loss")


# ---- warm-started refit: mini-batch training that goes on from the saved weights

WARM_FEATURES = 1 << 12
WARM_STEPS = 4
WARM_EPOCHS = 3
WARM_RATE = 8.0


def _warm(spark, sf):
    """(features of all rows with their part, weights after each epoch of the first training, weights after
    each epoch over the corrections, corrections)."""
    from flowlens.operators import warm_start as W
    from flowlens.session import scratch_path
    sp = _docs(spark, sf)
    test = sp.where(F.col("split") == "test")
    parts = FB.feedback_eval_split(test.select("row_id", "label"), "row_id", "label", FB.EVAL_FRACTION, 42)
    part = F.coalesce(F.col("part"), F.lit("train"))
    rows = W.feature_table(sp.join(parts.select("row_id", "part"), "row_id", "left").withColumn("part", part),
                           n_features=WARM_FEATURES, keep=("row_id", "label", "part"))
    first = W.train(rows.where("part = 'train'"), None, WARM_EPOCHS, WARM_STEPS, WARM_RATE, 42, WARM_FEATURES)
    path = W.save_weights(spark, first[-1], scratch_path(spark, "weights"))
    pred = W.score(rows.where("part = 'feedback'"), first[-1], ("row_id", "label", "idx", "val"))
    corrections = materialize(FB.collect_corrections(pred).select("row_id", "label", "idx", "val"), "corrections")
    again = W.train(corrections, W.load_weights(spark, path, WARM_FEATURES), WARM_EPOCHS, WARM_STEPS, WARM_RATE, 43, WARM_FEATURES)
    return rows, first, again, corrections


def _step_sql(name: str, src: str, before: str, seed: int) -> str:
    """CTEs of one training over ``src`` from the weights ``before``: {name}_e0 ... after each epoch. All
    steps of an epoch are written out; a batch without rows leaves the weights as they are."""
    out, w = [], before
    for e in range(WARM_EPOCHS):
        out.append(f"""{name}_k{e} as materialized (select row_id, (row_number() over (order by {sg.h(seed * 1000003 + e)}, row_id) - 1)
  // ((count(*) over () + {WARM_STEPS - 1}) // {WARM_STEPS}) as step from (select distinct row_id from {src}) x)""")
        for s in range(WARM_STEPS):
            new = f"{name}_e{e}" if s == WARM_STEPS - 1 else f"{name}_w{e}_{s}"
            out.append(f"""{new}_z as (select f.row_id, any_value(f.label) as y, sum(f.val * {w}.w) as z from {src} f
  join {name}_k{e} k on k.row_id = f.row_id and k.step = {s} join {w} on {w}.idx = f.idx group by f.row_id),
{new}_g as (select f.idx, sum((1e0 / (1e0 + exp(-z.z)) - z.y) * f.val) / (select count(*) from {new}_z) as g
  from {src} f join {new}_z z on z.row_id = f.row_id group by f.idx),
{new} as materialized (select {w}.idx, {w}.w - {WARM_RATE}e0 * coalesce(g.g, 0) as w from {w} left join {new}_g g on g.idx = {w}.idx)""")
            w = new
    return ",\n".join(out)


WARM_SQL = DOC_SPLIT + ",\nte_all as (select row_id, label from sp where split = 'test')," + _parts_sql()[1:] + f""",
tok as (select sp.row_id, sp.label, coalesce(case when fe.split = 'test' then 'eval' when fe.split = 'train' then 'feedback' end, 'train') as part,
  unnest(regexp_extract_all(sp.text, '{PAT}')) as t from sp left join fe on fe.row_id = sp.row_id),
hashed as (select row_id, label, part, ('0x' || substr(md5(t), 1, 8))::bigint % {WARM_FEATURES} as idx, cast(count(*) as double) as c
  from tok group by all),
feat as materialized (select row_id, label, part, idx, c / sqrt(sum(c * c) over (partition by row_id)) as val from hashed
  union all select sp.row_id, label, coalesce(case when fe.split = 'test' then 'eval' when fe.split = 'train' then 'feedback' end, 'train'),
    {WARM_FEATURES}, 1e0 from sp left join (select row_id, split from fe) fe on fe.row_id = sp.row_id),
zero as materialized (select unnest(range({WARM_FEATURES + 1})) as idx, 0e0 as w),
ftr as materialized (select * from feat where part = 'train'),
{_step_sql('a', 'ftr', 'zero', 42)},
fpred as (select f.row_id, any_value(label) as label, sum(val * w) as z from feat f join a_e{WARM_EPOCHS - 1} w on w.idx = f.idx where part = 'feedback' group by f.row_id),
fco as materialized (select * from feat where row_id in (select row_id from fpred where (case when z > 0 then 1 else 0 end) <> label)),
{_step_sql('b', 'fco', f'a_e{WARM_EPOCHS - 1}', 43)}"""


def _warm_score_sql(src: str, w: str) -> str:
    return (f"select row_id, any_value(label) as label, case when sum(val * w) > 0 then 1 else 0 end as pred, sum(val * w) as log_odds, "
            f"1e0 / (1e0 + exp(-sum(val * w))) as p1 from {src} f join {w} on {w}.idx = f.idx group by row_id")


@query("refit_warm_start", sql=WARM_SQL + f",\nlast as ({_warm_score_sql('feat', f'b_e{WARM_EPOCHS - 1}')})\n"
       + _out("last") + " where row_id in (select row_id from feat where part = 'eval')")
def q_refit_warm_start(spark, sf):
    """The evaluation rows, scored by the weights that went on from the saved ones over the corrections."""
    from flowlens.operators import warm_start as W
    rows, _, again, _ = _warm(spark, sf)
    return _round(W.score(rows.where("part = 'eval'"), again[-1]))


_LOSS_SQL = "-(label * ln(greatest(least(p1, 1 - 1e-15), 1e-15)) + (1 - label) * ln(1 - greatest(least(p1, 1 - 1e-15), 1e-15)))"
_ROUNDS_SQL = " union all ".join(f"select {i} as round, * from ({_warm_score_sql(src, f'{p}_e{e}')}) x" for i, (p, e, src) in enumerate(
    [("a", e, "ftr") for e in range(WARM_EPOCHS)] + [("b", e, "fco") for e in range(WARM_EPOCHS)]))
_F1_SQL = sg.sdiv("2 * sum(case when label = 1 and pred = 1 then 1 else 0 end)", "sum(label) + sum(pred)")


@query("warm_start_epochs", sql=WARM_SQL + f""",
rounds as ({_ROUNDS_SQL})
select cast(round as int) as round, count(*) as n, {sg.r(sg.sdiv('sum(case when label = pred then 1 else 0 end)', 'count(*)'))} as accuracy,
  {sg.r(_F1_SQL)} as f1, {sg.r(f'avg({_LOSS_SQL})')} as mean_loss from rounds group by round""")
def q_warm_start_epochs(spark, sf):
    """``epoch_metrics`` of the real rounds: the epochs of the first training on its rows, then those of
    the further training on the corrections."""
    from flowlens.operators import warm_start as W
    rows, first, again, corrections = _warm(spark, sf)
    out = None
    for i, (src, w) in enumerate([(rows.where("part = 'train'"), w) for w in first] + [(corrections, w) for w in again]):
        one = W.score(src, w).withColumn("round", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return epoch_metrics(out.withColumn("loss", FB.log_loss()), "round", "label", "pred", "loss")
