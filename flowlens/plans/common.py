"""Shared building blocks of the registered queries (Spark side and SQL side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.split import stratified_split
from flowlens.plans import fixtures as fx
from flowlens.plans import sqlgen as sg
from flowlens.operators import encode as E
from flowlens.session import discard, materialize

SEED = 42
TEST_FRACTION = "0.2"


# The model features: encoded categoricals, binaries and numerics (all are scaled before any model)
CODES = [f"{c}_code" for c in fx.FLOW_CATEGORICAL]
FEATS = CODES + fx.FLOW_BINARY + fx.FLOW_NUMERIC


def split_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labelled flows + exact stratified 80/20 split, written once."""
    df = materialize(fx.labelled_flows(spark, sf_dir), "flows")
    out = materialize(stratified_split(df, "row_id", "label", TEST_FRACTION, SEED), "flows-split")
    discard(df)
    return out


def encoded_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``split_flows`` with the code of each categorical column beside it (dictionaries of the train
    part; a test value that train never saw fails the job), written once."""
    sp = split_flows(spark, sf_dir)
    fit = E.fit_label_encode(sp.where(F.col("split") == "train"), fx.FLOW_CATEGORICAL)
    out = materialize(E.apply_label_encode(sp, fit, suffix="_code"), "flows-encoded")
    discard(sp)
    return out


def split_flows_sql() -> str:
    """CTE prefix defining ``lf`` (labelled flows) and ``sp`` (lf + split)."""
    return f"with lf as ({fx.LABELLED_FLOWS_SQL}),{sg.split_ctes('lf', 'label', TEST_FRACTION, SEED)}"


def encoded_flows_sql() -> str:
    """CTE prefix up to ``en``: ``sp`` with the train dictionary's code of each categorical column."""
    dicts = ",\n".join(f"dict_{c} as (select {c} as v, row_number() over (order by {c}) - 1 as code "
                       f"from (select distinct {c} from sp where split = 'train') x)" for c in fx.FLOW_CATEGORICAL)
    joins = " ".join(f"left join dict_{c} on dict_{c}.v = sp.{c}" for c in fx.FLOW_CATEGORICAL)
    codes = ", ".join(f"dict_{c}.code as {c}_code" for c in fx.FLOW_CATEGORICAL)
    return f"{split_flows_sql()},\n{dicts},\nen as materialized (select sp.*, {codes} from sp {joins})"


def scaled_sql(src: str, cols: list[str], name: str, fit_where: str = "split = 'train'") -> str:
    """CTE ``name``: src with ``cols`` standard-scaled by population stats of the fit rows."""
    stats = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in cols)
    proj = ", ".join(
        f"(cast(s.{c} as double) - f.m_{c}) / (case when f.s_{c} is null or f.s_{c} = 0 then 1e0 else f.s_{c} end) as {c}"
        for c in cols)
    return f"""{name}_fit as (select {stats} from {src} where {fit_where}),
{name} as (select s.* exclude ({', '.join(cols)}), {proj} from {src} s cross join {name}_fit f)"""


def gnb_sql(train: str, test: str, cols: list[str], name: str = "nb", label: str = "label") -> str:
    """CTE ``{name}`` (row_id, label, pred): Gaussian NB fitted on ``train``, applied to ``test``."""
    stats = ", ".join(f"avg(cast({c} as double)) as m{i}, var_pop(cast({c} as double)) as v{i}"
                      for i, c in enumerate(cols))
    eps = "1e-9 * greatest(" + ", ".join(f"var_pop(cast({c} as double))" for c in cols) + ")"
    terms = " + ".join(f"(-0.5 * ln(2 * pi() * (c.v{i} + e.eps)) - 0.5 * (cast(t.{c} as double) - c.m{i}) ^ 2 / (c.v{i} + e.eps))"
                       for i, c in enumerate(cols))
    return f"""{name}_cls as (select {label} as cls, count(*) as n, {stats} from {train} group by {label}),
{name}_eps as (select {eps} as eps, count(*) as tot from {train}),
{name}_ll as (select t.row_id, t.{label} as label, c.cls, ln(c.n / e.tot) + {terms} as ll
  from {test} t cross join {name}_cls c cross join {name}_eps e),
{name} as (select row_id, label, cls as pred from (select *, row_number() over
  (partition by row_id order by ll desc, cls asc) as rn from {name}_ll) x where rn = 1)"""


def bnb_sql(train: str, test: str, cols: list[str], name: str = "bp", label: str = "label") -> str:
    """CTE ``{name}`` (row_id, label, pred): Bernoulli NB (features above 0) fitted on ``train``."""
    ones = ", ".join(f"cast(sum(case when {c} > 0 then 1 else 0 end) as bigint) as o{i}" for i, c in enumerate(cols))
    terms = " + ".join(
        f"(case when t.{c} > 0 then ln((c.o{i} + 1e0) / (c.n + 2e0)) else ln(1e0 - (c.o{i} + 1e0) / (c.n + 2e0)) end)"
        for i, c in enumerate(cols))
    return f"""{name}_cls as (select {label} as cls, count(*) as n, {ones} from {train} group by {label}),
{name}_tot as (select count(*) as tot from {train}),
{name}_ll as (select t.row_id, t.{label} as label, c.cls, ln(c.n / b.tot) + {terms} as ll
  from {test} t cross join {name}_cls c cross join {name}_tot b),
{name} as (select row_id, label, cls as pred from (select *, row_number() over
  (partition by row_id order by ll desc, cls asc) as rn from {name}_ll) x where rn = 1)"""


def confusion_sql(src: str, label: str = "label", pred: str = "pred") -> str:
    return f"""select cast(sum(case when {label} = 0 and {pred} = 0 then 1 else 0 end) as bigint) as tn,
  cast(sum(case when {label} = 0 and {pred} = 1 then 1 else 0 end) as bigint) as fp,
  cast(sum(case when {label} = 1 and {pred} = 0 then 1 else 0 end) as bigint) as fn,
  cast(sum(case when {label} = 1 and {pred} = 1 then 1 else 0 end) as bigint) as tp from {src}"""


def metrics_select(conf: str, keep: str = "") -> str:
    """SQL of ``operators.metrics.binary_metrics`` over a CTE/table ``conf``."""
    n = "(tn + fp + fn + tp)"
    r2 = (f"case when (tp + fn) = 0 or (tn + fp) = 0 then null else 1e0 - cast(fp + fn as double) * cast({n} as double)"
          f" / (cast(tp + fn as double) * cast(tn + fp as double)) end")
    return f"""select {keep}tn, fp, fn, tp, cast({n} as bigint) as n,
  {sg.r(sg.sdiv('tp + tn', n))} as accuracy,
  {sg.r(r2)} as r2,
  {sg.r(sg.sdiv('tn', 'tn + fn'))} as precision_benign,
  {sg.r(sg.sdiv('tp', 'tp + fp'))} as precision_anomaly,
  {sg.r(sg.sdiv('tp', 'tp + fn'))} as recall,
  {sg.r(sg.sdiv('2 * tp', '2 * tp + fp + fn'))} as f1,
  {sg.r(sg.sdiv('fp', 'fp + tn', 'null'))} as fpr
from {conf}"""


def lit_model(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.lit(name).alias("model"), *df.columns)
