"""Queries: sources and sinks, union by name (2.7), fit store, batch scoring.

Every file these queries read is first written by Spark from the given tables
into the shared checkpoint folder (``session.scratch_path``), so their work
grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.operators import scale as S
from flowlens.plans import fixtures as fx
from flowlens.plans import sqlgen as sg
from flowlens.plans.catalog import query
from flowlens.plans.common import split_flows, split_flows_sql
from flowlens.session import scratch_path
from flowlens.sources import flows_io as IO
from flowlens.sources.tables import read_table

FL = f"with flows as ({fx.FLOWS_SQL})"
ALL = ", ".join(fx.FLOW_COLUMNS)

FLOW_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("protocol", T.StringType()),
    T.StructField("service", T.StringType()), T.StructField("flag", T.StringType()),
    T.StructField("overdrawn", T.IntegerType()), T.StructField("always_zero", T.LongType()),
    T.StructField("n_lines", T.LongType()), T.StructField("qty", T.DoubleType()),
    T.StructField("amount", T.DoubleType()), T.StructField("max_discount", T.DoubleType()),
    T.StructField("total", T.DoubleType()), T.StructField("balance", T.DoubleType()),
    T.StructField("attack_type", T.StringType())])


@query("read_flows_headerless", sql=FL + f"\nselect {ALL} from flows")
def read_flows_headerless(spark, sf):
    path = IO.write_flows_csv(fx.flows(spark, sf), scratch_path(spark, "flows-nohdr"), header=False)
    return IO.read_flows_headerless(spark, path, FLOW_SCHEMA)


@query("read_flows_header", sql=FL + f"\nselect {ALL} from flows")
def read_flows_header(spark, sf):
    path = IO.write_flows_csv(fx.flows(spark, sf), scratch_path(spark, "flows-hdr"), header=True)
    return IO.read_flows_header(spark, path, FLOW_SCHEMA)


@query("write_flows_parquet", sql=FL + f"\nselect {ALL} from flows")
def write_flows_parquet(spark, sf):
    """Write flows partitioned by the label, read it back (label partitions prune class subsets)."""
    path = IO.write_flows_parquet(fx.flows(spark, sf), scratch_path(spark, "flows-pq"), "attack_type")
    return IO.read_flows_parquet(spark, path).select(*fx.FLOW_COLUMNS)


@query("read_flows_parquet", sql=FL + f"\nselect {ALL} from flows")
def read_flows_parquet(spark, sf):
    """The whole partitioned table (a class filter prunes to its folder)."""
    path = IO.write_flows_parquet(fx.flows(spark, sf), scratch_path(spark, "flows-pq"), "attack_type")
    return IO.read_flows_parquet(spark, path).select(*fx.FLOW_COLUMNS)


# ---------------------------------------------------------------- folder ingest

EVENT_CLASSES = ["click", "error", "purchase", "signup", "view"]


def write_event_folders(spark, sf) -> str:
    """root/<event_type>/ CSV folders from events: 'view' files lack ``props``, 'click' files
    carry an extra ``Label`` column (dropped at ingest), 'signup' files have their columns in
    another order, 'purchase' props hold a line break, and 'error' also holds ragged files."""
    root = scratch_path(spark, "event-folders")
    ev = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "value", "props")
    for cls in EVENT_CLASSES:
        part = ev.where(F.col("event_type") == cls)
        cols = ["event_id", "user_id", "value"] + ([] if cls == "view" else ["props"])
        cols = cols[::-1] if cls == "signup" else cols
        if cls == "purchase":
            part = part.withColumn("props", F.concat("props", F.lit("\n"), F.col("event_id").cast("string")))
        out = part.select(*cols, *([F.lit("x").alias("Label")] if cls == "click" else []))
        out.write.mode("overwrite").option("header", True).csv(f"{root}/{cls}")
        if cls == "error":
            # a tenth of the rows once more, each followed by one with a field too many (an unquoted
            # comma): later rows of these files are longer than their header
            some = part.where("event_id % 10 = 0").select(F.explode(F.array(F.lit(""), F.lit(",extra"))).alias("more"), *cols)
            ragged = some.select(*[c for c in cols if c != "props"], F.concat("props", "more").alias("props"))
            ragged.write.mode("append").option("header", True).option("quote", "").option("escape", "").csv(f"{root}/{cls}")
    return root


def _ingest(spark, sf):
    root = write_event_folders(spark, sf)
    return IO.ingest_labelled_folders(spark, root, EVENT_CLASSES)


@query("ingest_labelled_folders", sql="""select event_id, user_id, value,
  case event_type when 'view' then null when 'purchase' then props || chr(10) || event_id else props end as props,
  event_type as label from events""")
def ingest_labelled_folders(spark, sf):
    rows, _ = _ingest(spark, sf)
    return rows.select("event_id", "user_id", "value", "props", "label")


@query("quarantine_bad_files", sql="""select 'error' as folder, 2 * count(*) as n_rows from events
  where event_type = 'error' and event_id % 10 = 0""")
def quarantine_bad_files(spark, sf):
    """(folder, n_rows): rows of the quarantined files per class folder (the ragged 'error' files)."""
    bad = IO.quarantine_bad_files(_ingest(spark, sf))
    return bad.groupBy("folder").agg(F.sum("n_rows").cast("bigint").alias("n_rows"))


@query("union_by_name", sql="""select event_id, user_id, case when event_type = 'view' then null else value end as value,
  case when event_type = 'click' then null else props end as props, event_type from events""")
def union_by_name(spark, sf):
    ev = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "value", "props")
    frames = []
    for cls in EVENT_CLASSES:
        cols = ["event_id", "user_id", "event_type"] + (["props"] if cls == "view" else
                                                        ["value"] if cls == "click" else ["value", "props"])
        frames.append(ev.where(F.col("event_type") == cls).select(*cols))
    return IO.union_by_name(*frames).select("event_id", "user_id", "value", "props", "event_type")


# ---------------------------------------------------------------- fit store and sinks

NUM = fx.FLOW_NUMERIC


@query("save_fit", sql=split_flows_sql() + "\n" + "\nunion all\n".join(
    f"select '{c}' as \"column\", {i} as pos, {sg.r(f'avg({c})')} as mean, {sg.r(f'stddev_pop({c})')} as std "
    f"from sp where split = 'train'" for i, c in enumerate(NUM)))
def save_fit(spark, sf):
    """Standard-scale fit on the train part, saved to the fit store and loaded back."""
    from flowlens.functions.exprs import rnd
    fit = S.fit_standard_scale(split_flows(spark, sf).where(F.col("split") == "train"), NUM)
    root = scratch_path(spark, "fits")
    IO.save_fit(fit, root, "standard_scale")
    back = IO.load_fit(spark, root, "standard_scale", "fit_standard_scale")
    return back.select("column", "pos", rnd("mean").alias("mean"), rnd("std").alias("std"))


@query("load_fit", sql=split_flows_sql() + "\n" + "\nunion all\n".join(
    f"select row_id, '{c}' as \"column\", {sg.r(f'(cast({c} as double) - avg({c}) over ()) / (case when stddev_pop({c}) over () = 0 then 1e0 else stddev_pop({c}) over () end)')} as value "
    f"from sp where split = 'train'" for c in NUM))
def load_fit(spark, sf):
    """Apply a loaded fit: apply(load(save(fit))) equals apply(fit)."""
    from flowlens.functions.exprs import rnd
    from flowlens.operators.profile import unpivot
    train = split_flows(spark, sf).where(F.col("split") == "train")
    root = scratch_path(spark, "fits")
    IO.save_fit(S.fit_standard_scale(train, NUM), root, "standard_scale")
    scaled = S.apply_standard_scale(train, IO.load_fit(spark, root, "standard_scale"))
    return unpivot(scaled, NUM, ids=["row_id"]).select("row_id", "column", rnd("value").alias("value"))


def _scoreboard_sql():
    from flowlens.plans.q_models import _nb_scoreboard_sql
    return _nb_scoreboard_sql()


@query("write_scoreboard", sql=_scoreboard_sql())
def write_scoreboard(spark, sf):
    """Scoreboard of the naive Bayes models written as CSV and read back."""
    from flowlens.plans.q_models import _nb_scoreboard
    sb = _nb_scoreboard(spark, sf)
    path = IO.write_scoreboard(sb, scratch_path(spark, "scoreboard"), "csv")
    return spark.read.schema(sb.schema).option("header", True).csv(path)


def _feedback_json_sql():
    from flowlens.plans.q_feedback import BASE_SQL
    return BASE_SQL + """
select row_id, substr(text, 1, 200) as text, pred as predicted, label as actual,
  case when pred = label then 1 else 0 end as correct, label as corrected_label from pred where part = 'feedback'"""


@query("write_feedback_json", sql=_feedback_json_sql())
def write_feedback_json(spark, sf):
    """Feedback records written as JSON and read back with their schema."""
    from flowlens.operators import feedback as FB
    from flowlens.plans.q_feedback import _initial
    _, pred = _initial(spark, sf)
    rec = FB.feedback_records(pred.where(F.col("part") == "feedback"))
    path = IO.write_feedback_json(rec, scratch_path(spark, "feedback-json"))
    return spark.read.schema(rec.schema).json(path)




# ---------------------------------------------------------------- batch scoring (user predict function)

def batch_scoring(df, make_fn, cols: list[str], batch_size: int, out_schema: str):
    """Apply an external predict function in batches of ``batch_size`` rows.

    ``make_fn()`` runs once per task (model load) and returns fn(pandas.DataFrame) ->
    pandas.DataFrame; rows stream through Arrow batches of ``batch_size``."""
    def run(it):
        fn = make_fn()
        for pdf in it:
            for s in range(0, len(pdf), batch_size):
                yield fn(pdf.iloc[s:s + batch_size][cols].reset_index(drop=True))
    return df.select(*cols).mapInPandas(run, out_schema)


def _batch_scoring_sql():
    from flowlens.plans.q_scorers import _dist_sql, _fit_sql, _scaled_vectors_sql
    return _scaled_vectors_sql() + ",\n" + _fit_sql("fb", 0) + f"""
select t.row_id, {sg.r(_dist_sql('fb', '1e0'))} as score from (select * from sv where split = 'test') t cross join fb"""


@query("batch_scoring", sql=_batch_scoring_sql())
def q_batch_scoring(spark, sf):
    """The benign one-class model of the vectors, exported as plain numbers, applied by a
    numpy predict function in batches of 8 rows."""
    import math

    import numpy as np

    from flowlens.operators.vectors import fit_gaussian_vec
    from flowlens.plans.q_encode import _vector_parts
    train, test = _vector_parts(spark, sf)
    fit = fit_gaussian_vec(train.where(F.col("label") == 0), "vec")[None]
    mean, var = np.array(fit["mean"]), np.array(fit["var"])
    const = float(sum(0.5 * math.log(2 * math.pi * v) for v in var))

    def make_fn():
        import pandas as pd

        def fn(pdf):
            x = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            score = const + 0.5 * (((x - mean) ** 2) / var).sum(axis=1)
            return pd.DataFrame({"row_id": pdf["row_id"].to_numpy(), "score": np.floor(score * 1e6 + 0.5) / 1e6})
        return fn
    return batch_scoring(test, make_fn, ["row_id", "vec"], 8, "row_id long, score double")
