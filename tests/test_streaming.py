"""A fitted scaler and the label rule applied to a file stream equal the batch result."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlens.functions.labels import binarize_equals
from flowlens.operators import scale as S
from flowlens.plans import fixtures as fx
from flowlens.session import scratch_path
from flowlens.streaming.apply import score_stream


def test_stream_apply_matches_batch(spark):
    flows = fx.flows(spark, SF_SMALL)
    src = scratch_path(spark, "stream-src")
    flows.repartition(3).write.parquet(src)
    fit = S.fit_standard_scale(flows, fx.FLOW_NUMERIC)
    S._params(fit)  # fit is collected once; the projection below holds literals only

    def step(df):
        return S.apply_standard_scale(binarize_equals(df, "attack_type"), fit).select("row_id", "label", "amount")

    out = score_stream(spark, src, flows.schema, step, scratch_path(spark, "stream-out"))
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    exp = sorted(tuple(r) for r in step(flows).collect())
    assert got == exp and len(got) == flows.count()
    assert F is not None
