"""flowlens: labelled flow-table analytics as Spark DataFrame / SQL / MLlib jobs.

Layout
------
sources/    readers, folder ingest with file quarantine, Parquet/JSON/CSV sinks, fit store
functions/  column expressions (labels, text serialisation, exact rounding)
operators/  profiling, encoders, scalers, splits, ranks and curves, models, metrics, feedback
plans/      fixtures over the test tables and the query catalogue used by ``__spark_entry__``
streaming/  applying fitted steps to a streaming DataFrame

Every operator takes and returns lazy DataFrames; only model-size objects
(dictionaries, per-class parameters, metric rows) ever reach the driver.
"""

__all__ = ["session"]
