"""Readers, writers, folder ingest with file quarantine, and the fit store.

* CSV is read with an explicit schema (no inference) where the layout is known.
  Whether the file has a header is an argument, never a guess: the reference's
  two loaders disagree on it for the same file name.
  A field that does not fit its column's type fails the read (FAILFAST).
* Folder ingest reads each file by its own header: a pass over the text finds the header lines
  and the files whose records hold line breaks (``quoted_csv``), files with the same header (of
  one class folder, whose name is the label) are parsed together, and the groups are unioned by column name. The parsed text is
  written once; from it come the bad files, the column types (one aggregation: whole
  numbers, numbers, else text) and the rows. A file with a row that has more fields than
  its header is quarantined whole: it contributes no rows and is reported. (The
  reference's reader refuses such a file where the row is a later one; a file of which
  *every* row is longer it reads with a shifted index. That case is quarantined too, on
  purpose.)
* Fits are small DataFrames saved as Parquet under one folder; loading a
  missing fit names the step that produces it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import materialize
from flowlens.sources import quoted_csv

EXTRA_COL = "__extra_field"


class MissingFitError(FileNotFoundError):
    pass


def read_flows_headerless(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", False).option("mode", "FAILFAST").csv(path)


def read_flows_header(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header row present; its names must match the schema (checked by Spark)."""
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False)
            .option("mode", "FAILFAST").csv(path))


def write_flows_csv(df: DataFrame, path: str, header: bool) -> str:
    df.write.mode("overwrite").option("header", header).csv(path)
    return path


def write_flows_parquet(df: DataFrame, path: str, partition: str | None = "label") -> str | None:
    """Write the combined table; nothing is written when there are no rows."""
    if df.limit(1).count() == 0:
        return None
    w = df.write.mode("overwrite")
    if partition:
        w = w.partitionBy(partition)
    w.parquet(path)
    return path


def read_flows_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Concatenate frames with differing columns; a missing column is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def _column_names(header: str) -> list[str]:
    """Names of a header line; a repeated name gets .1, .2, ... as in the reference's reader."""
    import csv
    names, seen = [], {}
    for name in next(csv.reader([header.lstrip("\ufeff")])):
        n = seen.get(name, 0)
        seen[name] = n + 1
        names.append(f"{name}.{n}" if n else name)
    return names


def _parse_folders(spark: SparkSession, root: str, classes: list[str], drop: tuple, escape: str) -> tuple[DataFrame, DataFrame]:
    """Every parsed row as text, by column name, with label, __file and whether it has a field too many;
    and the files that end inside a quoted field (file, folder, n_rows)."""
    lines = {cls: quoted_csv.lines_of(spark, f"{root}/{cls}") for cls in classes}
    blocks = materialize(union_by_name(*[quoted_csv.survey(x, escape).withColumn("folder", F.lit(c)) for c, x in lines.items()]),
                         "ingest-blocks")
    frames = []

    def add(cls: str, header: str, parse):
        names = _column_names(header)
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))]
                              + [T.StructField(EXTRA_COL, T.StringType())])
        frames.append(parse(schema).select(
            *[F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n not in drop],
            F.col(EXTRA_COL).isNotNull().alias(EXTRA_COL), F.lit(cls).alias("__folder"), "__file"))

    # files without line breaks in their records: Spark's reader, all files of one header together
    plain = blocks.where("at = 0 and not broken").groupBy("folder", "head").agg(F.sort_array(F.collect_list("file")).alias("files"))
    # file names, which Spark lists on the driver anyway
    for r in sorted(plain.collect(), key=lambda r: (r["folder"], r["head"])):
        add(r["folder"], r["head"], lambda schema, r=r: (
            spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("escape", escape)
            .option("mode", "PERMISSIVE").csv(list(r["files"])).withColumn("__file", F.col("_metadata.file_path"))))
    # files with line breaks in their records: records are put together first
    broken = blocks.where("broken and not unclosed")
    for cls in sorted(r["folder"] for r in broken.select("folder").distinct().collect()):
        starts = broken.where(F.col("folder") == cls).select("file", "at", "inside")
        recs = materialize(quoted_csv.records(lines[cls], starts, lambda df: materialize(df, "ingest-parts"), escape),
                           "ingest-records")
        heads = recs.where("first").select("file", F.col("text").alias("head"))
        for header in sorted(r["head"] for r in heads.select("head").distinct().collect()):
            rows = recs.where("not first").join(heads.where(F.col("head") == header).select("file"), "file", "left_semi")
            add(cls, header, lambda schema, rows=rows: rows.select(
                F.from_csv("text", schema.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "escape": escape}).alias("r"),
                F.col("file").alias("__file")).select("r.*", "__file"))
    unclosed = blocks.where("unclosed").groupBy("file", "folder").agg((F.sum("n_lines") - 1).alias("n_rows"))
    if not frames:
        if blocks.limit(1).count():
            raise ValueError(f"every file in the class folders under {root} ends inside a quoted field")
        raise FileNotFoundError(f"no file in the class folders under {root}")
    return materialize(union_by_name(*frames), "ingest"), unclosed


def ingest_labelled_folders(spark: SparkSession, root: str, classes: list[str],
                            drop: tuple = ("Label",), escape: str = "\\") -> tuple[DataFrame, DataFrame]:
    """Rows of every readable CSV under root/<class>/ with label = class, and the bad files
    (file, folder, n_rows): those with a row longer than the header, and those that end inside a quoted
    field (n_rows: lines after the first). ``escape`` hides a quote inside a quoted field: a backslash, or
    the quote itself for files that double their quotes. Line breaks inside a quoted field belong to it."""
    text, unclosed = _parse_folders(spark, root.rstrip("/"), classes, drop, escape)
    per_file = text.groupBy("__file", "__folder").agg(F.max(EXTRA_COL).alias("bad"), F.count(F.lit(1)).alias("n_rows"))
    bad = per_file.where("bad").select(F.col("__file").alias("file"), F.col("__folder").alias("folder"), "n_rows")
    bad = materialize(bad.unionByName(unclosed), "ingest-bad")
    good = text.join(bad.select(F.col("file").alias("__file")), "__file", "left_anti")
    cols = [c for c in text.columns if c not in ("__file", "__folder", EXTRA_COL)]
    checks = []
    for i, c in enumerate(cols):
        v = F.col(f"`{c}`")
        checks += [F.count(v).alias(f"n{i}"), F.count(F.expr(f"try_cast(trim(`{c}`) as bigint)")).alias(f"w{i}"),
                   F.count(F.expr(f"try_cast(trim(`{c}`) as double)")).alias(f"d{i}")]
    sums = good.agg(*checks).first()

    def typed(i: int, c: str):
        v = F.col(f"`{c}`")
        if sums[f"n{i}"] and sums[f"n{i}"] == sums[f"w{i}"]:
            return F.trim(v).cast("bigint").alias(c)
        return F.trim(v).cast("double").alias(c) if sums[f"n{i}"] and sums[f"n{i}"] == sums[f"d{i}"] else v

    return good.select(*[typed(i, c) for i, c in enumerate(cols)], F.col("__folder").alias("label")), bad


def quarantine_bad_files(rows_and_bad: tuple[DataFrame, DataFrame]) -> DataFrame:
    """The (file, folder, n_rows) list of quarantined files."""
    return rows_and_bad[1]


def save_fit(fit: DataFrame, root: str, name: str) -> str:
    path = f"{root.rstrip('/')}/{name}"
    fit.write.mode("overwrite").parquet(path)
    return path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system of the path (local, HDFS, object stores)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_fit(spark: SparkSession, root: str, name: str, made_by: str = "the matching fit_* step") -> DataFrame:
    path = f"{root.rstrip('/')}/{name}"
    if not path_exists(spark, path):
        raise MissingFitError(f"fit {name!r} not found under {root}: run {made_by} and save_fit first")
    return spark.read.parquet(path)


def write_scoreboard(df: DataFrame, path: str, fmt: str = "csv") -> str:
    w = df.coalesce(1).write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
    return path


def write_feedback_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path
