"""Row-to-text serialisation and whitespace/punctuation tokens, as built-in expressions.

Spark prints doubles the Java way (``1.0E7``, ``1.0E-4``); the reference prints
them the Python way (``10000000.0``, ``0.0001``, ``1e-05``). ``py_str`` rewrites
Spark's text into Python's ``repr`` form with string functions only, so the
serialised rows are the same text the reference feeds its tokenizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Token pattern: a run of word characters, or any single other non-space character (fixed value)
TOKEN_PATTERN = r"\w+|[^\w\s]"
NULL_TEXT = "nan"


def _strip_zeros(digits: Column) -> Column:
    d = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    return F.when(d == "", F.lit("0")).otherwise(d)


def _java_digits_exp(s: Column):
    """(significant digits, decimal exponent) of Java's unsigned Double.toString text."""
    e_form = F.contains(s, F.lit("E"))
    mant = F.when(e_form, F.regexp_extract(s, r"^([0-9.]+)E", 1)).otherwise(s)
    exp_e = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")
    ip = F.regexp_extract(mant, r"^([0-9]+)", 1)
    fp = F.regexp_extract(mant, r"\.([0-9]*)$", 1)
    lead0 = F.length(fp) - F.length(F.regexp_replace(fp, "^0+", ""))
    exp_p = F.when(ip != "0", F.length(ip) - 1).otherwise(-(lead0 + 1))
    digits = _strip_zeros(F.regexp_replace(mant, r"\.", ""))
    return digits, F.when(e_form, exp_e).otherwise(exp_p)


def _sci_digits_exp(t: Column):
    """(significant digits, exponent) of Java's %.Ne text, unsigned."""
    return (_strip_zeros(F.regexp_replace(F.regexp_extract(t, r"^([0-9.]+)e", 1), r"\.", "")),
            F.regexp_extract(t, r"e([-+][0-9]+)$", 1).cast("int"))


def _double_py_str_stages(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Adds, for each (col, out) pair, ``out`` = Python repr text of double column ``col``.

    Built as a few projections (all columns per projection) so each intermediate
    (digits, exponent, ...) is computed once per row: one big nested expression
    would repeat them many times over, and one projection per column per step
    would make the plan long to analyse."""
    def stage(frame, make):
        adds = []
        for col, out in pairs:
            adds += make(col, f"__pys_{out}")
        return frame.select("*", *adds)

    def c_of(col):
        return F.col(col).cast("double")

    # Fast path: in [1e-3, 1e7) Java prints positional text like Python; only long
    # (possibly non-shortest) or out-of-range values take the rewriting path below.
    def s1(col, t):
        c = c_of(col)
        js = c.cast("string")
        a0 = F.abs(c)
        fast = c.isNull() | (c == 0) | ((a0 >= 1e-3) & (a0 < 1e7) & (F.length(js) < 18))
        return [fast.alias(t + "fast"), F.startswith(js, F.lit("-")).alias(t + "neg"),
                F.when(~fast, F.regexp_replace(js, "^-", "")).alias(t + "s")]

    def s2(col, t):
        d0, e0 = _java_digits_exp(F.col(t + "s"))
        return [d0.alias(t + "d0"), e0.alias(t + "e0")]

    # Java's Double.toString is not always the shortest text (it can print 17-18
    # digits); then take the shortest correctly rounded 15/16/17-digit form that
    # parses back to the same double, which is what Python prints.
    def s3(col, t):
        a = F.abs(c_of(col))
        c15, c16, c17 = (F.format_string(f"%.{p - 1}e", a) for p in (15, 16, 17))
        long_java = F.length(F.col(t + "d0")) >= 17
        pick = F.when(~long_java | F.col(t + "s").isNull(), F.lit(None).cast("string")) \
            .when(c15.try_cast("double") == a, c15).when(c16.try_cast("double") == a, c16).otherwise(c17)
        return [pick.alias(t + "pick")]

    def s4(col, t):
        d2, e2 = _sci_digits_exp(F.col(t + "pick"))
        d = F.when(F.col(t + "pick").isNull(), F.col(t + "d0")).otherwise(d2)
        e = F.when(F.col(t + "pick").isNull(), F.col(t + "e0")).otherwise(e2)
        return [d.alias(t + "d"), e.alias(t + "e"), F.length(d).alias(t + "n")]

    def s5(col, t):
        c = c_of(col)
        digits, exp, nd = F.col(t + "d"), F.col(t + "e"), F.col(t + "n")
        big = F.lit(1 << 20)
        int_part = F.when(nd <= exp + 1, F.concat(digits, F.repeat(F.lit("0"), exp + 1 - nd))) \
            .otherwise(digits.substr(F.lit(1), exp + 1))
        frac_part = F.when(nd <= exp + 1, F.lit("0")).otherwise(digits.substr(exp + 2, big))
        positional = F.when(exp >= 0, F.concat(int_part, F.lit("."), frac_part)) \
            .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -exp - 1), digits))
        m = F.when(nd == 1, digits).otherwise(F.concat(digits.substr(F.lit(1), F.lit(1)), F.lit("."),
                                                        digits.substr(F.lit(2), big)))
        e_txt = F.concat(F.when(exp < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(exp).cast("string"), 2, "0"))
        conv = F.when((exp >= -4) & (exp <= 15), positional).otherwise(F.concat(m, F.lit("e"), e_txt))
        conv = F.concat(F.when(F.col(t + "neg"), F.lit("-")).otherwise(F.lit("")), conv)
        special = (F.when(F.isnan(c), F.lit("nan"))
                   .when(c == float("inf"), F.lit("inf"))
                   .when(c == float("-inf"), F.lit("-inf")))
        text = (F.when(c.isNull(), F.lit(NULL_TEXT))
                .when(c == 0, F.when(F.col(t + "neg"), F.lit("-0.0")).otherwise(F.lit("0.0")))
                .when(F.col(t + "fast"), c.cast("string")).otherwise(F.coalesce(special, conv)))
        return [text.alias(t + "text")]

    out = df
    for make in (s1, s2, s3, s4, s5):
        out = stage(out, make)
    helpers = [f"__pys_{o}{x}" for _, o in pairs for x in ("fast", "neg", "s", "d0", "e0", "pick", "d", "e", "n")]
    return out.select(*[c for c in df.columns], *[F.col(f"__pys_{o}text").alias(o) for _, o in pairs]) \
        if helpers else out


def py_str(df: DataFrame, col: str) -> Column:
    """Python ``str(value)`` of a non-floating column, null -> 'nan' (doubles: ``py_str_frame``)."""
    dtype = dict(df.dtypes)[col]
    c = F.col(col)
    if dtype in ("double", "float"):
        raise TypeError("use py_str_frame for floating columns")
    if dtype == "boolean":
        return F.when(c.isNull(), F.lit(NULL_TEXT)).when(c, F.lit("True")).otherwise(F.lit("False"))
    return F.coalesce(c.cast("string"), F.lit(NULL_TEXT))


def py_str_frame(df: DataFrame, cols: list[str], prefix: str = "__s_") -> DataFrame:
    """Adds ``prefix + col`` = Python text of each column."""
    types = dict(df.dtypes)
    out = df.select("*", *[py_str(df, c).alias(prefix + c) for c in cols if types[c] not in ("double", "float")])
    pairs = [(c, prefix + c) for c in cols if types[c] in ("double", "float")]
    return _double_py_str_stages(out, pairs) if pairs else out


def row_to_text(df: DataFrame, cols: list[str], out: str = "text") -> DataFrame:
    """'col: value, col: value' over ``cols`` in order."""
    staged = py_str_frame(df, cols)
    parts = [F.concat(F.lit(f"{c}: "), F.col(f"__s_{c}")) for c in cols]
    return staged.withColumn(out, F.concat_ws(", ", *parts)).drop(*[f"__s_{c}" for c in cols])


def values_to_text(df: DataFrame, cols: list[str], out: str = "text") -> DataFrame:
    """'v1, v2, ...' over ``cols`` in order."""
    staged = py_str_frame(df, cols)
    return staged.withColumn(out, F.concat_ws(", ", *[F.col(f"__s_{c}") for c in cols])) \
        .drop(*[f"__s_{c}" for c in cols])


def nested_row_to_text(df: DataFrame, cols: list[str], out: str = "text") -> DataFrame:
    """values_to_text, then row_to_text over the columns plus that text (values appear twice)."""
    inner = values_to_text(df, cols, out)
    return row_to_text(inner, cols + [out], out)


def truncate_text(df: DataFrame, col: str = "text", n: int = 200, out: str | None = None) -> DataFrame:
    """First n characters (display copy; training uses the full text)."""
    return df.withColumn(out or col, F.substring(F.col(col), 1, n))


def tokens(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)
