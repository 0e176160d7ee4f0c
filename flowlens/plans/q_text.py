"""Queries: text serialisation and token windows."""

from __future__ import annotations

from flowlens.functions import text as T
from flowlens.operators import tokens as K
from flowlens.plans import fixtures as fx
from flowlens.plans.catalog import query
from flowlens.sources.tables import read_table

LF = f"with lf as ({fx.LABELLED_FLOWS_SQL})"
TEXT_COLS = fx.FLOW_CATEGORICAL + fx.FLOW_BINARY + fx.FLOW_CONSTANT + fx.FLOW_NUMERIC
DOCS = "with d as (select doc_id as row_id, text from documents)"


def _v(c):
    return f"coalesce(cast({c} as varchar), 'nan')"


def _row_text_sql(cols):
    return "concat_ws(', ', " + ", ".join(f"'{c}: ' || {_v(c)}" for c in cols) + ")"


def _values_text_sql(cols):
    return "concat_ws(', ', " + ", ".join(_v(c) for c in cols) + ")"


def _docs(spark, sf):
    """Every document: (row_id, text)."""
    return read_table(spark, sf, "documents", "doc_id", "text").withColumnRenamed("doc_id", "row_id")


@query("row_to_text", sql=LF + f"\nselect row_id, label, {_row_text_sql(TEXT_COLS)} as text from lf")
def row_to_text(spark, sf):
    df = fx.labelled_flows(spark, sf)
    return T.row_to_text(df, TEXT_COLS).select("row_id", "label", "text")


@query("values_to_text", sql=LF + f"\nselect row_id, label, {_values_text_sql(TEXT_COLS)} as text from lf")
def values_to_text(spark, sf):
    df = fx.labelled_flows(spark, sf)
    return T.values_to_text(df, TEXT_COLS).select("row_id", "label", "text")


@query("nested_row_to_text", sql=LF + f""",
inner_t as (select *, {_values_text_sql(TEXT_COLS)} as text from lf)
select row_id, label, {_row_text_sql(TEXT_COLS + ['text'])} as text from inner_t""")
def nested_row_to_text(spark, sf):
    df = fx.labelled_flows(spark, sf)
    return T.nested_row_to_text(df, TEXT_COLS).select("row_id", "label", "text")


@query("truncate_text", sql="select doc_id as row_id, substr(text, 1, 200) as text from documents")
def truncate_text(spark, sf):
    return T.truncate_text(_docs(spark, sf), "text", 200)


_PAT = T.TOKEN_PATTERN.replace("'", "''")


@query("token_window", sql=DOCS + f""",
tk as (select row_id, regexp_extract_all(text, '{_PAT}') as toks from d),
vocab as (select tok, cast(row_number() over (order by tok) + 1 as int) as id
  from (select distinct unnest(toks) as tok from tk) x),
ex as (select row_id, unnest(toks[1:512]) as tok, unnest(range(0, least(len(toks), 512))) as pos from tk),
ids as (select ex.row_id, list(coalesce(v.id, 1) order by ex.pos) as ids from ex left join vocab v on v.tok = ex.tok group by ex.row_id)
select tk.row_id, cast(len(tk.toks) as int) as n_tokens,
  list_concat(coalesce(ids.ids, []::int[]), list_transform(range(0, 512 - len(coalesce(ids.ids, []::int[]))), lambda x: 0)) as input_ids,
  list_concat(list_transform(coalesce(ids.ids, []::int[]), lambda x: 1), list_transform(range(0, 512 - len(coalesce(ids.ids, []::int[]))), lambda x: 0)) as attention_mask
from tk left join ids on ids.row_id = tk.row_id""")
def token_window(spark, sf):
    from flowlens.session import materialize
    d = materialize(K.tokenize(_docs(spark, sf), "text", "tokens").drop("text"), "doc-tokens")
    vocab = materialize(K.build_vocab(d, tokens_col="tokens"), "vocab")
    return K.token_window(d, "text", vocab, "row_id", 512, tokens_col="tokens")


@query("token_budget", sql=DOCS + f""",
tk as (select len(regexp_extract_all(text, '{_PAT}')) as n from d)
select count(*) as n_rows, cast(sum(case when n > 512 then 1 else 0 end) as bigint) as n_over,
  cast(sum(n) as bigint) as tokens_total, cast(sum(greatest(n - 512, 0)) as bigint) as tokens_lost,
  cast(max(n) as bigint) as max_tokens from tk""")
def token_budget(spark, sf):
    return K.token_budget(_docs(spark, sf), "text", 512)
