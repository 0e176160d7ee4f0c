"""Queries of this subpackage (and their oracle SQL where DuckDB can say them)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op10_simhash_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.simhash import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, max_bits=2)


def tokenizer_file(name: str) -> bytes:
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.packing import pack, with_digests
    pieces = pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), max_len=1024, end_id=0)
    return with_digests(pieces).drop("ids")


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.sentencepiece_codec import encode_documents
    got = encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.language_id import fit, held_out, predict
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query("op4_suffix_array_dedup", """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
s as (select doc_id, i, sha256(substr(h, 2 * i + 1, 200)) as s from (select doc_id, h, unnest(range(0, n - 99)) as i from d where n >= 100) x),
w as (select doc_id, i, row_number() over (partition by s order by doc_id, i) as k from s),
r as (select doc_id, i, i - lag(i) over (partition by doc_id order by i) as step from w where k > 1),
g as (select doc_id, i, sum(case when step <= 100 then 0 else 1 end) over (partition by doc_id order by i
    rows between unbounded preceding and current row) as run from r),
b as (select doc_id, run, min(i) as a, max(i) + 100 as e from g group by doc_id, run),
c as (select doc_id, a, e, coalesce(lag(e) over (partition by doc_id order by a), 0) as before from b),
k as (select c.doc_id, sum(e - a) as removed, count(*) as spans, max(e) as last,
    string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' order by a) as head from c join d on d.doc_id = c.doc_id group by c.doc_id)
select d.doc_id, cast(d.n as bigint) as n_bytes, cast(coalesce(k.removed, 0) as bigint) as n_removed,
  coalesce(k.spans, 0) as n_spans,
  sha256(unhex(coalesce(k.head, '') || substr(d.h, 2 * coalesce(k.last, 0) + 1))) as kept_sha256
  from d left join k on k.doc_id = d.doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.substring_dedup import remove_repeats
    got = remove_repeats(read_table(spark, sf_dir, "documents"), length=100)
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


# base 32 of a SHA-1 in hex: five hex digits are four letters
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * g + 1}, 5))::int >> {s}) & 31) + 1, 1)"
                      for g in range(8) for s in (15, 10, 5, 0))


@query("op7_warc", f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h,
    min(page_id) over (partition by coalesce(html, '')) as first from pages)
select page_id, octet_length(encode(html)) as payload_bytes, {_BASE32} as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from p""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.warc import judge, read_archive, write_archive
    index = write_archive(judge(read_table(spark, sf_dir, "pages"), min_bytes=0))
    return read_archive(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_exact_top_k", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.topk import top_k
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


#: The rules of the task: (host, path, verdict)
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def _url_rules():
    from flowlens.llm.url_filters import Rule
    return [Rule(*r) for r in URL_RULES]


@query("op2_url_filters")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.url_filters import judge_urls
    return judge_urls(read_table(spark, sf_dir, "pages"), _url_rules())


def _op2_sql() -> str:
    from flowlens.llm.url_filters import oracle
    return oracle(_url_rules())


ORACLE["op2_url_filters"] = _op2_sql()


@query("op3_lm_scoring", r"""
with t as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as ws from documents),
u as (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as i from t),
v as (select doc_id, i, w, lag(w) over p as w1, lag(w, 2) over p as w2 from u window p as (partition by doc_id order by i)),
c as (select doc_id, i, (select count(*) from u) - count(*) over (partition by doc_id) as others,
    count(*) over (partition by w) - count(*) over (partition by doc_id, w) as r1,
    case when w1 is null then 0 else count(*) over (partition by w1, w) - count(*) over (partition by doc_id, w1, w) end as r2,
    case when w2 is null then 0 else count(*) over (partition by w2, w1, w) - count(*) over (partition by doc_id, w2, w1, w) end as r3 from v),
x as (select *, lag(r1) over p as x1, lag(r2) over p as x2, cast(greatest(others, 1) as double) as n
    from c window p as (partition by doc_id order by i)),
y as (select doc_id, case when r3 > 0 and x2 > 0 then r3 / x2 when r2 > 0 and x1 > 0 then r2 / x1 * 0.4e0
    when r1 > 0 then r1 / n * pow(0.4e0, 2) else 0.4e0 / n * pow(0.4e0, 2) end as s from x),
z as (select doc_id, cast(sum(cast(floor(-log2(s) * 1000 + 0.5) as bigint)) as bigint) as cost from y group by doc_id)
select t.doc_id, len(t.ws) as n_words, coalesce(z.cost, 0) as cost,
  case when len(t.ws) > 0 then -z.cost / 1000e0 / len(t.ws) end as score from t left join z on z.doc_id = t.doc_id""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.lm_score import score_documents
    return score_documents(read_table(spark, sf_dir, "documents"), order=3, alpha=0.4)


@query("op5_embedding_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.nn_descent import near_duplicates
    return near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


@query("op11_token_counts")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.token_counts import count_tokens
    got = count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > 2048)


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """The task's rewrite of a tenth of the documents: (first word, period) by the id's CRC-32; a null id has none."""
    import zlib
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or n == 0:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


# CRC-32 of the id's decimal digits, bit by bit
_CRC = ("xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)),"
        " lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda x, y: xor(x >> 1, 3988292384::bigint * (x & 1)))), 4294967295::bigint)")


@query("op12_periodic_runs", rf"""
with t as (select doc_id, {_CRC} as h, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as o from documents),
s as (select doc_id, o, len(o) as n, h, h // 10 as g from t),
p as (select *, case when h % 10 = 0 and n > 0 then g % n else n end as a, 1 + (n - case when n > 0 then g % n else 0 end) // (3 + g % 8) as p from s),
w as (select doc_id, n, list_transform(range(n), lambda i: case when i >= a then o[(a + (i - a) % p + 1)::int] else o[(i + 1)::int] end) as w from p),
u as (select doc_id, n, w, unnest(range(0, n - 15)) as i from w where n >= 24),
x as (select doc_id, n, i, array_to_string(list_slice(w, i + 1, i + 16), ' ') as s from u),
e as (select l.doc_id, l.i, r.i - l.i as q from x l join x r on l.doc_id = r.doc_id and l.s = r.s and r.i > l.i where 3 * (r.i - l.i) <= l.n),
k as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as island from e),
b as (select doc_id, q, min(i) as a, max(i) + 16 - min(i) + q as len from k group by doc_id, q, island),
c as (select * from b where len >= greatest(24, 3 * q)),
r as (select * from c where not exists (select 1 from c d where d.doc_id = c.doc_id and d.q < c.q and d.a <= c.a and d.a + d.len >= c.a + c.len)),
d as (select r.doc_id, r.a, r.len, r.q, row_number() over (partition by r.doc_id order by r.len::double / r.q desc, a, q) as rk from r),
f as (select doc_id, count(*) as n_runs, max(case when rk = 1 then a end) as start, max(case when rk = 1 then len end) as length,
    max(case when rk = 1 then q end) as period, string_agg(a || ',' || len || ',' || q || chr(10), '' order by a, q) as lines from d group by doc_id),
gone as (select distinct doc_id, unnest(range(a + q, a + len)) as i from r),
words as (select doc_id, unnest(w) as word, unnest(range(n)) as i from w),
z as (select words.doc_id, string_agg(word, ' ' order by words.i) as kept from words anti join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id)
select w.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept, '')) as collapsed_sha256
  from w left join f on f.doc_id = w.doc_id left join z on z.doc_id = w.doc_id""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.periodic_runs import collapse_runs, with_digests
    return with_digests(collapse_runs(read_table(spark, sf_dir, "documents"), min_length=24, min_exponent=3, rewrite=repeated_tail))


@query("op13_collocations", r"""
with d as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\n\x0B\f\r]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as ws from d),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(list_slice(ws, i, i + k - 1), ' '))) as phrase
  from w, (select unnest(range(1, 6)) as k) ks where len(ws) >= k),
f as (select lang, k, phrase, count(*) as c from g group by lang, k, phrase),
t as (select lang, cast(sum(c) as bigint) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, c as a, string_split(phrase, ' ') as ws from f where k > 1 and c >= 100),
x as (select lang, k, phrase, a, ws, unnest(range(1, k)) as cut from c),
y as (select x.lang, x.k, x.phrase, a, cut, l.c as l, r.c as r, n, cast((1000::hugeint * a * n) // (l.c::hugeint * r.c) as bigint) as score from x
  join f l on l.lang = x.lang and l.k = cut and l.phrase = array_to_string(x.ws[:cut], ' ')
  join f r on r.lang = x.lang and r.k = x.k - cut and r.phrase = array_to_string(x.ws[cut + 1:], ' ') join t on t.lang = x.lang),
z as (select *, row_number() over (partition by lang, phrase order by score, cut) as best from y),
v as (select * from z where best = 1 and not exists (select 1 from c q where q.lang = z.lang and q.k > z.k and 100 * q.a >= 100 * z.a
    and contains(' ' || q.phrase || ' ', ' ' || z.phrase || ' '))),
o as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from v)
select * from o where rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowlens.llm.collocations import mine
    return mine(read_table(spark, sf_dir, "documents"), support=100, max_words=5, top=2000)
