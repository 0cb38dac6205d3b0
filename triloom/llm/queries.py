"""The queries over the driver's tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, html_text, licenses, packing, pii, quality_cnn, quality_rules, setjoin, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; it is installed on every machine of the cluster."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(5)) == 0


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), longest=2048, end_id=1, keep_ids=False)
    return got.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files /source/lang/doc_id.txt."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(".txt"))
    got = licenses.scan(docs.select("doc_id", "text", path.alias("path")))
    return got.select("doc_id", "own_license", F.round("own_score", 6).alias("own_score"), "inherited_license", "license_dir", "license")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, directory = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(directory, captures).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), pii.train())


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_cnn.Net:
    """The quality network, from labelled rows that aren't held out."""
    return quality_cnn.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    got = quality_cnn.score(docs, fitted(spark, docs, sf_dir), threshold=0.3)
    return got.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"), size=4, percent=85)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_near_dedup, op2_packing, op3_license_scan, op4_html_extraction, op5_warc, op6_byte_bpe, op7_pii, op8_quality_classifier, op9_quality_rules, op10_ngram_jaccard)}


_REACH = """
, reach as (select id, id as node from nodes union select r.id, l.v from reach r join links l on l.u = r.node)
"""

OP1 = """
with recursive vectors as (select vec_id as id, embedding::double[] as v from embeddings),
sound as (select * from vectors where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (select a.id as u, b.id as v from sound a join sound b on a.id <> b.id and len(a.v) = len(b.v)
          where list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.95),
nodes as (select distinct u as id from links)""" + _REACH + """
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.c, e.vec_id) as component_id, coalesce(c.c, e.vec_id) = e.vec_id as kept
from embeddings e left join (select u, count(*) as n from links group by u) n on n.u = e.vec_id
left join (select id, min(node) as c from reach group by id) c on c.id = e.vec_id
"""



def op3_sql() -> str:
    """Plain counts over all files; the templates' terms are written into the text."""
    known = licenses.known_templates()
    templates = ", ".join(f"({k}, '{name}', {full}, {least})" for k, (name, _, full, least) in enumerate(known))
    vectors = ", ".join(f"({k}, '{w}', {ws.count(w)})" for k, (_, ws, _, _) in enumerate(known) for w in sorted(set(ws)))
    words = ", ".join(f"('{w}')" for w in licenses.FUNCTION_WORDS)
    split = "list_filter(regexp_split_to_array(%s, '[^a-z0-9]+'), lambda x: x <> '')"
    return f"""
with t(k, name, whole, least) as (values {templates}), tv(k, term, tf) as (values {vectors}), fw(term) as (values {words}),
docs as (select row_number() over () as r, doc_id, '/' || coalesce(source, '') || '/' || coalesce(lang, '') || '/' || coalesce(doc_id::varchar, '') || '.txt' as path,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
d as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, {split % "text"} as w, list_filter(list_transform(string_split(text, chr(10)), lambda l: {split % "l"}), lambda l: len(l) > 0) as ls from docs),
words as (select r, unnest(w) as term from d),
df as (select term, count(distinct r) as df from words group by term),
weight as (select term, ln(((select count(*) from docs) + 1) / (coalesce(df, 0) + 1)) + 1 as w from (select term from tv union select term from words) left join df using (term)),
tw as (select k, term, tf * w as x from tv join weight using (term)),
size as (select k, sqrt(sum(x * x)) as size from tw group by k),
strange as (select k from tw join size using (k) join t using (k) where not whole and term in (select term from fw) group by k, size, least having sum(x * x) >= (least * size) ** 2 * (1 - 1e-9)),
content as (select distinct term from tv join t using (k) where not whole and (term not in (select term from fw) or k in (select k from strange))),
lines as (select r, unnest(range(len(ls))) as i, unnest(ls) as l from d),
lw as (select r, i, unnest(l) as term from lines),
heads as (select distinct r, i from lw where term in (select term from content)),
runs as (select a.r, a.i as pos, k from heads a, range(1, {licenses.WRAP + 1}) k(k) join heads b on b.r = a.r and b.i >= a.i and b.i < a.i + k group by a.r, a.i, k having count(*) = k),
bags as (select r, pos, k, term, count(*) as tf from runs join lw using (r) where i >= pos and i < pos + k group by all union all select r, -1, 0, term, count(*) from words group by all),
bw as (select r, pos, b.k, term, tf * w as y from bags b join weight using (term)),
norms as (select r, pos, k, sqrt(sum(y * y)) as norm from bw group by all),
dots as (select r, pos, bw.k, tw.k as template, sum(y * x) as dot from bw join tw using (term) group by all),
scored as (select dots.r, dots.pos, dots.k, name, round(dot / norm / size, 9) as score from dots join norms using (r, pos, k) join t on t.k = template join size on size.k = template where (dots.pos < 0 or not whole) and round(dot / norm / size, 9) >= least),
best as (select r, first(name order by score desc, name) as own, max(score) as score, bool_or(pos < 0) as all_of_it from scored group by r),
covered as (select r, sum(len(l)) as n from lines where exists (select 1 from scored s where s.r = lines.r and s.pos <= lines.i and lines.i < s.pos + s.k) group by r),
own as (select d.r, doc_id, path, dir, own, score, coalesce(all_of_it or n >= 0.5 * len(w), false) as is_file from d left join best using (r) left join covered using (r)),
owners as (select dir as above, first(own order by score desc, path, own) as inherited from own where is_file group by dir),
dirs as (select dir, depth, array_to_string(list_slice(string_split(dir, '/'), 1, depth), '/') as above from (select dir, unnest(range(len(string_split(dir, '/')) + 1)) as depth from (select distinct dir from own))),
nearest as (select dir, arg_max(inherited, depth) as inherited, arg_max(above, depth) as license_dir from dirs join owners using (above) group by dir)
select doc_id, own as own_license, round(score, 6) as own_score, inherited as inherited_license, license_dir, coalesce(own, inherited) as license from own left join nearest using (dir)
"""


#: White space of the vocabulary's pattern as RE2 has to be told, and a private character that parts texts before the last blank of a run.
RE2_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def op6_sql() -> str:
    """Plain byte-pair merging: every word from its bytes, one merge at a time, over the vocabulary file."""
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    words = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{RE2_SPACE}\\p{{L}}\\p{{N}}]+|[{RE2_SPACE}]+".replace("'", "''")
    return f"""
with recursive vocabulary as materialized (select hex(from_base64(t)) as h, r::int as rank from read_csv('{path}', delim=' ', header=false, quote='', escape='', columns={{'t': 'varchar', 'r': 'int'}})),
merges as materialized (select a.rank as a, b.rank as b, v.rank as rank from (select h, rank, unnest(range(1, len(h) // 2)) as k from vocabulary) v
  join vocabulary a on a.h = left(v.h, 2 * k) join vocabulary b on b.h = substr(v.h, 2 * k + 1)),
docs as materialized (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
parts as (select r, unnest(range(len(p))) as i, unnest(p) as part from (select r, string_split(regexp_replace(text, '([{RE2_SPACE}])([{RE2_SPACE}][^{RE2_SPACE}])', '\\1' || chr(57344) || '\\2', 'g'), chr(57344)) as p from docs)),
words as materialized (select r, i, unnest(range(len(w))) as j, unnest(w) as word from (select r, i, regexp_extract_all(part, '{words}') as w from parts)),
bytes as materialized (select word, i, v.rank as token from (select word, x, unnest(range(len(x) // 2)) as i from (select distinct word, hex(encode(word)) as x from words)) join vocabulary v on v.h = substr(x, 2 * i + 1, 2)),
ranked as (select word, i, token, m.rank from (select *, lead(token) over (partition by word order by i) as after from bytes) s left join merges m on m.a = s.token and m.b = s.after),
state(word, t, m) as (
  select word, list(token order by i), list(coalesce(rank, 2000000000) order by i) from ranked group by word
  union all
  select word, t[1:i - 1] || [least] || t[i + 2:], m[1:greatest(i - 2, 0)] || (case when i > 1 then [coalesce(x.rank, 2000000000)] else []::int[] end) || [coalesce(y.rank, 2000000000)] || m[i + 2:]
  from (select word, t, m, least, list_position(m, least) as i from (select *, list_min(m) as least from state) where least < 2000000000) s
  left join merges x on x.a = t[i - 1] and x.b = least left join merges y on y.a = least and y.b = t[i + 2]),
ended as (select word, unnest(range(len(t))) as k, unnest(t) as token from state where list_min(m) = 2000000000),
spelt as materialized (select word, count(*) as n, string_agg(printf('%02X%02X%02X%02X', token & 255, (token >> 8) & 255, (token >> 16) & 255, token >> 24), '' order by k) as ids, string_agg(v.h, '' order by k) as h from ended join vocabulary v on v.rank = token group by word),
got as (select r, sum(n) as n, string_agg(ids, '' order by i, j) as ids, string_agg(h, '' order by i, j) as h from words join spelt using (word) group by r)
select doc_id, coalesce(n, 0)::bigint as n_tokens, sha256(unhex(coalesce(ids, ''))) as ids_sha256, sha256(unhex(coalesce(h, ''))) as decoded_sha256 from docs left join got using (r)
"""


OP9 = r"""
with docs as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
words as (select r, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from docs),
lines as (select r, count(*) as n, count(*) - count(distinct l) as dup from (select r, unnest(string_split(text, chr(10))) as l from docs) where regexp_matches(l, '[^\x20\x09-\x0D]') group by r),
windows as (select r, i, array_to_string(list_slice(w, i, i + 7), ' ') as x from (select r, w, unnest(range(1, len(w) - 6)) as i from words where len(w) >= 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, x) as n from windows) where n > 1),
covered as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from twice) group by r),
m as (select w.r, doc_id, coalesce('s:' || source, 'none') as host, len(w.w)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(l.dup, 0)::bigint as n_dup_lines, coalesce(l.n, 0) as n_lines, coalesce(c.n, 0)::bigint as n_repeat_words
      from words w left join lines l using (r) left join covered c using (r)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
        (4 * n_symbols > n_words)::int + (100 * n_dup_lines > 30 * n_lines)::int + (10 * n_repeat_words > n_words)::int + (word_chars < 2 * n_words or word_chars > 20 * n_words)::int as soft from m),
hosts as (select host, count(*) as n, sum((base_failed or soft > 0)::int) as failed from f group by host),
prior as (select least(greatest(sum(failed) / sum(n), 0.0001), 0.9999) as mean, var_pop(failed / n) as var, avg(1 / n) as inverse from hosts),
strength as (select mean, least(greatest(mean * (1 - mean) / greatest(var - mean * (1 - mean) * inverse, 0.000001) - 1, 2), 1000000) as s from prior),
rated as (select host, (failed + mean * s) / (n + s) as rate from hosts, strength)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and soft < case when rate >= 0.5 then 1 else 2 end as kept from f join rated using (host)
"""

#: Payload digests in base 32: five bits at a time of the hexadecimal SHA-1, whose 160 bits need no padding.
OP5 = """
with p as (select row_number() over () as r, page_id, encode(coalesce(html, '')) as b from pages),
d as (select *, sha1(b) as h from p),
bits as (select *, array_to_string(list_transform(string_split(h, ''), lambda c: right(bin(16 + instr('0123456789abcdef', c) - 1), 4)), '') as x from d),
digests as (select *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: substr(x, 5 * i + j + 1, 1)::int * (16 >> j)))::int, 1)), '') as digest from bits),
firsts as (select h, min(page_id) as least from d group by h)
select page_id, octet_length(b)::bigint as payload_bytes, digest as payload_digest, case when least is null or page_id = least then 'response' else 'revisit' end as record_type, case when page_id <> least then least end as refers_to
from digests join firsts using (h)
"""

OP10 = r"""
with recursive words as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
shingles as (select distinct doc_id, array_to_string(list_slice(w, i, i + 3), ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) as i from words where len(w) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
two as (select a.doc_id as u, b.doc_id as v, count(*) as c from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select u, v from two join sizes x on x.doc_id = u join sizes y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
nodes as (select distinct u as id from links)""" + _REACH + """
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, coalesce(c.c, d.doc_id) as component_id
from documents d left join sizes s using (doc_id) left join (select id, min(node) as c from reach group by id) c on c.id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1, "op3_license_scan": op3_sql(), "op5_warc": OP5, "op6_byte_bpe": op6_sql(), "op9_quality_rules": OP9, "op10_ngram_jaccard": OP10}
