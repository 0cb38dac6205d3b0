"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .conf import Conf
from .engine import Engine
from .functions import terms
from .plans.parser import parse
from .sources.ntriples import parse_lines, read_ntriples
from .sources.tables import FrameTriples, open_tables

PREFIX = "PREFIX p: <urn:p/>\n"


def decoded(c: Column, kind: str) -> Column:
    """A result column as a relational type: id of an IRI, or a literal's value."""
    if kind == "id":
        return F.regexp_extract(c, "/([^/>]*)>$", 1).try_cast("long")
    if kind == "raw":
        return c
    if kind.startswith("round"):
        return F.round(c.cast("double"), int(kind[5:]))
    plain = F.replace(F.replace(terms.label(c), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return plain if kind == "string" else terms.label(c).try_cast(kind)


def typed(df: DataFrame, columns: str) -> DataFrame:
    """columns: name:kind or name=var:kind, parted by blanks; num columns say `as <type>` by a leading dot."""
    out = []
    for item in columns.split():
        names, kind = item.split(":")
        name, _, var = names.partition("=")
        c = F.col(var or name)
        out.append((c.cast(kind[1:]) if kind[0] == "." else decoded(c, kind)).alias(name))
    return df.select(*out)


#: name: (tables, query, result columns, SQL)
CASES: dict[str, tuple[str, str, str, str]] = {
    "pattern_bound_p": ("customer", "SELECT ?c ?n { ?c p:c_name ?n }", "c:id n:string", "select c_custkey as c, c_name as n from customer"),
    "pattern_bound_s": ("customer", "SELECT ?p ?o { <urn:customer/7> ?p ?o }", "p:raw o:raw", "select '<urn:p/' || k || '>' as p, v as o from (select unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) as k, unnest(['\"' || c_name || '\"', '<urn:nation/' || c_nationkey || '>', '\"' || c_acctbal || '\"', '\"' || c_mktsegment || '\"']) as v from customer where c_custkey = 7)"),
    "pattern_bound_o": ("customer", 'SELECT ?c { ?c p:c_mktsegment "BUILDING" }', "c:id", "select c_custkey as c from customer where c_mktsegment = 'BUILDING'"),
    "pattern_var_p": ("nation region", "SELECT ?p (COUNT(?s) AS ?n) { ?s ?p ?o } GROUP BY ?p", "p:raw n:.long", "select '<urn:p/n_name>' as p, count(n_name) as n from nation union all select '<urn:p/n_regionkey>', count(n_regionkey) from nation union all select '<urn:p/r_name>', count(r_name) from region"),
    "pattern_repeat_var": ("SELF", "SELECT ?x ?p { ?x ?p ?x }", "x:id p:raw", "select c_custkey as x, '<urn:knows>' as p from customer where c_custkey % 10 = 0"),
    "pattern_ask_constant": ("nation", 'SELECT ?r { <urn:nation/3> p:n_regionkey ?r . <urn:nation/3> p:n_name ?n . ?x p:n_name ?n }', "r:id", "select n_regionkey::bigint as r from nation where n_nationkey = 3"),
    "ask": ("region", 'ASK { ?r p:r_name "ASIA" }', "answer:.boolean", "select count(*) > 0 as answer from region where r_name = 'ASIA'"),
    "distinct_preprocessing": ("DISTINCT REPEATED", "SELECT ?s ?o { ?s <urn:in> ?o }", "s:raw o:raw", "select distinct '<urn:' || c_mktsegment || '>' as s, '<urn:nation/' || c_nationkey || '>' as o from customer"),
    "bgp_star": ("customer", "SELECT ?c ?n ?b ?s { ?c p:c_name ?n ; p:c_acctbal ?b ; p:c_mktsegment ?s }", "c:id n:string b:double s:string", "select c_custkey as c, c_name as n, c_acctbal as b, c_mktsegment as s from customer"),
    "bgp_path": ("customer nation region", 'SELECT ?cn ?nn { ?c p:c_name ?cn ; p:c_nationkey ?n . ?n p:n_name ?nn ; p:n_regionkey ?r . ?r p:r_name "ASIA" }', "cn:string nn:string", "select c_name as cn, n_name as nn from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'"),
    "bgp_nway": ("customer nation orders lineitem", 'SELECT ?nn (SUM(xsd:double(?e) * (1 - xsd:double(?d))) AS ?v) (COUNT(*) AS ?n) { ?l p:l_orderkey ?o ; p:l_extendedprice ?e ; p:l_discount ?d . ?o p:o_custkey ?c ; p:o_orderstatus "F" . ?c p:c_nationkey ?k . ?k p:n_name ?nn } GROUP BY ?nn', "nn:string v:round2 n:.long", "select n_name as nn, round(sum(l_extendedprice * (1 - l_discount)), 2) as v, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'F' group by 1"),
    "bgp_two_shared_vars": ("customer nation orders", "SELECT ?S ?O ?O2 { ?S ?P ?O . ?O ?P2 ?O2 . ?O p:c_nationkey ?O2 }", "S:id O:id O2:id", "select o_orderkey as S, c_custkey as O, c_nationkey::bigint as O2 from orders join customer on o_custkey = c_custkey"),
    "bgp_query1": ("LINKS", "SELECT ?S ?O ?O2 { ?S ?P ?O . ?O ?P ?O2 }", "S:id O:id O2:id", "select a.c_custkey as S, b.c_custkey as O, c.c_custkey as O2 from customer a join customer b on b.c_custkey = a.c_custkey // 2 join customer c on c.c_custkey = b.c_custkey // 2 where a.c_custkey > 1 and b.c_custkey > 1"),
    "bgp_const_link": ("nation region", "SELECT ?n ?r ?rn { ?n p:n_regionkey ?r . ?r p:r_name ?rn }", "n:id r:id rn:string", "select n_nationkey::bigint as n, r_regionkey::bigint as r, r_name as rn from nation join region on n_regionkey = r_regionkey"),
    "bgp_star_bound_objects": ("customer", 'SELECT ?S ?P ?O { ?S p:c_mktsegment "MACHINERY" ; p:c_nationkey <urn:nation/5> ; ?P ?O }', "S:id P:raw O:raw", "select c_custkey as S, '<urn:p/' || k || '>' as P, v as O from (select c_custkey, unnest(['c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) as k, unnest(['\"' || c_name || '\"', '<urn:nation/' || c_nationkey || '>', '\"' || c_acctbal || '\"', '\"' || c_mktsegment || '\"']) as v from customer where c_mktsegment = 'MACHINERY' and c_nationkey = 5)"),
    "construct_single": ("customer nation", "CONSTRUCT { ?n <urn:has> ?c } { ?c p:c_nationkey ?n . ?n p:n_name ?x }", "subject:raw predicate:raw object:raw", "select '<urn:nation/' || c_nationkey || '>' as subject, '<urn:has>' as predicate, '<urn:customer/' || c_custkey || '>' as object from customer"),
    "construct_multi": ("nation", "CONSTRUCT { ?n a <urn:Nation> . ?r <urn:part> ?n } { ?n p:n_regionkey ?r }", "subject:raw predicate:raw object:raw", "select '<urn:nation/' || n_nationkey || '>' as subject, '<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>' as predicate, '<urn:Nation>' as object from nation union all select '<urn:region/' || n_regionkey || '>', '<urn:part>', '<urn:nation/' || n_nationkey || '>' from nation"),
    "construct_blank": ("nation", "CONSTRUCT { _:x <urn:of> ?n . _:x <urn:in> ?r } { ?n p:n_regionkey ?r }", "subject:raw predicate:raw object:raw", "select '_:' || sha256('__x' || chr(31) || '<urn:nation/' || n_nationkey || '>' || chr(31) || '<urn:region/' || n_regionkey || '>') as subject, unnest(['<urn:of>', '<urn:in>']) as predicate, unnest(['<urn:nation/' || n_nationkey || '>', '<urn:region/' || n_regionkey || '>']) as object from nation"),
    "cross_product": ("nation region", "SELECT ?a ?b { ?x p:n_name ?a . ?y p:r_name ?b }", "a:string b:string", "select n_name as a, r_name as b from nation, region"),
    "optional": ("documents labels", 'SELECT ?d ?q { ?d p:lang "en" OPTIONAL { ?l p:labels_doc_id ?d ; p:quality ?q } }', "doc_id=d:id quality=q:int", "select d.doc_id, l.quality from documents d left join labels l using (doc_id) where d.lang = 'en'"),
    "optional_filter": ("documents labels", "SELECT ?d ?n ?q { ?d p:n_chars ?n OPTIONAL { ?l p:labels_doc_id ?d ; p:quality ?q FILTER(xsd:integer(?n) > 1000) } }", "doc_id=d:id n:long quality=q:int", "select d.doc_id, d.n_chars as n, l.quality from documents d left join labels l on l.doc_id = d.doc_id and d.n_chars > 1000"),
    "optional_strict": ("STRICT documents labels", "SELECT ?d ?q { ?d p:lang \"es\" OPTIONAL { ?l p:labels_doc_id ?d ; p:quality ?q } ?m p:labels_doc_id ?d ; p:toxic ?q }", "doc_id=d:id q:int", "select d.doc_id, l.quality as q from documents d join labels l using (doc_id) where d.lang = 'es' and l.quality = l.toxic"),
    "not_exists": ("documents labels", "SELECT ?d { ?d p:lang ?x FILTER NOT EXISTS { ?l p:labels_doc_id ?d } }", "doc_id=d:id", "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)"),
    "exists": ("documents labels", "SELECT ?d { ?d p:lang ?x FILTER EXISTS { ?l p:labels_doc_id ?d ; p:quality ?q FILTER(xsd:integer(?q) = 0) } }", "doc_id=d:id", "select doc_id from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id and quality = 0)"),
    "minus": ("customer orders", 'SELECT ?c { ?c p:c_name ?n MINUS { ?o p:o_custkey ?c ; p:o_orderpriority "1-URGENT" } }', "c:id", "select c_custkey as c from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')"),
    "union_same": ("nation region", "SELECT ?v { { ?x p:n_name ?v } UNION { ?x p:r_name ?v } }", "v:string", "select n_name as v from nation union all select r_name from region"),
    "union_missing_cols": ("nation region", "SELECT ?a ?b { { ?x p:n_name ?a } UNION { ?x p:r_name ?b } }", "a:string b:string", "select n_name as a, null as b from nation union all select null, r_name from region"),
    "union_nested": ("nation region customer", "SELECT ?v { { { ?x p:n_name ?v } UNION { ?x p:r_name ?v } } UNION { ?x p:c_mktsegment ?v } }", "v:string", "select n_name as v from nation union all select r_name from region union all select c_mktsegment from customer"),
    "filter_eq_iri": ("customer", "SELECT ?c { ?c p:c_nationkey ?n FILTER(?n = <urn:nation/4>) }", "c:id", "select c_custkey as c from customer where c_nationkey = 4"),
    "filter_eq_literal": ("customer", 'SELECT ?c { ?c p:c_mktsegment ?s FILTER(?s = "AUTOMOBILE") }', "c:id", "select c_custkey as c from customer where c_mktsegment = 'AUTOMOBILE'"),
    "filter_ne": ("orders", 'SELECT ?o { ?o p:o_orderstatus ?s FILTER(?s != "F") }', "o:id", "select o_orderkey as o from orders where o_orderstatus <> 'F'"),
    "filter_lt_num": ("customer", "SELECT ?c { ?c p:c_acctbal ?b FILTER(xsd:double(?b) < 100.5) }", "c:id", "select c_custkey as c from customer where c_acctbal < 100.5"),
    "filter_ge_num": ("lineitem", "SELECT (COUNT(*) AS ?n) { ?l p:l_quantity ?q FILTER(?q >= 40) }", "n:.long", "select count(*) as n from lineitem where l_quantity >= 40"),
    "filter_and_or_precedence": ("customer", 'SELECT ?c { ?c p:c_mktsegment ?s ; p:c_acctbal ?b FILTER((?s = "BUILDING" || ?s = "MACHINERY") && ?b > 5000) }', "c:id", "select c_custkey as c from customer where (c_mktsegment = 'BUILDING' or c_mktsegment = 'MACHINERY') and c_acctbal > 5000"),
    "filter_not": ("customer", 'SELECT ?c { ?c p:c_mktsegment ?s FILTER(!(?s IN ("BUILDING", "MACHINERY"))) }', "c:id", "select c_custkey as c from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')"),
    "filter_regex": ("part", 'SELECT ?p ?n { ?p p:p_type ?n FILTER REGEX(?n, "^s.*(all|ard)$", "i") }', "p:id n:string", "select p_partkey as p, p_type as n from part where regexp_matches(p_type, '^s.*(all|ard)$', 'i')"),
    "filter_bound": ("documents labels", "SELECT ?d { ?d p:lang ?x OPTIONAL { ?l p:labels_doc_id ?d } FILTER(!BOUND(?l)) }", "doc_id=d:id", "select doc_id from documents where doc_id not in (select doc_id from labels)"),
    "cast_float": ("customer", "SELECT ?c (xsd:float(xsd:string(?b)) AS ?f) { ?c p:c_acctbal ?b }", "c:id f:.float", "select c_custkey as c, c_acctbal::float as f from customer"),
    "cast_double": ("orders", "SELECT ?o (xsd:double(?t) AS ?d) { ?o p:o_totalprice ?t }", "o:id d:.double", "select o_orderkey as o, o_totalprice as d from orders"),
    "cast_string": ("nation", "SELECT ?n (xsd:string(?x) AS ?s) (xsd:string(?n) AS ?i) { ?n p:n_name ?x }", "n:id s:.string i:.string", "select n_nationkey::bigint as n, n_name as s, 'urn:nation/' || n_nationkey as i from nation"),
    "cast_invalid": ("customer", "SELECT ?c (xsd:double(?x) AS ?d) { ?c p:c_name ?x }", "c:id d:.double", "select c_custkey as c, null::double as d from customer"),
    "arith_plus_minus_mul_div": ("lineitem", "SELECT (SUM(xsd:double(?q) + 1) AS ?a) (SUM(xsd:double(?q) - 1) AS ?b) (SUM(xsd:double(?q) * 2) AS ?c) (SUM(xsd:double(?q) / 4) AS ?d) (COUNT(xsd:double(?q) / 0) AS ?e) { ?l p:l_quantity ?q }", "a:round2 b:round2 c:round2 d:round2 e:.long", "select round(sum(l_quantity + 1), 2) as a, round(sum(l_quantity - 1), 2) as b, round(sum(l_quantity * 2), 2) as c, round(sum(l_quantity / 4), 2) as d, 0::bigint as e from lineitem"),
    "bind": ("customer", "SELECT ?c ?t { ?c p:c_acctbal ?b BIND(xsd:double(?b) * 2 AS ?t) FILTER(?t > 10000) }", "c:id t:round4", "select c_custkey as c, round(c_acctbal * 2, 4) as t from customer where c_acctbal * 2 > 10000"),
    "projection_rename": ("nation", "SELECT (?x AS ?name) (?n AS ?nation) { ?n p:n_name ?x }", "name:string nation:id", "select n_name as name, n_nationkey::bigint as nation from nation"),
    "projection_unbound": ("region", "SELECT ?x ?nothing { ?r p:r_name ?x }", "x:string nothing:string", "select r_name as x, null as nothing from region"),
    "distinct": ("customer", "SELECT DISTINCT ?s ?n { ?c p:c_mktsegment ?s ; p:c_nationkey ?n }", "s:string n:id", "select distinct c_mktsegment as s, c_nationkey::bigint as n from customer"),
    "reduced": ("region", "SELECT REDUCED ?x { ?r p:r_name ?x }", "x:string", "select r_name as x from region"),
    "order_var": ("nation", "SELECT ?x { ?n p:n_name ?x } ORDER BY ?x LIMIT 7", "x:string", "select n_name as x from nation order by x limit 7"),
    "order_desc_expr": ("orders", "SELECT ?o ?t { ?o p:o_totalprice ?t } ORDER BY DESC(xsd:double(?t) * 2) ?o LIMIT 20", "o:id t:double", "select o_orderkey as o, o_totalprice as t from orders order by t desc, '<urn:orders/' || o || '>' limit 20"),
    "limit_topk": ("orders customer", "SELECT ?n ?t { ?o p:o_custkey ?c ; p:o_totalprice ?t . ?c p:c_name ?n } ORDER BY DESC(xsd:double(?t)) ?n LIMIT 10", "n:string t:double", "select c_name as n, o_totalprice as t from orders join customer on o_custkey = c_custkey order by t desc, n limit 10"),
    "offset": ("nation", "SELECT ?x { ?n p:n_name ?x } ORDER BY ?x OFFSET 5 LIMIT 4", "x:string", "select n_name as x from nation order by x limit 4 offset 5"),
    "group_count": ("orders", "SELECT ?s (COUNT(?o) AS ?n) { ?o p:o_orderstatus ?s } GROUP BY ?s", "s:string n:.long", "select o_orderstatus as s, count(*) as n from orders group by 1"),
    "group_count_star": ("documents labels", "SELECT ?g (COUNT(*) AS ?n) (COUNT(?q) AS ?m) { ?d p:lang ?g OPTIONAL { ?l p:labels_doc_id ?d ; p:quality ?q } } GROUP BY ?g", "g:string n:.long m:.long", "select lang as g, count(*) as n, count(quality) as m from documents left join labels using (doc_id) group by 1"),
    "group_count_distinct": ("orders", "SELECT ?s (COUNT(DISTINCT ?c) AS ?n) { ?o p:o_orderstatus ?s ; p:o_custkey ?c } GROUP BY ?s", "s:string n:.long", "select o_orderstatus as s, count(distinct o_custkey) as n from orders group by 1"),
    "group_sum": ("lineitem", "SELECT ?f (SUM(xsd:double(?q)) AS ?v) { ?l p:l_returnflag ?f ; p:l_quantity ?q } GROUP BY ?f", "f:string v:round2", "select l_returnflag as f, round(sum(l_quantity), 2) as v from lineitem group by 1"),
    "group_avg": ("lineitem", "SELECT ?f (AVG(?q) AS ?v) { ?l p:l_returnflag ?f ; p:l_extendedprice ?q } GROUP BY ?f", "f:string v:round4", "select l_returnflag as f, round(avg(l_extendedprice), 4) as v from lineitem group by 1"),
    "group_min": ("orders", "SELECT ?p (MIN(xsd:double(?t)) AS ?v) (MIN(?d) AS ?w) { ?o p:o_orderpriority ?p ; p:o_totalprice ?t ; p:o_orderstatus ?d } GROUP BY ?p", "p:string v:.double w:string", "select o_orderpriority as p, min(o_totalprice) as v, min(o_orderstatus) as w from orders group by 1"),
    "group_max": ("orders customer", "SELECT ?s (MAX(xsd:double(?t)) AS ?mx) (COUNT(?o) AS ?n) { ?o p:o_custkey ?c ; p:o_totalprice ?t . ?c p:c_mktsegment ?s } GROUP BY ?s", "c_mktsegment=s:string n:.long mx:.double", "select c_mktsegment, count(*) as n, max(o_totalprice) as mx from orders join customer on o_custkey = c_custkey group by 1"),
    "group_multi_key": ("lineitem", "SELECT ?f ?s (COUNT(*) AS ?n) { ?l p:l_returnflag ?f ; p:l_linestatus ?s } GROUP BY ?f ?s", "f:string s:string n:.long", "select l_returnflag as f, l_linestatus as s, count(*) as n from lineitem group by 1, 2"),
    "group_expr_over_agg": ("orders", "SELECT ?s (COUNT(?o) * 2 + 1 AS ?n) { ?o p:o_orderstatus ?s } GROUP BY ?s", "s:string n:.long", "select o_orderstatus as s, count(*) * 2 + 1 as n from orders group by 1"),
    "group_concat": ("nation region", 'SELECT ?rn (GROUP_CONCAT(?nn; SEPARATOR=",") AS ?all) (SAMPLE(?nn) AS ?one) { ?n p:n_regionkey ?r ; p:n_name ?nn . ?r p:r_name ?rn } GROUP BY ?rn', "rn:string all:.string one:string", "select r_name as rn, string_agg(n_name, ',' order by n_name) as all, min(n_name) as one from nation join region on n_regionkey = r_regionkey group by 1"),
    "having": ("orders", "SELECT ?c (COUNT(?o) AS ?n) { ?o p:o_custkey ?c } GROUP BY ?c HAVING(COUNT(?o) > 12)", "c:id n:.long", "select o_custkey as c, count(*) as n from orders group by 1 having count(*) > 12"),
    "global_agg": ("orders", "SELECT (COUNT(*) AS ?n) (SUM(xsd:double(?t)) AS ?s) (AVG(xsd:double(?t)) AS ?a) { ?o p:o_totalprice ?t }", "n:.long s:round1 a:round3", "select count(*) as n, round(sum(o_totalprice), 1) as s, round(avg(o_totalprice), 3) as a from orders"),
    "global_agg_empty": ("orders", 'SELECT (COUNT(*) AS ?n) (SUM(xsd:double(?t)) AS ?s) { ?o p:o_totalprice ?t ; p:o_orderstatus "none" }', "n:.long s:.double", "select count(*) as n, sum(o_totalprice) as s from orders where o_orderstatus = 'none'"),
    "subquery": ("orders customer", "SELECT ?n ?k { ?c p:c_name ?n { SELECT ?c (COUNT(?o) AS ?k) { ?o p:o_custkey ?c } GROUP BY ?c HAVING(COUNT(?o) > 14) } }", "n:string k:.long", "select c_name as n, k from customer join (select o_custkey, count(*) as k from orders group by 1 having count(*) > 14) on o_custkey = c_custkey"),
    "join_reordered": ("customer orders nation region", 'SELECT ?o ?rn { ?o p:o_custkey ?c ; p:o_orderstatus "P" . ?c p:c_nationkey ?n . ?n p:n_regionkey ?r . ?r p:r_name ?rn }', "o:id rn:string", "select o_orderkey as o, r_name as rn from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where o_orderstatus = 'P'"),
    "join_broadcast": ("lineitem part", 'SELECT ?b (SUM(?q) AS ?q2) (COUNT(*) AS ?n) { ?l p:l_partkey ?p ; p:l_quantity ?q . ?p p:p_brand ?b ; p:p_size 7 } GROUP BY ?b', "b:string q=q2:round2 n:.long", "select p_brand as b, round(sum(l_quantity), 2) as q, count(*) as n from lineitem join part on l_partkey = p_partkey where p_size = 7 group by 1"),
    "join_skew": ("SKEWED customer nation", "SELECT ?x (COUNT(*) AS ?n) (MAX(?b) AS ?most) { ?c p:c_nationkey ?k ; p:c_acctbal ?b . ?k p:n_name ?x } GROUP BY ?x", "x:string n:.long most:double", "select n_name as x, count(*) as n, max(c_acctbal) as most from customer join nation on c_nationkey = n_nationkey group by 1"),
    "distinct_order_expr": ("lineitem", "SELECT DISTINCT ?q { ?l p:l_quantity ?q } ORDER BY DESC(xsd:double(?q) * 2) LIMIT 9", "q:double", "select distinct l_quantity as q from lineitem order by q desc limit 9"),
    "distinct_order_other": ("orders", "SELECT DISTINCT ?c { ?o p:o_custkey ?c ; p:o_totalprice ?t } ORDER BY ?t LIMIT 12", "c:id", "select o_custkey as c from orders group by 1 order by min(o_totalprice) limit 12"),
    "max_untyped_number": ("NUMBERS", "SELECT (MAX(?v) AS ?hi) (MIN(?v) AS ?lo) { ?c <urn:key> ?v }", "hi:long lo:long", "select max(c_custkey) as hi, min(c_custkey) as lo from customer"),
    "order_number": ("NUMBERS", "SELECT ?v { ?c <urn:key> ?v } ORDER BY DESC(?v) LIMIT 15", "v:long", "select c_custkey as v from customer order by v desc limit 15"),
    "filter_var_var": ("NUMBERS", "SELECT ?v ?w { ?c <urn:key> ?v ; <urn:next> ?w FILTER(?w < ?v) }", "v:long w:long", "select c_custkey as v, c_custkey % 100 as w from customer where c_custkey % 100 < c_custkey"),
    "filter_number_pushed": ("customer", "SELECT ?c ?b { ?c p:c_acctbal ?b ; p:c_nationkey ?n FILTER(?b < 100.5 && ?n = <urn:nation/4>) }", "c:id b:double", "select c_custkey as c, c_acctbal as b from customer where c_acctbal < 100.5 and c_nationkey = 4"),
    "values": ("customer nation", 'SELECT ?c ?n { VALUES (?n ?s) { (<urn:nation/3> "BUILDING") (<urn:nation/7> "MACHINERY") } ?c p:c_nationkey ?n ; p:c_mktsegment ?s }', "c:id n:id", "select c_custkey as c, c_nationkey::bigint as n from customer where (c_nationkey, c_mktsegment) in ((3, 'BUILDING'), (7, 'MACHINERY'))"),
    "path_sequence": ("customer nation region", "SELECT ?c ?x { ?c p:c_nationkey/p:n_regionkey/p:r_name ?x }", "c:id x:string", "select c_custkey as c, r_name as x from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"),
    "path_inverse": ("customer nation", "SELECT ?n ?s { ?n ^p:c_nationkey/p:c_mktsegment ?s }", "n:id s:string", "select c_nationkey::bigint as n, c_mktsegment as s from customer"),
    "describe": ("nation", "DESCRIBE ?n { ?n p:n_regionkey <urn:region/2> }", "subject:raw predicate:raw object:raw", "select '<urn:nation/' || n_nationkey || '>' as subject, unnest(['<urn:p/n_name>', '<urn:p/n_regionkey>']) as predicate, unnest(['\"' || n_name || '\"', '<urn:region/' || n_regionkey || '>']) as object from nation where n_regionkey = 2"),
    "lang_datatype": ("TAGGED", 'SELECT ?s (LANG(?n) AS ?l) (DATATYPE(?k) AS ?d) (LOCALNAME(?s) AS ?i) { ?s <urn:name> ?n ; <urn:key> ?k FILTER(LANGMATCHES(LANG(?n), "en") && ?k > 5) }', "s:raw l:.string d:raw i:.string", "select '<urn:nation/' || n_nationkey || '>' as s, case when n_nationkey % 2 = 0 then 'en' else 'en-GB' end as l, '<http://www.w3.org/2001/XMLSchema#integer>' as d, n_nationkey::varchar as i from nation where n_nationkey % 3 <> 0 and n_nationkey > 5"),
    "optional_product": ("region nation", 'SELECT ?r ?n { ?x p:r_name ?r OPTIONAL { ?y p:n_name ?n ; p:n_regionkey <urn:region/1> } }', "r:string n:string", "select r_name as r, n_name as n from region left join nation on n_regionkey = 1"),
    "join_sampled": ("SAMPLED customer orders nation", 'SELECT ?nn (COUNT(*) AS ?n) { ?o p:o_custkey ?c . ?c p:c_nationkey ?k . ?k p:n_name ?nn } GROUP BY ?nn', "nn:string n:.long", "select n_name as nn, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1"),
}


def source_of(spark: SparkSession, sf_dir: str, spec: str):
    """Triples that a case asks for."""
    if spec == "SELF":  # every customer knows another one, every tenth itself
        df = spark.read.parquet(f"{sf_dir}/customer.parquet")
        k = F.col("c_custkey")
        return FrameTriples(df.select(iri_of(k).alias("s"), F.lit("<urn:knows>").alias("p"), iri_of(F.when(k % 10 == 0, k).otherwise(k + 1)).alias("o")))
    if spec == "REPEATED":  # many customers of a segment and nation give the same triple
        df = spark.read.parquet(f"{sf_dir}/customer.parquet")
        return FrameTriples(df.select(F.concat(F.lit("<urn:"), "c_mktsegment", F.lit(">")).alias("s"), F.lit("<urn:in>").alias("p"), F.concat(F.lit("<urn:nation/"), F.col("c_nationkey").cast("string"), F.lit(">")).alias("o")))
    if spec == "NUMBERS":  # numbers as plain literals
        k = F.col("c_custkey")
        pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), terms.as_literal(v).alias("o")) for p, v in (("<urn:key>", k), ("<urn:next>", k % 100))])).alias("t")
        return FrameTriples(spark.read.parquet(f"{sf_dir}/customer.parquet").select(iri_of(k).alias("s"), pairs).select("s", "t.p", "t.o"))
    if spec == "TAGGED":  # nations as lines of N-Triples whose tags are kept
        k = F.col("n_nationkey").cast("string")
        lang = F.when(F.col("n_nationkey") % 3 == 0, "de").when(F.col("n_nationkey") % 2 == 0, "en").otherwise("en-GB")
        name = F.concat(F.lit("<urn:nation/"), k, F.lit('> <urn:name> "'), "n_name", F.lit('"@'), lang, F.lit(" ."))
        key = F.concat(F.lit("<urn:nation/"), k, F.lit('> <urn:key> "'), k, F.lit(f'"^^<{terms.XSD}integer> .'))
        return FrameTriples(parse_lines(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.explode(F.array(name, key)).alias("value")), keep_tags=True))
    if spec == "LINKS":  # a tree of customers
        df = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey > 1")
        return FrameTriples(df.select(iri_of(F.col("c_custkey")).alias("s"), F.lit("<urn:up>").alias("p"), iri_of(F.floor(F.col("c_custkey") / 2).cast("long")).alias("o")))
    return open_tables(spark, sf_dir, spec.split())


def iri_of(c: Column) -> Column:
    return F.concat(F.lit("<urn:customer/"), c.cast("string"), F.lit(">"))


FLAGS = {"DISTINCT": Conf(distinct_preprocessing=True), "STRICT": Conf(strict_optional=True), "SAMPLED": Conf(cost_calculator="sampling", sampling_threshold=20, static_prune=1.0), "SKEWED": Conf(cost_calculator="sampling", sample_rate=0.5, sampling_threshold=4, join_skewness=0.01, in_memory_threshold=0), "TAGGED": Conf(keep_tags=True)}


def case(name: str) -> Callable[[SparkSession, str], DataFrame]:
    spec, text, columns, _ = CASES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flag = spec.split()[0]
        conf, tables = (FLAGS[flag], spec.split(maxsplit=1)[-1]) if flag in FLAGS else (Conf(), spec)
        return typed(Engine(source_of(spark, sf_dir, tables), conf).query(PREFIX + text), columns)

    return run


def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries over the same pattern, under other names, from one cached result."""
    engine = Engine(open_tables(spark, sf_dir, ["customer", "nation"]), cache=True)
    a = engine.query(PREFIX + "SELECT ?nn (COUNT(*) AS ?n) { ?c p:c_nationkey ?k . ?k p:n_name ?nn } GROUP BY ?nn")
    b = engine.query(PREFIX + "SELECT ?x (COUNT(*) AS ?m) { ?y p:c_nationkey ?z . ?z p:n_name ?x } GROUP BY ?x")
    assert engine.cache.hits == 1
    return a.join(b, a["nn"] == b["x"]).select(decoded(F.col("nn"), "string").alias("nn"), "n", "m")


def ntriples_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as compressed files of N-Triples, with comments and broken lines between, and read again."""
    df = spark.read.parquet(f"{sf_dir}/customer.parquet")
    good = F.concat(F.lit("<urn:customer/"), F.col("c_custkey").cast("string"), F.lit('> <urn:p/c_name> "'), F.col("c_name"), F.lit('"@en .'))
    lines = df.select(F.explode(F.array(good, F.lit("# a comment ."), F.lit("no dot at end"), F.concat(F.lit("<urn:x> <urn:y> 42 ."), F.lit("")))).alias("value"))
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="triloom-")  # the shared folder; unset only in tests
    path = f"{folder}/triloom/ntriples-{uuid.uuid4().hex}"
    lines.write.option("compression", "gzip").text(path)
    return read_ntriples(spark, path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: case(name) for name in CASES} | {f.__name__: f for f in (cache_reuse, ntriples_load)}


def oracle_sql() -> dict[str, str]:
    return {name: c[3] for name, c in CASES.items()} | {
        "cache_reuse": "select n_name as nn, count(*) as n, count(*) as m from customer join nation on c_nationkey = n_nationkey group by 1",
        "ntriples_load": "select '<urn:customer/' || c_custkey || '>' as s, '<urn:p/c_name>' as p, '\"' || c_name || '\"' as o from customer",
    }


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a path over four tables, grouped."""
    return case("bgp_nway")(spark, sf_dir)


__all__ = ["entry", "oracle_sql", "parse", "queries"]
