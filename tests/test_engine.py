import dataclasses
import itertools
import random

import pytest
from pyspark.sql import functions as F

from triloom.__main__ import main
from triloom.conf import Conf
from triloom.engine import Engine
from triloom.operators.joins import compatible_join, product, skew_join
from triloom.plans import cost
from triloom.plans.algebra import BGP, NJoin, UnsupportedFunction, UnsupportedQuery
from triloom.plans.order import best_tree, checked, connected, join, leaf, order_joins
from triloom.plans.parser import parse, split_queries
from triloom.plans.sampling import estimate_join
from triloom.sources.tables import FrameTriples, Mapping, Source, TableTriples

PEOPLE = [
    ("<a>", "<name>", '"Ann"'), ("<a>", "<age>", '"30"'), ("<a>", "<mail>", '"ann@x"'), ("<a>", "<knows>", "<b>"),
    ("<b>", "<name>", '"Bob"'), ("<b>", "<age>", '"nine"'), ("<b>", "<knows>", "<c>"), ("<c>", "<name>", '"Cyd"'),
    ("<c>", "<age>", '"41"'), ("<c>", "<knows>", "<c>"), ("_:x", "<name>", '"Dee"'),
]


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark.createDataFrame(PEOPLE, "s string, p string, o string").cache())


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


CASES = [
    ("SELECT ?n { ?x <knows> ?y . ?y <name> ?n }", [('"Bob"',), ('"Cyd"',), ('"Cyd"',)]),
    ("SELECT ?x { ?x <knows> ?x }", [("<c>",)]),
    ("SELECT ?x ?m { ?x <age> ?g OPTIONAL { ?x <mail> ?m } }", [("<a>", '"ann@x"'), ("<b>", None), ("<c>", None)]),
    ("SELECT ?x { ?x <name> ?n FILTER NOT EXISTS { ?x <mail> ?m } FILTER EXISTS { ?x <age> ?g } }", [("<b>",), ("<c>",)]),
    ("SELECT ?x { ?x <name> ?n FILTER NOT EXISTS { <nobody> <mail> ?m } }", [("<a>",), ("<b>",), ("<c>",), ("_:x",)]),
    ("SELECT ?x { ?x <age> ?g FILTER(?g > 29 && (?g < 31 || ?g > 40)) }", [("<a>",), ("<c>",)]),
    ("SELECT (SUM(?g) AS ?s) (COUNT(?g) AS ?n) { ?x <age> ?g }", [(71.0, 3)]),
    ("SELECT (MAX(<http://www.w3.org/2001/XMLSchema#integer>(?g)) AS ?m) (MIN(?n) AS ?f) { ?x <age> ?g ; <name> ?n }", [(41, '"Ann"')]),
    ("SELECT (COUNT(*) AS ?n) { ?x <nothing> ?y }", [(0,)]),
    ("SELECT ?v { { ?x <name> ?v } UNION { ?x <mail> ?v } } ORDER BY DESC(?v) LIMIT 1", [('"ann@x"',)]),
    ("SELECT ?x ?d { ?x <age> ?g BIND(?g / 0 AS ?d) FILTER(isIRI(?x)) }", [("<a>", None), ("<b>", None), ("<c>", None)]),
    ("SELECT ?x { ?x <name> ?n FILTER REGEX(?n, '^[ab]', 'i') }", [("<a>",), ("<b>",)]),
    ("SELECT ?x ?y { ?x <mail> ?m . ?y <mail> ?m2 }", [("<a>", "<a>")]),
    ("SELECT ?n { ?x <name> ?n . FILTER(?x IN (<a>, <c>)) }", [('"Ann"',), ('"Cyd"',)]),
    ("SELECT ?x ?k { ?x <name> ?n { SELECT ?x (COUNT(*) AS ?k) { ?x ?p ?o } GROUP BY ?x HAVING(COUNT(*) > 3) } }", [("<a>", 4)]),
    ("ASK { <a> <knows> <b> }", [(True,)]),
    ("ASK { <a> <knows> <c> }", [(False,)]),
    ("SELECT ?x { <a> <knows> <b> . ?x <mail> ?m }", [("<a>",)]),
    ("SELECT ?x { <a> <knows> <c> . ?x <mail> ?m }", []),
    ("CONSTRUCT { ?y <known> ?x } { ?x <knows> ?y }", [("<b>", "<known>", "<a>"), ("<c>", "<known>", "<b>"), ("<c>", "<known>", "<c>")]),
    ("SELECT ?x { ?x <name> ?n MINUS { ?x <mail> ?m } }", [("<b>",), ("<c>",), ("_:x",)]),
    ("SELECT ?n { <a> <knows>/<name> ?n }", [('"Bob"',)]),
    ("SELECT ?x { <c> ^<knows> ?x }", [("<b>",), ("<c>",)]),
    ("SELECT ?x { <c> ^<knows>/^<knows> ?x }", [("<a>",), ("<b>",), ("<c>",)]),
    ("SELECT ?x ?n { VALUES ?x { <a> <c> <nobody> } ?x <name> ?n }", [("<a>", '"Ann"'), ("<c>", '"Cyd"')]),
    ("SELECT ?x ?n { ?x <name> ?n } VALUES (?x ?n) { (<a> 'Ann') (<b> 'Ann') }", [("<a>", '"Ann"')]),
    ("DESCRIBE <b>", [("<b>", "<age>", '"nine"'), ("<b>", "<knows>", "<c>"), ("<b>", "<name>", '"Bob"')]),
    ("DESCRIBE ?y { <b> <knows> ?y }", [("<c>", "<age>", '"41"'), ("<c>", "<knows>", "<c>"), ("<c>", "<name>", '"Cyd"')]),
    ("SELECT (MAX(?g) AS ?m) (MIN(?g) AS ?l) { ?x <age> ?g }", [('"nine"', '"30"')]),
    ("SELECT ?x { ?x <age> ?g } ORDER BY ?g LIMIT 2", [("<a>",), ("<c>",)]),
]


@pytest.mark.parametrize("text,expected", CASES)
def test_query(engine, text, expected):
    assert rows(engine.query(text)) == sorted(expected, key=repr)


@pytest.mark.parametrize("text", ["SELECT ?x { GRAPH <g> { ?x <p> ?y } }", "SELECT ?x { ?x <p>*/<q> ?y }", "SELECT ?x { ?x <p>|<q> ?y }", "DESCRIBE <a> FROM <g>", "SELECT ?x FROM <g> { ?x <p> ?y }", "CLEAR ALL"])
def test_rejected(text):
    with pytest.raises(UnsupportedQuery):
        parse(text)


def test_unknown_function(engine):
    with pytest.raises(UnsupportedFunction):
        engine.query("SELECT ?x { ?x <name> ?n FILTER(<urn:f>(?n)) }")


def test_split():
    assert split_queries("#Q\nSELECT ?x {?x ?p ?o}\n#Q\n// no\n#Q\n\n#Q\nASK {?s ?p ?o}") == ["SELECT ?x {?x ?p ?o}", "ASK {?s ?p ?o}"]


def test_run_file(engine, tmp_path):
    paths = engine.run_file("#Q\nSELECT ?n { <a> <name> ?n }\n#Q\nASK { <a> ?p ?o }", str(tmp_path))
    assert [p.rsplit("/", 1)[1] for p in paths] == ["0-output", "1-output"]
    assert "".join(f.read_text() for f in (tmp_path / "0-output").glob("part-*")) == '"Ann"\n'


def test_optimised_equals_unoptimised(spark):
    """Random basic graph patterns give the same rows whatever the join order."""
    rng = random.Random(3)
    triples = [(f"<n{rng.randrange(12)}>", f"<p{rng.randrange(3)}>", f"<n{rng.randrange(12)}>") for _ in range(60)]
    df = spark.createDataFrame(triples, "s string, p string, o string").cache()
    confs = [Conf(), Conf(optimize=False), Conf(cost_calculator="sampling", sample_rate=0.5, sampling_threshold=2), Conf(optimization_strategy="exhaustive"), Conf(most_enumerated=1)]
    for _ in range(3):
        body = " . ".join(f"?v{rng.randrange(3)} <p{rng.randrange(3)}> ?v{rng.randrange(4)}" for _ in range(3))
        got = [rows(Engine(df, c).query(f"SELECT * {{ {body} }}")) for c in confs]
        assert all(g == got[0] for g in got), body


def test_order_is_connected():
    patterns = [parse(f"SELECT * {{ {t} }}").child.patterns[0] for t in ("?a <p> ?b", "?c <q> ?d", "?b <r> ?c")]
    conf = Conf()
    tree = order_joins(patterns, [cost.scan(r, conf) for r in (1000, 10, 500)], conf)
    assert isinstance(tree, NJoin)

    def leaves(n):
        return [n] if not isinstance(n, NJoin) else [x for p in n.parts for x in leaves(p)]

    assert sorted(map(repr, leaves(tree))) == sorted(map(repr, patterns))


def test_estimate(spark):
    """The estimate is near the truth on skewed keys, and skewness shows."""
    a = spark.createDataFrame([("hot",)] * 4000 + [(f"k{i}",) for i in range(4000)], "k string")
    b = spark.createDataFrame([("hot",)] * 100 + [(f"k{i}",) for i in range(4000)], "k string")
    got = estimate_join(a, b, ["k"], rate=0.2, dense=100)
    assert 0.7 < got.rows / (4000 * 100 + 4000) < 1.3
    assert got.skewness > 100_000


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(2000)] + [(f"k{i}", i) for i in range(50)] + [(None, 1)], "k string, x int")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3)], "k string, y int")
    got = skew_join(left, right, how, rate=0.3, dense=100)
    assert rows(got.select("k", "x", "y")) == rows(left.join(right, "k", how).select("k", "x", "y"))


def test_cache(engine, spark):
    e = Engine(engine.source, cache=True)
    a = rows(e.query("SELECT ?x ?n { ?x <knows> ?y . ?y <name> ?n }"))
    b = rows(e.query("SELECT ?p ?q { ?p <knows> ?r . ?r <name> ?q }"))
    assert a == b and e.cache.hits == 1
    e.cache.clear()


def test_strict_optional(spark):
    df = spark.createDataFrame([("<a>", "<p>", "<u>"), ("<b>", "<p>", "<v>"), ("<a>", "<q>", "<z>"), ("<k>", "<r>", "<z>"), ("<k>", "<r>", "<w>")], "s string, p string, o string")
    text = "SELECT ?s ?o { ?s <p> ?x OPTIONAL { ?s <q> ?o } { SELECT ?o { ?k <r> ?o } } }"
    assert rows(Engine(df).query(text)) == [("<a>", "<z>")]
    assert rows(Engine(df, Conf(strict_optional=True)).query(text)) == [("<a>", "<z>"), ("<b>", "<w>"), ("<b>", "<z>")]


def test_bgp_of_permutations(engine):
    parts = ["?x <knows> ?y", "?y <name> ?n", "?y <age> ?g"]
    results = [rows(engine.query(f"SELECT ?x ?n ?g {{ {' . '.join(p)} }}")) for p in itertools.permutations(parts)]
    assert all(r == results[0] for r in results)
    assert isinstance(parse("SELECT * { ?a ?b ?c }").child, BGP)


def test_numbers_by_value(spark):
    """MAX, MIN, ORDER BY and comparisons of uncast literals go by number; DISTINCT keeps the order of an expression."""
    df = spark.createDataFrame([(f"<s{i}>", "<v>", f'"{i}"') for i in range(50)] * 2 + [("<a>", "<w>", '"9"'), ("<a>", "<x>", '"10"'), ("<a>", "<y>", '"9.0"')], "s string, p string, o string")
    e = Engine(df)
    assert [r.v for r in e.query("SELECT DISTINCT ?v { ?s <v> ?v } ORDER BY DESC(<http://www.w3.org/2001/XMLSchema#integer>(?v)) LIMIT 5").collect()] == [f'"{i}"' for i in range(49, 44, -1)]
    assert [r.v for r in e.query("SELECT DISTINCT ?v { ?s <v> ?v } ORDER BY ?v OFFSET 8 LIMIT 4").collect()] == ['"8"', '"9"', '"10"', '"11"']
    assert [r.s for r in e.query("SELECT DISTINCT ?s { ?s <v> ?v } ORDER BY DESC(?v) LIMIT 2").collect()] == ["<s49>", "<s48>"]
    assert rows(e.query("SELECT (MAX(?v) AS ?m) (MIN(?v) AS ?l) { ?s <v> ?v }")) == [('"49"', '"0"')]
    assert rows(e.query("SELECT ?s { ?s <w> ?w ; <x> ?x ; <y> ?y FILTER(?w < ?x && ?w = ?y && ?x > ?y) }")) == [("<a>",)]


def test_kept_tags(spark, tmp_path):
    (tmp_path / "x.nt").write_text('<a> <n> "hello"@en .\n<a> <n> "bonjour"@fr-CA .\n<a> <k> "42"^^<http://www.w3.org/2001/XMLSchema#integer> .\n<b> <n> "plain" .\n<b> <k> "x \\"q\\" y"@de .\n')
    e = Engine.from_ntriples(spark, str(tmp_path), Conf(keep_tags=True))
    assert rows(e.query('SELECT ?x { ?x <n> "hello"@en }')) == [("<a>",)] and rows(e.query('SELECT ?x { ?x <n> "hello" }')) == []
    assert rows(e.query("SELECT ?x { ?x <k> 42 }")) == [("<a>",)]
    assert rows(e.query("SELECT (LANG(?v) AS ?l) (STR(?v) AS ?t) { ?x ?p ?v }")) == [("", "42"), ("", "plain"), ("de", 'x \\"q\\" y'), ("en", "hello"), ("fr-CA", "bonjour")]
    assert rows(e.query('SELECT ?x { ?x <n> ?v FILTER(LANGMATCHES(LANG(?v), "FR")) }')) == [("<a>",)]
    assert rows(e.query("SELECT ?x { ?x ?p ?v FILTER(?v = 42 && DATATYPE(?v) = <http://www.w3.org/2001/XMLSchema#integer>) }")) == [("<a>",)]
    assert Engine.from_ntriples(spark, str(tmp_path)).query("SELECT ?v { <a> <k> ?v }").first().v == '"42"'


def test_conf(spark, tmp_path):
    (tmp_path / "c.ini").write_text("sample.rate = 0.2\nstars=false\njoin_skewness = 5\n")
    spark.conf.set("spark.triloom.sample.rate", "0.3")
    got = Conf.load(str(tmp_path / "c.ini"), spark, static_prune=2.0)
    assert (got.sample_rate, got.stars, got.join_skewness, got.static_prune, got.hot_keys) == (0.3, False, 5.0, 2.0, 1000)
    spark.conf.unset("spark.triloom.sample.rate")
    with pytest.raises(ValueError, match="unknown setting"):
        Conf.load(nonsense=1)


def test_costs(engine):
    """Calculators by name and weight; every kind of node has a cost; a broken tree is refused."""
    p = parse("SELECT * { ?x <knows> ?y }").child.patterns[0]
    count = lambda c: cost.pattern_rows(p, engine.source, Conf(cost_calculator=c))
    assert count("static") == count("counting") == 3 and count("faking") > 3
    assert count("static*0.5+faking*0.25") == 1.5 + count("faking") / 4
    with pytest.raises(ValueError, match="unknown cost calculator"):
        count("other")
    bound = parse('SELECT * { ?x <name> "Ann" }').child.patterns[0]
    assert cost.pattern_rows(bound, engine.source, Conf(cost_calculator="counting")) == 1
    for text, _ in CASES:
        assert engine.cost(text).total(Conf()) >= 0
    a, b = cost.scan(100, Conf()), cost.scan(10, Conf())
    assert cost.left_join(a, b, Conf()).rows >= 100
    with pytest.raises(ValueError, match="fewer than two"):
        checked(NJoin((NJoin((p,)), p)))


def test_order_is_cheapest():
    """The planner's tree is as cheap as the cheapest binary tree found by brute force, and shares a key's shuffle."""
    rng = random.Random(7)
    conf = Conf(optimization_strategy="exhaustive")
    for _ in range(30):
        n = rng.randrange(2, 6)
        patterns = [parse(f"SELECT * {{ ?v{rng.randrange(k or 1)} <p{k}> ?v{k + 1} }}").child.patterns[0] for k in range(n)]
        leaves = [leaf(p, cost.scan(float(rng.randrange(1, 10_000_000)), conf)) for p in patterns]

        def every(trees):
            if len(trees) == 1:
                yield trees[0]
            for a, b in itertools.combinations(trees, 2):
                if a.variables & b.variables:
                    yield from every([t for t in trees if t is not a and t is not b] + [join(a, b, conf)])

        groups = connected(leaves)
        for g in groups:
            assert best_tree(g, conf).total(conf) <= min(t.total(conf) for t in every(g)) * (1 + 1e-9)
    star = [leaf(parse(f"SELECT * {{ ?x <p{k}> ?y{k} }}").child.patterns[0], cost.scan(1e6, conf)) for k in range(4)]
    assert len(best_tree(star, conf).node.parts) == 4


def test_products(spark):
    """Products of two large sides, and left ones, give all pairs."""
    a, b = spark.range(40).select(F.col("id").alias("x")), spark.range(30).select(F.col("id").alias("y"))
    for small in (1000, 35, 5):
        assert product(a, b, small=small).count() == 1200 and product(b, a, "left", small=small).count() == 1200
        assert product(a, b.where("y < 0"), "left", small=small).count() == 40
    assert "CartesianProduct" in product(a, b, small=5)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_compatible_join(spark, how):
    """Against the condition itself, with unbound values on either side."""
    rng = random.Random(11)
    pick = lambda: rng.choice([None, "a", "b", "c"])
    left = spark.createDataFrame([(pick(), pick(), rng.choice("kl"), i) for i in range(25)], "x string, y string, k string, i int")
    right = spark.createDataFrame([(pick(), pick(), rng.choice("klm"), i) for i in range(20)], "x string, y string, k string, j int")
    meets = lambda a, b: all(p == q or p is None or q is None for p, q in zip(a[:2], b[:2], strict=True)) and a[2] == b[2]
    want = []
    for a in left.collect():
        found = [(*(p if p is not None else q for p, q in zip(a[:2], b[:2], strict=True)), a[2], a[3], b[3]) for b in right.collect() if meets(a, b)]
        want += found or ([(*a, None)] if how == "left" else [])
    assert rows(compatible_join(left, right, {"x", "y"}, how).select("x", "y", "k", "i", "j")) == sorted(want, key=repr)


def test_statistics(engine, tmp_path):
    e = Engine(engine.source, Conf(statistics_file=str(tmp_path / "s.csv")))
    e.run_file("#Q\nSELECT ?x (COUNT(*) AS ?n) { ?x ?p ?o } GROUP BY ?x", str(tmp_path / "out"))
    got = e.recorder.rows[0]
    assert got.rows == 4 and got.jobs >= 1 and got.bytes_out > 0 and got.seconds > 0
    assert (tmp_path / "s.csv").read_text().splitlines()[0].split(",") == [f.name for f in dataclasses.fields(got)]


def test_repeated_keys(spark):
    """Where a key may name several rows, patterns of one subject combine all of its triples, as triples do."""
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "c", None)], "id long, u string, v string")
    for unique, n in ((False, 4), (True, 2)):
        m = Mapping("t", "id", {"u": "<u>", "v": "<v>"}, unique=unique)
        assert Engine(TableTriples(spark, [Source(m, df)])).query("SELECT ?s ?a ?b { ?s <u> ?a ; <v> ?b }").count() == n


def test_stored_values(spark):
    """Tables' values join and compare as stored, and look like terms in the end, quotes and unbound ones included."""
    df = spark.createDataFrame([(1, 'say "hi"', 2, 1.5), (2, None, 1, None), (3, "back\\slash", 9, 2.0)], "id long, u string, f int, d double")
    source = TableTriples(spark, [Source(Mapping("t", "id", {"u": "<u>", "f": "<f>", "d": "<d>"}, {"f": "t"}), df)])
    triples = FrameTriples(source.pattern(None, None, None)[0])
    for text in (
        "SELECT ?s ?o { ?s <f> ?o }", "SELECT ?s ?n { ?s <f>/<u> ?n }", "SELECT ?s ?p ?o { ?s ?p ?o }", 'SELECT ?s { ?s <u> "say \\"hi\\"" }', "SELECT ?s { ?s ?p <urn:t/1> }", "SELECT ?p { <urn:t/3> ?p ?o }",
        "SELECT ?s { ?s <d> ?d FILTER(?d > 1.6) }", "SELECT ?s { ?s <f> ?o FILTER(?o != <urn:t/9>) }", "SELECT ?s { ?s <f> ?o FILTER(?o IN (<urn:t/1>, <urn:x>)) }", "SELECT ?s ?x { { ?s <f> ?x } UNION { ?s <d> ?x } }",
        "SELECT ?s { ?s <u> ?n FILTER(isLiteral(?n) && !isIRI(?n)) }", "SELECT ?s { ?s <f> ?n FILTER(isIRI(?n)) }", "SELECT (MAX(?o) AS ?m) (COUNT(DISTINCT ?o) AS ?n) { ?s <f> ?o }", "SELECT ?s ?u { ?s <f> ?x OPTIONAL { ?x <u> ?u } }",
        "SELECT ?s { <urn:t/2> <f> ?s }", "SELECT ?s { <urn:t/02> <f> ?s }", "CONSTRUCT { ?o <r> ?s } { ?s <f> ?o }", "SELECT (STR(?s) AS ?t) { ?s <d> ?d }",
    ):
        assert rows(Engine(source).query(text)) == rows(Engine(triples).query(text)), text


@pytest.mark.parametrize("call", ["<urn:f>()", "<urn:f>(?n)", "<urn:f>(?x, ?n)", "strlen(?x, ?n)", "lang()"])
def test_unknown_calls(engine, call):
    """Functions with no, one or several arguments that aren't known by name and number raise."""
    with pytest.raises(UnsupportedFunction):
        engine.query(f"SELECT ?x {{ ?x <name> ?n FILTER({call}) }}")


def test_blank_node_constant():
    with pytest.raises((SyntaxError, UnsupportedQuery)):
        parse("SELECT ?x { ?x <name> ?n FILTER(?x = _:b) }")


def test_main(spark, tmp_path, monkeypatch):
    """A file of queries over N-Triples, with settings from a file; results are replaced only if that is asked for."""
    monkeypatch.chdir(tmp_path)
    (tmp_path / "in.nt").write_text('<a> <n> "x" .\n<b> <n> "y"@en .\n')
    (tmp_path / "q").write_text("#Q\nSELECT ?o { <b> <n> ?o }\n#Q\n// left out\n#Q\nSELECT (COUNT(*) AS ?n) { ?s ?p ?o }\n")
    (tmp_path / "c.ini").write_text("keep.tags=true\nstatistics.file=cost.csv\n")
    assert main(["in.nt"]) == 2
    assert main([str(tmp_path / "in.nt"), str(tmp_path / "q"), str(tmp_path / "out"), str(tmp_path / "c.ini")]) == 0
    read = lambda k: "".join(f.read_text() for f in (tmp_path / f"out/{k}-output").glob("part-*"))
    assert (read(0), read(1)) == ('"y"@en\n', "2\n") and len((tmp_path / "cost.csv").read_text().splitlines()) == 3
    e = Engine.from_ntriples(spark, str(tmp_path / "in.nt"))
    with pytest.raises(Exception, match="(?i)exist"):
        e.run_file("SELECT ?o { <a> <n> ?o }", str(tmp_path / "out"))
    e.run_file("SELECT ?o { <a> <n> ?o }", str(tmp_path / "out"), overwrite=True)
    assert read(0) == '"x"\n'
