import pytest

from triloom.sources.ntriples import parse_lines, read_ntriples, read_triples, write_triples
from triloom.sources.sinks import Recorder, write_tsv

# line and expected object (None: skipped)
LINES = [
    ("<http://a/1> <http://p/x> <http://a/2> .", "<http://a/2>"),
    ('<http://a/1> <http://p/x> "hello"@en .', '"hello"'),
    ('<http://a/1> <http://p/x> "42"^^<http://www.w3.org/2001/XMLSchema#int> .', '"42"'),
    ("_:b0 <http://p/y> <http://a/1> .", "<http://a/1>"),
    ("<http://a/2> <http://p/y> _:b0 .", "_:b0"),
    ('<http://a/3> <http://p/z> "a \\"q\\" b" .', '"a \\"q\\" b"'),
    ('<http://a/3> <http://p/z> "ends\\\\" .', '"ends\\\\"'),
    ("<http://a/1> <http://p/x> <http://a/2> <http://g> .", "<http://a/2>"),
    ('<http://a/1> <http://p/x> "" .', '""'),
    ("<http://a/4> <http://p/z> 42 .", None),
    ("no dot at end", None),
    ("# a comment .", None),
    ("", None),
]


@pytest.mark.parametrize("line,expected", LINES)
def test_line(spark, line, expected):
    got = [r["o"] for r in parse_lines(spark.createDataFrame([(line,)], "value string")).collect()]
    assert got == ([] if expected is None else [expected])


def test_files_and_dedupe(spark, tmp_path):
    import bz2

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.nt").write_text("<s> <p> <o> .\n<s> <p> <o> .\n")
    (tmp_path / "in/b.nt.bz2").write_bytes(bz2.compress(b"<s2> <p> <o> .\n"))
    assert read_ntriples(spark, str(tmp_path / "in")).count() == 3
    triples = read_ntriples(spark, str(tmp_path / "in"), dedupe=True)
    assert triples.count() == 2
    write_triples(triples, str(tmp_path / "store"))
    back = read_triples(spark, str(tmp_path / "store"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, triples.collect()))
    assert "PartitionFilters: [isnotnull(p" in back.where("p = '<p>'")._jdf.queryExecution().toString()


def test_tsv_and_statistics(spark, tmp_path):
    df = spark.createDataFrame([('"a"', None), ("<b>", 2)], "x string, y int")
    rec = Recorder(str(tmp_path / "statistics.csv"))
    rec.timed("0", "q", df, lambda d: write_tsv(d, str(tmp_path / "out")))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert sorted(text.splitlines()) == ['"a"\t', "<b>\t2"]
    assert rec.rows[0].rows == 2 and (tmp_path / "statistics.csv").exists()
