"""The engine: query text in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .conf import Conf
from .operators.compiler import Compiler
from .plans.cache import PlanCache
from .plans.cost import Cost, estimate
from .plans.parser import parse, split_queries
from .sources.ntriples import read_ntriples
from .sources.sinks import Recorder, write_tsv
from .sources.tables import FrameTriples


class Engine:
    """Queries over a source of triples: a DataFrame of s, p, o, or virtual triples over tables."""

    def __init__(self, source, conf: Conf | None = None, cache: bool = False):
        self.source = FrameTriples(source) if isinstance(source, DataFrame) else source
        self.conf = conf or Conf()
        self.cache = PlanCache() if cache else None
        self.recorder = Recorder(self.conf.statistics_file)

    @classmethod
    def from_ntriples(cls, spark: SparkSession, path: str | list[str], conf: Conf | None = None, dedupe: bool = False, cache: bool = False) -> Engine:
        return cls(read_ntriples(spark, path, dedupe, bool(conf and conf.keep_tags)), conf, cache)

    def query(self, text: str) -> DataFrame:
        """Solutions (or triples of a CONSTRUCT or DESCRIBE, or the answer of an ASK) as a lazy DataFrame."""
        return Compiler(self.source, self.conf, self.cache).compile(parse(text, self.conf.keep_tags)).shown().frame

    def cost(self, text: str) -> Cost:
        """What the planner thinks that a query costs."""
        return estimate(parse(text, self.conf.keep_tags), self.source, self.conf)

    def run_file(self, text: str, out: str, overwrite: bool = False) -> list[str]:
        """Run the queries of a query file's text; each result goes to <out>/<n>-output as tab-separated text."""
        paths = []
        for n, q in enumerate(split_queries(text)):
            if self.cache is not None and self.conf.reset_cache_for_each_query:
                self.cache.clear()
            path = f"{out.rstrip('/')}/{n}-output"
            self.recorder.timed(f"{n}", q, self.query(q), lambda df, path=path: write_tsv(df, path, overwrite))
            paths.append(path)
        return paths
