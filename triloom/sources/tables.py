"""Relational tables as virtual triples: <urn:table/key> <urn:p/column> "value", foreign keys as <urn:target/key>.

A pattern with a bound predicate reads one column of one table; patterns of one subject over one table whose key names one
row become a single scan; a variable predicate is one scan of each table. Values stay as they are stored
(kinds `raw:` and `id:`) until they meet others or are shown, so joins go by stored keys and filters reach the Parquet reader.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms
from ..functions.expressions import Value, as_term, stored_equal
from ..plans.algebra import Const, Var


@dataclass(frozen=True)
class Mapping:
    """A table: its key column (none: a hash of all columns), predicate of each column, targets of foreign keys, and whether the key
    names one row. That is a promise of who writes the mapping: patterns of one subject are then one scan, else they are joined,
    and rows that share a key combine as their triples do."""

    table: str
    key: str | None
    columns: dict = field(hash=False)
    links: dict = field(default_factory=dict, hash=False)
    unique: bool = True


@dataclass
class Source:
    """A mapping over a DataFrame; rows is its number of rows, if known."""

    mapping: Mapping
    frame: DataFrame
    rows: int | None = None

    def __post_init__(self):
        self.types = dict(self.frame.dtypes)

    def count(self) -> int:
        if self.rows is None:
            self.rows = self.frame.count()
        return self.rows

    def subject(self) -> Value:
        m = self.mapping
        return (F.col(m.key), f"id:{m.table}:{self.types[m.key]}") if m.key else (F.hex(F.xxhash64(*sorted(self.frame.columns))), f"id:{m.table}:string")

    def object(self, column: str) -> Value:
        kind = self.types[column]
        return F.col(column), f"id:{self.mapping.links[column]}:{kind}" if column in self.mapping.links else f"raw:{kind}"

    def whole(self) -> DataFrame:
        """Rows that have a subject."""
        return self.frame.where(F.col(self.mapping.key).isNotNull()) if self.mapping.key else self.frame


def never(c: Column | None) -> Column:
    return F.lit(False) if c is None else c


class TableTriples:
    """Virtual triples over several tables."""

    def __init__(self, spark: SparkSession, sources: list[Source]):
        self.spark, self.sources = spark, sources
        self.by_predicate: dict[str, list[tuple[Source, str]]] = {}
        for s in sources:
            for column, predicate in s.mapping.columns.items():
                self.by_predicate.setdefault(predicate, []).append((s, column))

    def domains(self, patterns) -> dict[str, set[str]]:
        """Tables whose keys a variable can name, by the positions it has in the patterns. IRIs of different tables differ."""
        out: dict[str, set[str]] = {}
        every = {s.mapping.table for s in self.sources}
        for p in patterns:
            owners = self.by_predicate.get(p.p.term, []) if isinstance(p.p, Const) else None
            if isinstance(p.s, Var):  # no literal is a subject
                out[p.s.name] = out.get(p.s.name, every) & ({s.mapping.table for s, _ in owners} if owners is not None else every)
            if isinstance(p.o, Var) and owners and all(c in s.mapping.links for s, c in owners):
                targets = {s.mapping.links[c] for s, c in owners}
                out[p.o.name] = out.get(p.o.name, targets) & targets
        return out

    def pattern(self, s: str | None, p: str | None, o: str | None, subjects: set[str] | None = None, objects: set[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
        """Triples s, p, o that match the bound positions, and the kinds of those columns that aren't terms. subjects and objects: tables
        whose keys alone are wanted there (see `domains`)."""
        branches = self.by_predicate.get(p, []) if p else [b for bs in self.by_predicate.values() for b in bs]
        branches = [(t, c) for t, c in branches if (subjects is None or t.mapping.table in subjects) and (objects is None or t.mapping.links.get(c) in objects)]
        if p is not None or len(branches) == 1:
            parts = [self.one_predicate(t, c, s, o) for t, c in branches]
        else:
            tables = {id(t): t for t, _ in branches}
            parts = [(self.any_predicate(t, [c for u, c in branches if u is t], s, o), {}) for t in tables.values()]
        if len(parts) == 1:
            return parts[0]
        out = None
        for df, kinds in parts:
            df = df.select(*[as_term((F.col(c), kinds.get(c, "term"))).alias(c) for c in df.columns])
            out = df if out is None else out.unionByName(df)
        return (out if out is not None else self.spark.createDataFrame([], "s string, p string, o string")), {}

    def one_predicate(self, source: Source, column: str, s: str | None, o: str | None) -> tuple[DataFrame, dict[str, str]]:
        df, subject, value = source.whole(), source.subject(), source.object(column)
        if s is not None:
            df = df.where(never(stored_equal(subject, s)))
        df = df.where(value[0].isNotNull() if o is None else never(stored_equal(value, o)))
        return df.select(subject[0].alias("s"), F.lit(source.mapping.columns[column]).alias("p"), value[0].alias("o")), {"s": subject[1], "o": value[1]}

    def any_predicate(self, source: Source, columns: list[str], s: str | None, o: str | None) -> DataFrame:
        """The triples of some columns of a table from one scan; a bound object first keeps the rows that have it in any of them."""
        df, subject, names = source.whole(), source.subject(), source.mapping.columns
        if s is not None:
            df = df.where(never(stored_equal(subject, s)))
        if o is not None:
            some = F.lit(False)
            for c in columns:
                some = some | F.coalesce(never(stored_equal(source.object(c), o)), F.lit(False))
            df = df.where(some)
        triples = F.array(*[F.struct(F.lit(names[c]).alias("p"), as_term(source.object(c)).alias("o")) for c in columns])
        df = df.select(as_term(subject).alias("s"), F.explode(triples).alias("t")).select("s", "t.p", "t.o").where("o is not null")
        return df if o is None else df.where(F.col("o") == o)

    def star(self, predicates: list[str]) -> Source | None:
        """The one table that has all these predicates, if no other table has any of them and its key names one row."""
        owners = [{id(s): s for s, _ in self.by_predicate.get(p, [])} for p in predicates]
        if not owners or any(len(x) != 1 for x in owners) or len({next(iter(x)) for x in owners}) != 1:
            return None
        found = next(iter(owners[0].values()))
        return found if found.mapping.unique else None

    def column(self, source: Source, predicate: str) -> str:
        return next(c for s, c in self.by_predicate[predicate] if s is source)

    def rows(self, p: str | None) -> int | None:
        """Number of triples with a predicate, at most (a table's rows, from the files' footers)."""
        return sum(source.count() for source, _ in (self.by_predicate.get(p, []) if p else [b for bs in self.by_predicate.values() for b in bs]))


class FrameTriples:
    """Triples in a DataFrame of s, p, o. counted: whether predicates may be counted; most: how many counts are kept."""

    def __init__(self, triples: DataFrame, counted: bool = True, most: int = 10_000):
        self.spark, self.triples, self.counted, self.most = triples.sparkSession, triples, counted, most
        self.counts: dict[str, int] | None = None
        self.total = self.least = 0

    def domains(self, patterns) -> dict[str, set[str]]:
        return {}

    def pattern(self, s: str | None, p: str | None, o: str | None, subjects: set[str] | None = None, objects: set[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
        df = self.triples
        for name, value in (("s", s), ("p", p), ("o", o)):
            if value is not None:
                df = df.where(F.col(name) == value)
        return df, {}

    def star(self, predicates: list[str]) -> None:
        return None

    def rows(self, p: str | None) -> int | None:
        """Rows of a predicate, at most: exact for the most frequent ones; any other has no more than the least of those."""
        if not self.counted:
            return None
        if self.counts is None:
            by = self.triples.groupBy("p").count()
            got = by.orderBy(F.desc("count")).limit(self.most).collect()
            self.counts = {r["p"]: r["count"] for r in got}
            self.least = got[-1]["count"] if len(got) == self.most else 0
            self.total = by.agg(F.sum("count")).first()[0] or 0
        return self.counts.get(p, self.least) if p else self.total


def tagged(columns: str, prefix: str = "") -> dict[str, str]:
    return {c: terms.iri(f"urn:p/{prefix}{c}") for c in columns.split()}


#: The relational tables of the test data; columns whose name several tables have carry the table's name.
MAPPINGS = [
    Mapping("region", "r_regionkey", tagged("r_name")),
    Mapping("nation", "n_nationkey", tagged("n_name n_regionkey"), {"n_regionkey": "region"}),
    Mapping("customer", "c_custkey", tagged("c_name c_nationkey c_acctbal c_mktsegment"), {"c_nationkey": "nation"}),
    Mapping("supplier", "s_suppkey", tagged("s_name s_nationkey s_acctbal"), {"s_nationkey": "nation"}),
    Mapping("part", "p_partkey", tagged("p_name p_brand p_type p_size p_retailprice")),
    Mapping("orders", "o_orderkey", tagged("o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"), {"o_custkey": "customer"}),
    Mapping("lineitem", None, tagged("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"), {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}),
    Mapping("events", "event_id", tagged("ts user_id event_type props") | {"value": "<urn:p/events_value>"}),
    Mapping("documents", "doc_id", tagged("lang source n_chars") | {"text": "<urn:p/documents_text>"}),
    Mapping("labels", "doc_id", tagged("quality toxic") | {"doc_id": "<urn:p/labels_doc_id>"}, {"doc_id": "documents"}),
    Mapping("pages", "page_id", tagged("url html")),
    Mapping("benchmark", "item_id", {"text": "<urn:p/benchmark_text>"}),
    Mapping("conversations", None, tagged("conv_id turn role") | {"text": "<urn:p/conversations_text>"}),
]


def open_tables(spark: SparkSession, folder: str, names: list[str] | None = None, mappings: list[Mapping] | None = None) -> TableTriples:
    """Virtual triples over folder/<table>.parquet."""
    chosen = [m for m in mappings or MAPPINGS if names is None or m.table in names]
    return TableTriples(spark, [Source(m, spark.read.parquet(f"{folder}/{m.table}.parquet")) for m in chosen])
