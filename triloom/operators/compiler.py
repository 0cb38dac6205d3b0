"""Algebra to DataFrames. Each variable is a column; kinds tell term columns from stored and computed ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import Conf
from ..functions.expressions import Value, as_bool, as_number, as_term, as_text, compile_expression, is_stored, sort_key, stored_equal
from ..plans import cost
from ..plans.algebra import BGP, Ask, Const, Construct, Distinct, Exists, Extend, Filter, Group, LeftJoin, Minus, NJoin, Order, Pattern, Project, Slice, Union, UnsupportedQuery, Values, Var, pattern_variables
from ..plans.order import order_joins
from ..plans.sampling import estimate_join
from .joins import compatible_join, narrow, natural_join, skew_join


@dataclass
class Solutions:
    """frame, the kind of each column that isn't a term, and the variables that may be unbound."""

    frame: DataFrame
    kinds: dict[str, str]
    maybe: frozenset

    def kind(self, c: str) -> str:
        return self.kinds.get(c, "term")

    def values(self) -> dict[str, Value]:
        return {c: (F.col(f"`{c}`"), self.kind(c)) for c in self.frame.columns}

    def with_terms(self, columns) -> Solutions:
        """The same with these columns as terms."""
        some = {c for c in columns if self.kind(c) != "term"}
        if not some:
            return self
        frame = self.frame.select(*[(as_term(v) if c in some else v[0]).alias(c) for c, v in self.values().items()])
        return Solutions(frame, {c: k for c, k in self.kinds.items() if c not in some}, self.maybe)

    def shown(self) -> Solutions:
        """The same with stored values as terms."""
        return self.with_terms([c for c in self.frame.columns if is_stored(self.kind(c))])


@dataclass(frozen=True)
class Star:
    """Patterns of one subject over one table: a single scan."""

    patterns: tuple
    subject: Var


class Compiler:
    def __init__(self, source, conf: Conf, cache=None):
        self.source, self.conf, self.cache = source, conf, cache
        self.estimates: dict = {}
        #: Tables whose keys a variable of the basic graph pattern at hand can name.
        self.domains: dict[str, set[str]] = {}

    # patterns and joins

    def pattern(self, p: Pattern) -> Solutions:
        """Solutions of a triple pattern; without variables, a row for each match and no meaningful column."""
        bound = [x.term if isinstance(x, Const) else None for x in (p.s, p.p, p.o)]
        df, kinds = self.source.pattern(*bound, *(self.domains.get(x.name) if isinstance(x, Var) else None for x in (p.s, p.o)))
        places: dict[str, str] = {}
        for name, x in (("s", p.s), ("p", p.p), ("o", p.o)):
            if isinstance(x, Var):
                if x.name in places:
                    df = df.where(same_term((F.col(places[x.name]), kinds.get(places[x.name], "term")), (F.col(name), kinds.get(name, "term"))))
                else:
                    places[x.name] = name
        if not places:  # an existence check
            return Solutions(df.limit(1).select(), {}, frozenset())
        return self.distinct_if_wanted(df.select(*[F.col(c).alias(v) for v, c in places.items()]), {v: kinds[c] for v, c in places.items() if c in kinds})

    def star(self, node: Star) -> Solutions:
        source = self.source.star([p.p.term for p in node.patterns])
        df, columns, equal = source.whole(), {node.subject.name: source.subject()}, []
        for p in node.patterns:
            value = source.object(self.source.column(source, p.p.term))
            if isinstance(p.o, Const):
                df = df.where(stored_equal(value, p.o.term))
                continue
            df = df.where(value[0].isNotNull())
            if p.o.name in columns:
                equal.append(same_term(columns[p.o.name], value))
            else:
                columns[p.o.name] = value
        for c in equal:
            df = df.where(c)
        return self.distinct_if_wanted(df.select(*[c.alias(v) for v, (c, _) in columns.items()]), {v: k for v, (_, k) in columns.items()})

    def distinct_if_wanted(self, df: DataFrame, kinds: dict[str, str]) -> Solutions:
        return Solutions(df.distinct() if self.conf.distinct_preprocessing else df, kinds, frozenset())

    def grouped(self, patterns: tuple) -> list:
        """Patterns with stars merged: those of one subject variable with bound predicates of one keyed table."""
        out, stars = [], {}
        for p in patterns:
            if self.conf.stars and isinstance(p.s, Var) and isinstance(p.p, Const) and (s := self.source.star([p.p.term])) is not None:
                stars.setdefault((p.s.name, id(s)), []).append(p)
            else:
                out.append(p)
        for (name, _), ps in stars.items():
            out.append(Star(tuple(ps), Var(name)) if len(ps) > 1 else ps[0])
        return out

    def inputs_cost(self, node) -> cost.Cost:
        if isinstance(node, Star):
            return cost.scan(min(cost.pattern_rows(p, self.source, self.conf) for p in node.patterns), self.conf)
        return cost.estimate(node, self.source, self.conf)

    def most_rows(self, node) -> int | None:
        """Rows that a pattern or star can't exceed, by counts of its predicates; None if nothing is counted."""
        patterns = node.patterns if isinstance(node, (Star, BGP)) else [node] if isinstance(node, Pattern) else []
        counts = [self.source.rows(p.p.term if isinstance(p.p, Const) else None) for p in patterns]
        return min((n for n in counts if n is not None), default=None)

    def sample_pair(self, left, right) -> float | None:
        key = (left, right)
        if key not in self.estimates:
            a, b = self.same_kinds(self.tree(left), self.tree(right))
            on = [c for c in a.frame.columns if c in b.frame.columns]
            self.estimates[key] = estimate_join(a.frame, b.frame, on, self.conf.sample_rate, self.conf.sampling_threshold) if on else None
        got = self.estimates[key]
        return None if got is None else got.rows

    def ordered(self, patterns: tuple):
        """Tree of joins over a basic graph pattern."""
        inputs = self.grouped(patterns)
        if len(inputs) == 1:
            return inputs[0]
        if not self.conf.optimize:
            return NJoin(tuple(inputs))
        shown = [as_shown(x) for x in inputs]
        sampler = self.sample_pair if "sampling" in self.conf.cost_calculator else None
        return order_joins(shown, [self.inputs_cost(x) for x in inputs], self.conf, sampler)

    def tree(self, node) -> Solutions:
        """Solutions of a pattern, star or tree of joins."""
        if isinstance(node, BGP):
            return self.star(Star(node.patterns, node.patterns[0].s))
        if isinstance(node, Star):
            return self.star(node)
        if isinstance(node, Pattern):
            return self.pattern(node)
        # inputs that are counted to be small are broadcast; the largest goes first, so that it isn't
        parts = sorted(node.parts, key=lambda n: -(self.most_rows(n) or float("inf")))
        rest, out = [(n, self.tree(n)) for n in parts], None
        while rest:  # an input that shares a variable comes before one that doesn't
            k = next((i for i, (_, s) in enumerate(rest) if out is None or set(s.frame.columns) & set(out.frame.columns)), 0)
            n, s = rest.pop(k)
            out = s if out is None else self.join(out, s, self.pair_estimate(node), self.most_rows(n))
        return out

    def pair_estimate(self, node: NJoin):
        return (self.estimates.get(node.parts) or self.estimates.get(node.parts[::-1])) if len(node.parts) == 2 else None

    def join(self, a: Solutions, b: Solutions, estimate=None, most: int | None = None) -> Solutions:
        """Salted if a sample has shown skew, the right broadcast if it is counted to be small and narrow, else as Spark decides."""
        a, b = self.same_kinds(a, b)
        if estimate and self.conf.join_skewness and estimate.skewness > self.conf.join_skewness:
            frame = skew_join(a.frame, b.frame, rate=self.conf.sample_rate, dense=self.conf.sampling_threshold, most=self.conf.hot_keys)
        else:
            small = most is not None and most <= self.conf.in_memory_threshold and narrow(b.frame)
            frame = natural_join(a.frame, F.broadcast(b.frame) if small else b.frame, small=self.conf.in_memory_threshold)
        return Solutions(frame, a.kinds | b.kinds, a.maybe | b.maybe)

    # algebra

    def compile(self, node) -> Solutions:
        if self.cache is not None and (hit := self.cache.get(node)) is not None:
            return hit
        got = getattr(self, "on_" + type(node).__name__.lower())(node)
        return self.cache.offer(node, got) if self.cache is not None else got

    def on_bgp(self, node: BGP) -> Solutions:
        if not node.patterns:
            return Solutions(self.source.spark.range(1).select(), {}, frozenset())
        self.domains = self.source.domains(node.patterns)
        return self.tree(self.ordered(node.patterns))

    def on_values(self, node: Values) -> Solutions:
        """Constants, as a local table."""
        schema = ", ".join(f"`{n}` string" for n in node.names)
        frame = self.source.spark.createDataFrame([tuple(r) for r in node.rows], schema)
        return Solutions(frame, {}, frozenset(n for k, n in enumerate(node.names) if any(r[k] is None for r in node.rows)))

    def same_kinds(self, a: Solutions, b: Solutions) -> tuple[Solutions, Solutions]:
        """Shared columns of different kinds become terms."""
        differ = [c for c in a.frame.columns if c in b.frame.columns and a.kind(c) != b.kind(c)]
        return a.with_terms(differ), b.with_terms(differ)

    def both(self, a: Solutions, b: Solutions, how: str) -> Solutions:
        a, b = self.same_kinds(a, b)
        shared = set(a.frame.columns) & set(b.frame.columns)
        maybe = shared & (a.maybe | b.maybe)
        if self.conf.strict_optional and maybe:
            frame = compatible_join(a.frame, b.frame, maybe, how, self.conf.in_memory_threshold)
        else:
            frame = natural_join(a.frame, b.frame, how, self.conf.in_memory_threshold)
        unbound = a.maybe | b.maybe | ((set(b.frame.columns) - shared) if how == "left" else frozenset())
        return Solutions(frame, a.kinds | b.kinds, frozenset(unbound))

    def on_njoin(self, node: NJoin) -> Solutions:
        """Parts in the order of their estimated rows, those that share a variable first."""
        parts = sorted(node.parts, key=lambda p: cost.estimate(p, self.source, self.conf).rows) if self.conf.optimize else list(node.parts)
        rest = [self.compile(p) for p in parts]
        out = rest.pop(0)
        while rest:
            k = next((i for i, s in enumerate(rest) if set(s.frame.columns) & set(out.frame.columns)), 0)
            out = self.both(out, rest.pop(k), "inner")
        return out

    def on_leftjoin(self, node: LeftJoin) -> Solutions:
        a, b = self.same_kinds(self.compile(node.left), self.compile(node.right))
        if node.condition is None:
            return self.both(a, b, "left")
        shared = [c for c in a.frame.columns if c in b.frame.columns]
        right = b.frame.select(*[F.col(f"`{c}`").alias(f"__r_{c}") if c in shared else F.col(f"`{c}`") for c in b.frame.columns])
        condition = as_bool(compile_expression(node.condition, a.values() | {c: v for c, v in b.values().items() if c not in shared}))
        for c in shared:
            condition = condition & (F.col(c) == F.col(f"__r_{c}"))
        frame = a.frame.join(right, condition, "left").drop(*[f"__r_{c}" for c in shared])
        return Solutions(frame, a.kinds | b.kinds, a.maybe | b.maybe | (frozenset(b.frame.columns) - set(shared)))

    def on_exists(self, node: Exists) -> Solutions:
        """Semi or anti join; filters of the inner pattern may name outer variables."""
        a, inner, conditions = self.compile(node.left), node.right, []
        while isinstance(inner, Filter):
            conditions.append(inner.condition)
            inner = inner.child
        a, b = self.same_kinds(a, self.compile(inner))
        shared = [c for c in a.frame.columns if c in b.frame.columns]
        right = b.frame.select(*[F.col(f"`{c}`").alias(f"__r_{c}") for c in b.frame.columns])
        condition = F.lit(True)
        for c in shared:
            condition = condition & (F.col(c) == F.col(f"__r_{c}"))
        values = {c: (F.col(f"__r_{c}"), k) for c, (_, k) in b.values().items()} | a.values()
        for e in conditions:
            condition = condition & as_bool(compile_expression(e, values))
        if not shared and not conditions:  # one row on the right decides
            right = right.limit(1)
        return Solutions(a.frame.join(right, condition, "left_anti" if node.negated else "left_semi"), a.kinds, a.maybe)

    def on_minus(self, node: Minus) -> Solutions:
        a, b = self.same_kinds(self.compile(node.left), self.compile(node.right))
        shared = [c for c in a.frame.columns if c in b.frame.columns]
        return Solutions(a.frame.join(b.frame.select(*shared), shared, "left_anti") if shared else a.frame, a.kinds, a.maybe)

    def on_union(self, node: Union) -> Solutions:
        parts = [self.compile(p) for p in node.parts]
        differ = [c for c in {c for p in parts for c in p.frame.columns} if len({p.kind(c) for p in parts if c in p.frame.columns}) > 1]
        parts = [p.with_terms(set(differ) & set(p.frame.columns)) for p in parts]
        every = {c for p in parts for c in p.frame.columns}
        out, kinds, maybe = None, {}, frozenset().union(*(p.maybe for p in parts))
        for p in parts:
            kinds |= p.kinds
            maybe |= every - set(p.frame.columns)
            out = p.frame if out is None else out.unionByName(p.frame, allowMissingColumns=True)
        return Solutions(out, kinds, maybe)

    def on_filter(self, node: Filter) -> Solutions:
        s = self.compile(node.child)
        return Solutions(s.frame.where(as_bool(compile_expression(node.condition, s.values()))), s.kinds, s.maybe)

    def on_extend(self, node: Extend) -> Solutions:
        s = self.compile(node.child)
        if node.name in s.frame.columns:
            raise UnsupportedQuery(f"?{node.name} is bound already")
        c, kind = compile_expression(node.expression, s.values())
        return Solutions(s.frame.withColumn(node.name, c), s.kinds | ({node.name: kind} if kind != "term" else {}), s.maybe | {node.name})

    def on_group(self, node: Group) -> Solutions:
        s = self.compile(node.child)
        values, kinds, keys = s.values(), {}, []
        for name, e in node.keys:
            c, kind = compile_expression(Var(name) if e is None else e, values)
            keys.append(c.alias(name))
            if kind != "term":
                kinds[name] = kind
        aggregates = []
        for name, a in node.aggregates:
            c, kind = self.aggregate(a, values)
            aggregates.append(c.alias(name))
            if kind != "term":
                kinds[name] = kind
        if not aggregates:
            return Solutions(s.frame.select(*keys).distinct(), kinds, s.maybe)
        return Solutions(s.frame.groupBy(*keys).agg(*aggregates), kinds, s.maybe | {n for n, _ in node.aggregates})

    def aggregate(self, a, values):
        if a.arg is None:
            columns = [c for c, _ in values.values()]
            return (F.count_distinct(F.struct(*columns)) if a.distinct and columns else F.count(F.lit(1))), "num"
        v = compile_expression(a.arg, values)
        if a.name == "count":
            return (F.count_distinct(v[0]) if a.distinct else F.count(v[0])), "num"
        if a.name in ("sum", "avg"):
            c = as_number(v).cast("double") if is_stored(v[1]) else as_number(v)
            return {("sum", False): F.sum, ("sum", True): F.sum_distinct, ("avg", False): F.avg, ("avg", True): lambda x: F.sum_distinct(x) / F.count_distinct(x)}[a.name, a.distinct](c), "num"
        if a.name in ("min", "max"):
            if v[1] == "term" or v[1].startswith("id:"):  # by the order of terms: numbers by their value
                return (F.min_by if a.name == "min" else F.max_by)(as_term(v), sort_key(v)), "term"
            return (F.min if a.name == "min" else F.max)(v[0]), v[1]
        if a.name == "sample":
            return F.min(v[0]), v[1]  # any value will do; the least one is the same on every run
        texts = (F.collect_set if a.distinct else F.collect_list)(as_text(v))
        return F.array_join(F.sort_array(texts), a.separator), "str"

    def on_project(self, node: Project) -> Solutions:
        return self.projected(self.compile(node.child), node.names)

    def projected(self, s: Solutions, names, more=()) -> Solutions:
        columns = [F.col(f"`{n}`") if n in s.frame.columns else F.lit(None).cast("string").alias(n) for n in names]
        return Solutions(s.frame.select(*columns, *more), {c: k for c, k in s.kinds.items() if c in names}, s.maybe | (frozenset(names) - set(s.frame.columns)))

    def on_distinct(self, node: Distinct) -> Solutions:
        """Distinct rows; in order, if the rows come ordered: by the least (descending: the greatest) key of equal rows."""
        if not (isinstance(node.child, Project) and isinstance(node.child.child, Order)):
            s = self.compile(node.child)
            return Solutions(s.frame.distinct(), s.kinds, s.maybe)
        order = node.child.child
        inner = self.compile(order.child)
        keys = [sort_key(compile_expression(e, inner.values())) for e, _ in order.keys]
        keyed = Solutions(inner.frame.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)]), inner.kinds, inner.maybe)
        s = self.projected(keyed, node.child.names, [f"__k{i}" for i in range(len(keys))])
        columns = [F.col(f"`{n}`") for n in node.child.names]
        frame = s.frame.groupBy(*columns).agg(*[(F.min if up else F.max)(f"__k{i}").alias(f"__k{i}") for i, (_, up) in enumerate(order.keys)])
        frame = frame.orderBy(*[directed(F.col(f"__k{i}"), up) for i, (_, up) in enumerate(order.keys)]).select(*columns)
        return Solutions(frame, s.kinds, s.maybe)

    def on_order(self, node: Order) -> Solutions:
        s = self.compile(node.child)
        return Solutions(s.frame.orderBy(*[directed(sort_key(compile_expression(e, s.values())), up) for e, up in node.keys]), s.kinds, s.maybe)

    def on_slice(self, node: Slice) -> Solutions:
        s = self.compile(node.child)
        frame = s.frame.offset(node.offset) if node.offset else s.frame
        return Solutions(frame.limit(node.limit) if node.limit is not None else frame, s.kinds, s.maybe)

    def on_construct(self, node: Construct) -> Solutions:
        """A triple per template and solution; blank nodes are named by a hash of the solution; unbound parts drop the triple."""
        s = self.compile(node.child)
        values, out = s.values(), None
        row = [F.coalesce(as_term(values[c]), F.lit("")) for c in sorted(s.frame.columns)]

        def part(x):
            if isinstance(x, Const):
                return F.lit(x.term)
            if x.name.startswith("__") and x.name not in s.frame.columns:
                return F.concat(F.lit("_:"), F.sha2(F.concat_ws("\x1f", F.lit(x.name), *row), 256))
            return as_term(values[x.name]) if x.name in values else F.lit(None).cast("string")

        for t in node.templates:
            df = s.frame.select(part(t.s).alias("subject"), part(t.p).alias("predicate"), part(t.o).alias("object"))
            out = df if out is None else out.unionByName(df)
        return Solutions(out.where("subject is not null and predicate is not null and object is not null"), {}, frozenset())

    def on_ask(self, node: Ask) -> Solutions:
        s = self.compile(node.child)
        return Solutions(s.frame.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer")), {"answer": "bool"}, frozenset())


def same_term(a: Value, b: Value) -> Column:
    return a[0] == b[0] if a[1] == b[1] else as_term(a) == as_term(b)


def directed(key: Column, up: bool) -> Column:
    return key.asc_nulls_first() if up else key.desc_nulls_last()


def as_shown(x):
    """An input as the planner sees it: stars as the patterns they stand for."""
    return BGP(x.patterns) if isinstance(x, Star) else x


__all__ = ["Compiler", "Solutions", "pattern_variables"]
