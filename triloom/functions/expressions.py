"""Query expressions as typed Spark columns.

A value is a column and its kind (see `terms`). Casts and divisions that fail give null, as ANSI mode would raise. Next to a
number, a term counts as the number in its label; next to plain text, as its label. Two terms compare as numbers if both
are literals with a number, else by label. Stored values are compared as they are stored, so such filters reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.algebra import Const, Op, UnsupportedFunction, Var
from . import terms

Value = tuple[Column, str]
COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide}


# Datatypes of stored literals.
STORED = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "float", "double": "double", "boolean": "boolean", "timestamp": "dateTime", "timestamp_ntz": "dateTime", "date": "date"}


def is_stored(kind: str) -> bool:
    return kind.startswith(("raw:", "id:"))


def is_number(kind: str) -> bool:
    return kind == "num" or kind.startswith("raw:") and kind[4:] in terms.NUMBERS


def as_number(v: Value, kind: str = "double") -> Column:
    c, k = v
    if k == "num":
        return c
    if is_number(k):
        return c.cast(kind)
    if k.startswith("id:"):
        return F.lit(None).cast(kind)
    return terms.number(c, kind) if k == "term" else c.cast("string").try_cast(kind)


def as_text(v: Value) -> Column:
    c, k = v
    if k.startswith("id:"):
        return terms.label(terms.stored_term(c, k))
    return terms.label(c) if k == "term" else c.cast("string")


def as_term(v: Value) -> Column:
    c, k = v
    return c if k == "term" else terms.stored_term(c, k) if is_stored(k) else terms.as_literal(c)


def as_bool(v: Value) -> Column:
    c, k = v
    if k == "bool":
        return c
    if is_number(k):
        return c != 0
    return terms.label(c).isin("true", "1") if k == "term" else as_text(v).isin("true", "1") if is_stored(k) else c != ""


def sort_key(v: Value) -> Column:
    """What ORDER BY, MIN and MAX go by."""
    c, k = v
    return terms.sort_key(as_term(v)) if k == "term" or k.startswith("id:") else c


def label_of(term: str) -> str:
    """Text of a constant literal, without escapes."""
    out, text, at = [], term[1 : term.rindex('"')], 0
    while at < len(text):
        if text[at] == "\\" and at + 1 < len(text):
            out.append({"n": "\n", "r": "\r", "t": "\t"}.get(text[at + 1], text[at + 1]))
            at += 2
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def stored_equal(v: Value, term: str) -> Column:
    """Whether a stored value is a constant term, as a condition on what is stored."""
    c, k = v
    what, _, rest = k.partition(":")
    if what == "id":
        table, _, kind = rest.rpartition(":")
        prefix = f"<urn:{table}/"
        # an unbound value is neither equal nor unequal
        never = F.when(c.isNotNull(), F.lit(False))
        if not term.startswith(prefix):
            return never
        key = term[len(prefix) : -1]
        if kind not in terms.NUMBERS:
            return c == key
        return c == int(key) if key.lstrip("-").isdigit() and str(int(key)) == key and abs(int(key)) < 2**63 else never
    if not term.startswith('"'):
        return F.when(c.isNotNull(), F.lit(False))
    return c == label_of(term) if rest == "string" else c.cast("string") == label_of(term)


def compare(name: str, a: Value, b: Value) -> Column:
    how, kinds = COMPARE[name], {a[1], b[1]}
    if "num" in kinds:
        # stored numbers stay as they are: a cast would keep the filter from the files
        x, y = (v[0] if is_number(v[1]) else as_number(v) for v in (a, b))
        return how(x, y)
    if "bool" in kinds:
        return how(as_bool(a), as_bool(b))
    if "str" in kinds:
        return how(as_text(a), as_text(b))
    if a[1] == b[1] and (a[1].startswith("raw:") or a[1].startswith("id:") and name in ("=", "!=")):
        return how(a[0], b[0])
    if is_number(a[1]) and is_number(b[1]):
        return how(a[0], b[0])
    x, y = as_term(a), as_term(b)
    literals = terms.is_literal(x) & terms.is_literal(y)
    m, n = (F.when(literals, terms.number(c)) for c in (x, y))
    both = m.isNotNull() & n.isNotNull()
    return F.when(both, how(m, n)).otherwise(how(x, y) if name in ("=", "!=") else how(terms.label(x), terms.label(y)))


def compare_to_constant(name: str, v: Value, e: Const) -> Column | None:
    """The comparison with a constant term, if it can be made on what is stored."""
    if e.value is not None or not is_stored(v[1]) or name not in ("=", "!="):
        return None
    equal = stored_equal(v, e.term)
    return equal if name == "=" else ~equal


def compile_expression(e, columns: dict[str, Value]) -> Value:
    """columns has the column and kind of each variable; an unknown variable is unbound."""
    if isinstance(e, Var):
        return columns.get(e.name, (F.lit(None).cast("string"), "term"))
    if isinstance(e, Const):
        if isinstance(e.value, bool):
            return F.lit(e.value), "bool"
        return (F.lit(e.value), "num") if e.value is not None else (F.lit(e.term), "term")
    assert isinstance(e, Op), e
    name, n = e.name, len(e.args)
    if name == "bound":
        return compile_expression(e.args[0], columns)[0].isNotNull(), "bool"
    args = [compile_expression(a, columns) for a in e.args]
    if name in COMPARE and n == 2:
        for k in range(2):
            if isinstance(e.args[k], Const) and (c := compare_to_constant(name, args[1 - k], e.args[k])) is not None:
                return c, "bool"
        return compare(name, *args), "bool"
    if name in ARITHMETIC and n == 2:
        x, y = (as_number(a).cast("double") if name == "/" or is_stored(a[1]) else as_number(a) for a in args)
        return ARITHMETIC[name](x, y), "num"
    if name == "&&":
        return as_bool(args[0]) & as_bool(args[1]), "bool"
    if name == "||":
        return as_bool(args[0]) | as_bool(args[1]), "bool"
    if name == "!":
        return ~as_bool(args[0]), "bool"
    if name == "in":
        out = F.lit(False)
        for a, x in zip(args[1:], e.args[1:], strict=True):
            c = compare_to_constant("=", args[0], x) if isinstance(x, Const) else None
            out = out | (compare("=", args[0], a) if c is None else c)
        return out, "bool"
    if name == "regex" and n in (2, 3):
        flags = e.args[2].term[1:-1] if n == 3 and isinstance(e.args[2], Const) else ""
        pattern = as_text(args[1])
        if isinstance(e.args[1], Const):  # escapes of the constant are the pattern's own
            raw = e.args[1].term[1:-1].replace('\\"', '"').replace("\\n", "\n").replace("\\\\", "\\")
            pattern = F.lit((f"(?{flags})" if flags else "") + raw)
        return F.regexp_like(as_text(args[0]), pattern), "bool"
    if n == 1:
        v = args[0]
        c, k = v
        if name in ("xsd:float", "xsd:double", "xsd:integer", "xsd:int", "xsd:long", "xsd:decimal"):
            kind = {"xsd:float": "float", "xsd:double": "double", "xsd:decimal": "double"}.get(name, "long")
            return (c.try_cast(kind) if k == "bool" or is_number(k) else as_number(v, kind)), "num"
        if name in ("xsd:string", "str"):
            return as_text(v), "str"
        if name == "xsd:boolean":
            return as_bool(v), "bool"
        if name in ("isiri", "isuri"):
            return (terms.is_iri(c) if k == "term" else c.isNotNull() & F.lit(k.startswith("id:"))), "bool"
        if name == "isliteral":
            return (terms.is_literal(c) if k == "term" else c.isNotNull() & F.lit(not k.startswith("id:"))), "bool"
        if name == "isblank":
            return (terms.is_blank(c) if k == "term" else F.lit(False)), "bool"
        if name == "isnumeric":
            return as_number(v).isNotNull(), "bool"
        if name == "abs":
            return F.abs(as_number(v)), "num"
        if name == "strlen":
            return F.char_length(as_text(v)), "num"
        if name == "lang":
            return (terms.language(c) if k == "term" else F.when(c.isNotNull() & F.lit(not k.startswith("id:")), F.lit(""))), "str"
        if name == "datatype":
            kinds = {"num": "double", "str": "string", "bool": "boolean"}
            return (terms.datatype(c) if k == "term" else F.when(c.isNotNull() & F.lit(not k.startswith("id:")), F.lit(f"<{terms.XSD}{kinds.get(k) or STORED.get(k[4:], 'string')}>"))), "term"
        if name in ("namespace", "localname"):
            cut = F.regexp_extract(as_text(v), r"^(.*[/#:])([^/#:]*)$", 1 if name == "namespace" else 2)
            return F.when(terms.is_iri(as_term(v)), cut), "str"
        if name in ("ucase", "lcase"):
            return (F.upper if name == "ucase" else F.lower)(as_text(v)), "str"
    if name == "langmatches" and n == 2:
        tag, wanted = F.lower(as_text(args[0])), F.lower(as_text(args[1]))
        return F.when(wanted == "*", tag != "").otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-")))), "bool"
    if name == "sameterm" and n == 2:
        return as_term(args[0]) == as_term(args[1]), "bool"
    if name in ("strstarts", "strends", "contains") and n == 2:
        return getattr(F, {"strstarts": "startswith", "strends": "endswith", "contains": "contains"}[name])(as_text(args[0]), as_text(args[1])), "bool"
    if name == "coalesce" and n:
        same = {k for _, k in args}
        return (F.coalesce(*(c for c, _ in args)), same.pop()) if len(same) == 1 else (F.coalesce(*(as_term(a) for a in args)), "term")
    if name == "if" and n == 3:
        same = {args[1][1], args[2][1]}
        x, y = (args[1][0], args[2][0]) if len(same) == 1 else (as_term(args[1]), as_term(args[2]))
        return F.when(as_bool(args[0]), x).otherwise(y), same.pop() if len(same) == 1 else "term"
    raise UnsupportedFunction(f"{name} with {n} arguments")
