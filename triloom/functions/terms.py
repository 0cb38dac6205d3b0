"""RDF terms as tagged strings: <iri>, "label" and _:id.

Datatype and language tags are dropped on load unless the loader is told to keep them: "label"@en, "1"^^<datatype>.

Columns of tables needn't become strings before the result is shown. A value's kind says what its column holds: `term` (a tagged
string), `num`, `str`, `bool` (computed values), `raw:<type>` (a stored literal) or `id:<table>:<type>` (the key in an IRI).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabulary.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = f"<{RDF}type>"
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def iri(text: str) -> str:
    return f"<{text}>"


def literal(label: str) -> str:
    """A constant's encoding; the loader keeps escapes raw, so a constant is escaped again."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        label = label.replace(a, b)
    return f'"{label}"'


def is_iri(c: Column) -> Column:
    return c.startswith("<")


def is_literal(c: Column) -> Column:
    return c.startswith('"')


def is_blank(c: Column) -> Column:
    return c.startswith("_:")


def label(c: Column) -> Column:
    """Text without its outer tag: "a", "a"@en and <a> give a."""
    plain = F.substring(c, F.lit(2), F.length(c) - 2)
    return F.when(is_iri(c) | (is_literal(c) & c.endswith('"')), plain).when(is_literal(c), F.regexp_extract(c, r'(?s)^"(.*)"[^"]*$', 1)).otherwise(c)


def number(c: Column, kind: str = "double") -> Column:
    """A term's label as a number, null where it is none."""
    return label(c).try_cast(kind)


def as_literal(c: Column) -> Column:
    """A plain value as a literal term."""
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def language(c: Column) -> Column:
    """Language tag of a literal, empty if it has none; null for other terms."""
    return F.when(is_literal(c), F.regexp_extract(c, '"@([A-Za-z0-9-]+)$', 1))


def datatype(c: Column) -> Column:
    """Datatype of a literal as an IRI; that of strings if it has none."""
    found = F.regexp_extract(c, r'"\^\^(<[^>]*>)$', 1)
    plain = F.when(c.endswith('"'), F.lit(f"<{XSD}string>")).otherwise(F.lit(f"<{RDF}langString>"))
    return F.when(is_literal(c), F.when(found != "", found).otherwise(plain))


def stored_term(c: Column, kind: str) -> Column:
    """The term of a stored value: raw:<type> or id:<table>:<type>."""
    what, _, rest = kind.partition(":")
    text = c.cast("string")
    if what == "id":
        return F.concat(F.lit(f"<urn:{rest.rpartition(':')[0]}/"), text, F.lit(">"))
    if rest == "string":
        text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), text, F.lit('"'))


def sort_key(c: Column) -> Column:
    """Order of terms: blank nodes, IRIs, literals with a number by their number, other literals by their label; null stays null."""
    n = F.when(is_literal(c), number(c))
    rank = F.when(is_blank(c), 0).when(is_iri(c), 1).when(n.isNotNull(), 2).otherwise(3)
    return F.when(c.isNotNull(), F.struct(rank.alias("rank"), n.alias("number"), label(c).alias("label")))
