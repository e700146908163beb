"""Node types and the predicates on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The type names of each family. The Chinese word for proposition is in none of them.
RELATION_TYPES = ("性质", "定理", "引理", "推论", "property", "theorem", "lemma", "proposition", "corollary", "claim", "conjecture", "problem", "observation", "fact")
DEFINITION_TYPES = ("定义", "公理", "definition", "axiom")
EXAMPLE_TYPES = ("例", "例子", "示例", "习题", "练习", "example", "exercise")


def _among(kind: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(F.trim(kind)).isin(*names), F.lit(False))


def is_relation(kind: Column) -> Column:
    """Whether a node of this type states a relation."""
    return _among(kind, RELATION_TYPES)


def is_definition(kind: Column) -> Column:
    """Whether a node of this type defines."""
    return _among(kind, DEFINITION_TYPES)


def is_logic_tuple(kind: Column) -> Column:
    """Whether a node of this type has conditions and conclusions: relations, examples, exercises."""
    return _among(kind, RELATION_TYPES + EXAMPLE_TYPES)


def normal_type(kind: Column) -> Column:
    """Trimmed, and in lower case when all ASCII."""
    t = F.coalesce(F.trim(kind), F.lit(""))
    return F.when(t.rlike("^[\\x00-\\x7F]*$"), F.lower(t)).otherwise(t)
