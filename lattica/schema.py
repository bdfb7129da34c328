"""The four canonical tables and the findings."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, MapType, StringType, StructField, StructType

_S, _I = StringType(), IntegerType()
_MAP, _LIST = MapType(_S, _S), ArrayType(_S)


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


NODES = _struct(node_id=_S, node_type=_S, loc=_S, region=_S, ord=_I, scope=_S, method=_S, callee_path=_S, args=_LIST, str_args=_LIST, props=_MAP)
EDGES = _struct(edge_type=_S, src=_S, dst=_S, props=_MAP, seq=LongType())
LABELS = _struct(node_id=_S, concept=_S, applicator=_S, fidelity=_S, confidence=_S, detail=_MAP, seq=LongType())
CONCEPTS = _struct(name=_S, kind=_S, refines=_S, taint=_LIST, vulnerable_to=_LIST, neutralizes=_LIST, covers=_LIST, aliases=_LIST, excluded_chars=_S, grant_min_level=_S, roles=_LIST)
FINDINGS = _struct(
    rule_id=_S, severity=_S, confidence=_S, witness_kind=_S, fp=_S,
    bindings=ArrayType(_struct(name=_S, node_id=_S, concept=_S, loc=_S)), path=_LIST,
    evidence=ArrayType(_struct(clause=_S, satisfied=BooleanType(), detail=_S)),
)
