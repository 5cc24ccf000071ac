"""Canonical table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

ISSUE = "struct<rule_ord:int,type:string,severity:string,line:int,message:string,category:string>"
PREDICTED_ISSUE = "struct<type:string,description:string,probability:double,timeframe:string>"
NEIGHBOUR = "struct<pattern_id:string,distance:double,bug_type:string,severity:string>"

_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()
_MAP = T.MapType(T.StringType(), T.StringType())


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SOURCE_FILES = _schema(repo=_S, file_path=_S, content=_S, size_bytes=_L)

COMMITS = _schema(repo=_S, file_path=_S, commit_id=_S, author=_S, ts=_TS)

FILE_METRICS = _schema(
    file_path=_S, ts=_TS, commit_hash=_S, cyclomatic_complexity=_D, lines_of_code=_I, maintainability_index=_D,
    comment_ratio=_D, change_frequency=_I, authors_count=_I, import_count=_I, dependency_depth=_I, extra_data=_MAP,
)

DECAY_PREDICTIONS = _schema(
    file_path=_S, ts=_TS, decay_score=_D, risk_level=_S,
    predicted_issues=T.ArrayType(_schema(type=_S, description=_S, probability=_D, timeframe=_S)),
    confidence=_D, recommendations=T.ArrayType(_S), optimal_refactor_date=_TS,
)

PATTERNS = _schema(
    collection=_S, pattern_id=_S, text=_S, embedding=T.ArrayType(T.FloatType()), pattern_type=_S, decay_probability=_D,
    bug_type=_S, severity=_S, meta=_MAP,
)
