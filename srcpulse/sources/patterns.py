"""The catalogue of known-bad code patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from srcpulse.operators.similarity import BUG, DECAY
from srcpulse.schemas import PATTERNS

# --- fixed values: starting catalogue ------------------------------------------------------------
# (id, kind, probability, known issues), then (id, bug type, severity, description, fix)
DECAY_SEEDS = (
    ("pattern_001", "high_complexity", 0.8, "Performance degradation, maintainability issues"),
    ("pattern_002", "high_coupling", 0.7, "Difficult to refactor, tight coupling"),
    ("pattern_003", "global_state", 0.85, "Testing difficulty, race conditions"),
)
BUG_SEEDS = (
    ("bug_001", "division_by_zero", "high", "Missing zero division check", "Add if b == 0: check"),
    ("bug_002", "sql_injection", "critical", "SQL injection vulnerability", "Use parameterized queries"),
    ("bug_003", "security", "critical", "Plaintext password storage", "Hash passwords with bcrypt"),
)
# Sample texts for an embedder; our own examples of each fault.
SEED_TEXTS = {
    "pattern_001": "for row in grid:\n    for cell in row:\n        for part in cell:\n            if part:\n                work(part)",
    "pattern_002": "class Hub:\n    def __init__(self, db, mail, cache, queue, audit, flags):\n        self.all = (db, mail, cache, queue, audit, flags)",
    "pattern_003": "STATE = {}\n\ndef put(k, v):\n    STATE[k] = v",
    "bug_001": "def ratio(x, y):\n    return x / y",
    "bug_002": "sql = \"select * from t where id = \" + user_input",
    "bug_003": "def keep(pw):\n    open('pw.txt', 'a').write(pw)",
}
# -------------------------------------------------------------------------------------------------


def seed_patterns(spark: SparkSession) -> DataFrame:
    """Three decay and three bug patterns. Vectors are an input, so ``embedding`` is null."""
    rows = [
        (DECAY, i, SEED_TEXTS[i], None, kind, p, None, None, {"pattern_type": kind, "decay_probability": str(p), "common_issues": t})
        for i, kind, p, t in DECAY_SEEDS
    ] + [
        (BUG, i, SEED_TEXTS[i], None, None, None, kind, sev, {"bug_type": kind, "severity": sev, "description": d, "fix": fix})
        for i, kind, sev, d, fix in BUG_SEEDS
    ]
    return spark.createDataFrame(rows, PATTERNS)


def full_metadata(bug_type: Column, severity: Column, meta: Column) -> Column:
    """Bug type and severity as metadata; a key that ``meta`` names itself keeps the value of ``meta``."""
    own = F.map_filter(
        F.create_map(F.lit("bug_type"), bug_type, F.lit("severity"), severity), lambda _, v: v.isNotNull()
    )
    given = F.coalesce(meta, F.create_map().cast("map<string,string>"))
    return F.map_zip_with(own, given, lambda _, mine, theirs: F.coalesce(theirs, mine))


def new_patterns(existing: DataFrame, added: DataFrame) -> DataFrame:
    """The rows of ``added`` that the catalogue lacks, once per id, with their metadata made whole.

    Of several rows with one new id the first by text, then by all its columns, is kept; the row number cuts before the
    shuffle.
    """
    keys = ["collection", "pattern_id"]
    first = Window.partitionBy(*keys).orderBy("text", F.to_json(F.struct(*[c for c in added.columns if c not in keys])))
    once = added.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")
    meta = F.when(F.col("collection") == BUG, full_metadata(F.col("bug_type"), F.col("severity"), F.col("meta"))).otherwise(
        F.col("meta")
    )
    return once.join(existing.select(*keys), keys, "left_anti").withColumn("meta", meta)


def with_patterns(existing: DataFrame, added: DataFrame) -> DataFrame:
    return existing.unionByName(new_patterns(existing, added), allowMissingColumns=True)


def append_patterns(added: DataFrame, path: str, existing: DataFrame) -> None:
    new_patterns(existing, added).write.mode("append").parquet(path)
