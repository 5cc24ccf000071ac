"""Operator 7: exact duplicates by deterministic block naming, in DataFrame operations only.

Texts are cut into blocks of `block_chars` characters. The distinct blocks are dealt by hash, sorted and numbered, each block
becomes its number, and pairs of neighbours are dealt, sorted and numbered again, until every text is one number: two texts have the
same number of the same round if and only if they are equal, as no step maps different things to one number. Texts of
n blocks take ceil(log2 n) rounds; each round's numbers are a written table, so a lost executor never changes them.

Only rows that share length and hash with another row are named, since the others have no copy. Block and group counts
are combined before the shuffle; the joins that bring numbers back are left to the adaptive split of hot keys.

Texts are compared with each run of white space as one space; null counts as empty. Of equal texts the row with the
smallest doc_id stays (null last; of repeated rows one). An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srcpulse.llm.common import written

#: So many (hash, length) pairs of 16 bytes are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _numbered(things: DataFrame, *by: str) -> DataFrame:
    """Distinct rows with integers; written, as the integers must not change.

    Rows stay in the tasks that made them distinct, and each task sorts and numbers its own: no range of texts is sampled for a
    common order, which the numbers do not need."""
    return written(things.select(*by).distinct().sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), "exact-names")


def _renamed(things: DataFrame, *by: str) -> DataFrame:
    """The rows with `name`, the number of their `by` columns.

    Joined by a sort, as numbers in order are stored in so few bytes that a broadcast would be planned on their file size."""
    return things.join(_numbered(things, *by).hint("merge"), list(by)).select("rid", "n", "at", "name")


def names(texts: DataFrame, block_chars: int) -> DataFrame:
    """(rid, round, name) of each row of (rid, norm): equal for equal texts and for no others."""
    blocks = F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), 0))
    cut = texts.select("rid", blocks.alias("blocks"))
    parts = cut.select("rid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("at", "block"))
    level = written(_renamed(parts, "block"), "exact-round")
    done, step = [], 0
    while True:
        done.append(level.where("n = 1").select("rid", F.lit(step).alias("round"), "name"))
        open_ = level.where("n > 1")
        if open_.isEmpty():
            break
        first = F.col("at") % 2 == 0
        pairs = open_.groupBy("rid", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("at") / 2).cast("int").alias("at")).agg(
            F.max(F.when(first, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~first, F.col("name"))), F.lit(-1)).alias("b")
        )
        level = written(_renamed(pairs, "a", "b"), "exact-round")
        step += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 1024) -> DataFrame:
    """`row` (a struct of the columns of `docs`), keep_id, group_size, kept, text_sha256: one row for each of `docs`."""
    norm = normalised(F.col(text_col))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), norm.alias("norm"))
    rows = rows.select("row", "id", "norm", F.xxhash64("norm").alias("h"), F.octet_length("norm").alias("bytes"))
    shared = written(rows.groupBy("h", "bytes").count().where("count > 1").select("h", "bytes"), "exact-shared")
    few = shared.count() <= BROADCAST_KEYS
    shared = F.broadcast(shared) if few else shared.hint("merge")
    alone = rows.join(shared, ["h", "bytes"], "left_anti")
    named = rows.join(shared, ["h", "bytes"], "left_semi").withColumn("rid", F.monotonically_increasing_id())
    named = written(named.select("rid", "row", "id", "norm"), "exact-candidates")
    identity = ["round", "name"]
    of_row = written(names(named.select("rid", "norm"), block_chars).join(named.select("rid", "id"), "rid"), "exact-identities")
    first = F.min(F.struct(F.col("id").isNull().alias("null"), F.col("id").alias("id"), F.col("rid").alias("rid")))
    groups = of_row.groupBy(*identity).agg(first.alias("first"), F.count("*").alias("group_size"))
    of_row = of_row.join(groups, identity).select(
        "rid", F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.rid")).alias("kept")
    )
    sha = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
    return alone.select("row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha).unionByName(
        named.join(of_row, "rid").select("row", "keep_id", "group_size", "kept", sha)
    )


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    return exact_groups(docs, **options).where("kept").select("row.*")
