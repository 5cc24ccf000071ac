"""Views of the shipped test tables in the canonical schemas.

Each view is a list of SQL expressions that Spark and DuckDB read alike, so the oracle starts from the
same rows. Where the two differ the DuckDB text is given next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than cores, shuffled to all cores; any larger table as it is.

    The shipped tables are single row groups, which one task would read and then work on alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The same table as a stream. The bracket makes the path a pattern, which fits a file and a folder alike."""
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/[{name[0]}]{name[1:]}.parquet")


def spread_stream(rows: DataFrame) -> DataFrame:
    """Each batch of a stream dealt to all cores, for small rows that much is then made of."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


# --- source files from part ----------------------------------------------------------------------
def corpus_path(key: str) -> str:
    return (
        f"concat('pkg', {key} % 20, '/mod_', {key}, "
        f"CASE {key} % 5 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' ELSE '.py' END)"
    )


def _imports(n: int, deepest: str) -> str:
    names = [f"'import lib{i}'" for i in range(1, n - 1)]
    return f"concat_ws(chr(10), {', '.join(names)}, 'import {deepest}')"


# Files with 11, 16, 21, 26 and 31 imports, one on either side of each step of the import score; up to seven levels deep.
MANY_IMPORTS = "CASE p_partkey % 13 " + " ".join(
    f"WHEN {i} THEN {_imports(n, deepest)}"
    for i, (n, deepest) in enumerate(((11, "a.b"), (16, "a.b.c"), (21, "a.b.c.d"), (26, "a.b.c.d.e"), (31, "a.b.c.d.e.f.g")), 1)
) + " END"

CORPUS_CONTENT = """concat_ws(chr(10),
  'import os',
  MANY_IMPORTS,
  CASE WHEN p_partkey % 2 = 0 THEN 'from pkg.core.io.fmt.base import load' END,
  CASE WHEN p_partkey % 5 < 2 THEN concat('import a from ', chr(34), './x/y.z', chr(34)) END,
  CASE WHEN p_partkey % 3 = 0 THEN '# TODO revisit' END,
  CASE WHEN p_partkey % 7 = 0 THEN concat('password = ', chr(34), p_name, chr(34)) END,
  'def process(x):',
  '    data = x',
  CASE WHEN p_partkey % 4 < 2 THEN '    result = data' END,
  CASE WHEN p_partkey % 4 < 2 THEN '    value = 42 + 365 + 7' END,
  CASE WHEN p_partkey % 9 = 0 THEN concat('    limit = ', p_size, ' * 512 * 3 * 1024 * 9 * 777') END,
  CASE WHEN p_partkey % 4 = 0 THEN concat('    try:', chr(10), '        go()', chr(10), '    except:', chr(10), '        log()') END,
  CASE WHEN p_partkey % 6 = 0 THEN concat('    try:', chr(10), '        go()', chr(10), '    except Exception:', chr(10), '        pass') END,
  CASE WHEN p_partkey % 5 = 0 THEN 'try { run() } catch (e) {}' END,
  CASE WHEN p_partkey % 8 = 3 THEN concat('    total = total + increment_value', chr(10), '    total = total + increment_value') END,
  CASE WHEN p_partkey % 11 = 0 THEN repeat(concat('# note', chr(10)), 14) END,
  '    a = 1', '    b = 1', '    c = 1', '    d = 1', '    e = 1', '    f = 1', '    g = 1',
  '    return data')""".replace("MANY_IMPORTS", MANY_IMPORTS)

# Words of decisions in strings, comments and documentation, nested functions, brackets that close at the margin.
_Q3 = "concat(chr(34), chr(34), chr(34))"
LEXED_CONTENT = f"""concat_ws(chr(10),
  'import os  # if and or',
  CASE WHEN p_partkey % 3 = 0 THEN concat({_Q3}, 'If this', chr(10), 'and that or while', chr(10), 'def fake(x): if x', chr(10), {_Q3}) END,
  'class Part:',
  '    def price(self, size=3):',
  CASE WHEN p_partkey % 2 = 0 THEN concat('        ', {_Q3}, 'for it is', chr(10), 'and or not', chr(10), '        ', {_Q3}) END,
  CASE WHEN p_partkey % 4 < 3 THEN concat('        if size > 4 and self.base != 2:  # elif', chr(10), '            return ', chr(34), 'if # and', chr(34)) END,
  '        for i in range(size):',
  '            total += i * 2 ** i - 0x1f',
  '# while at the margin',
  CASE WHEN p_partkey % 5 = 0 THEN concat('        def inner(x):', chr(10), chr(9), '    return x if x else ~x') END,
  '        return total',
  CASE WHEN p_partkey % 6 < 3 THEN concat_ws(chr(10), 'async def wide(a,', concat('         b=', chr(39), 'it', chr(92), chr(39), 's if', chr(39), ',  # and'), '):',
    '    while a or b:', '        assert a not in b', concat('        a //= ', chr(39), chr(34), chr(39))) END,
  concat('if os.name == ', chr(34), 'nt', chr(34), ' and x:'),
  CASE WHEN p_partkey % 7 = 0 THEN concat('    x = ', chr(34), p_name, ' if') END,
  CASE WHEN p_partkey % 11 = 0 THEN repeat(concat('    y = y or 1', chr(10), 'def g(): return 1 if y else 2'), 9) END,
  '    z = 1')"""

CORPUS = (
    ("p_partkey", "file_id"),
    ("concat('pkg', p_partkey % 20)", "repo"),
    (corpus_path("p_partkey"), "file_path"),
    (CORPUS_CONTENT, "content"),
)
TEXT_CORPUS = (*CORPUS[:3], (LEXED_CONTENT, "content"))
CORPUS_WITH_GAPS = CORPUS[:3] + ((f"CASE WHEN p_partkey % 97 <> 0 THEN {CORPUS_CONTENT} END", "content"),)
CHANGE_STATUS = (
    *CORPUS[1:3],
    (
        "CASE WHEN CAST(floor(p_partkey / 20) AS BIGINT) % 3 = 0 AND p_partkey % 20 < 5 THEN 'staged' "
        "WHEN CAST(floor(p_partkey / 20) AS BIGINT) % 3 = 1 THEN 'modified' ELSE 'unchanged' END",
        "status",
    ),
)
SIZED_FILES = (
    (corpus_path("p_partkey"), "file_path"),
    ("CASE WHEN p_partkey % 11 = 0 THEN CAST(3000000 AS BIGINT) ELSE CAST(1000 AS BIGINT) END", "size_bytes"),
)
PATH_REQUESTS = (
    ("p_partkey % 20", "batch_id"),
    ("concat('pkg', p_partkey % 20)", "repo"),
    ("CAST(floor(p_partkey / 20) AS BIGINT)", "request_ord"),
    (f"CASE WHEN p_partkey % 7 = 0 THEN concat('elsewhere/', p_partkey, '.py') ELSE {corpus_path('p_partkey')} END", "requested_path"),
)
REPO_REQUESTS = (
    ("p_partkey", "request_id"),
    (
        "CASE WHEN p_partkey % 10 = 0 THEN '' WHEN p_partkey % 10 = 1 THEN '/' WHEN p_partkey % 10 = 2 THEN repeat('x', 5000) "
        "WHEN p_partkey % 10 = 3 THEN concat('absent', p_partkey % 13) ELSE concat('pkg', p_partkey % 20) END",
        "repo_path",
    ),
)
# Folders that a scan leaves out, hidden folders and oversized files mixed into the paths.
LISTING = (
    (
        "concat(CASE p_partkey % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/lib/' WHEN 2 THEN 'src/.cache/' WHEN 3 THEN 'dist/' "
        f"WHEN 4 THEN 'src/builder/' ELSE '.git/hooks/' END, {corpus_path('p_partkey')})",
        "file_path",
    ),
    ("CASE WHEN p_partkey % 11 = 0 THEN CAST(3000000 AS BIGINT) ELSE CAST(1000 AS BIGINT) END", "size_bytes"),
)
TREE_FILES = (LISTING[0], (CORPUS_CONTENT, "content"))
TREE_MAX_BYTES = 700
URL_TARGETS = (
    ("p_partkey", "url_id"),
    ("'mono'", "repo"),
    (
        f"CASE p_partkey % 7 WHEN 0 THEN {LISTING[0][0]} WHEN 1 THEN 'src/' WHEN 2 THEN concat('src/builder/pkg', p_partkey % 40) "
        "WHEN 3 THEN concat('absent/', p_partkey) WHEN 4 THEN 'src/../src' WHEN 5 THEN 'src' END",
        "path_in_repo",
    ),
    ("p_partkey % 7 = 5", "is_raw_file"),
)
# Names at the top of a repository: one per flag and divisor of the repository number.
HYGIENE_NAMES = (("README.md", 2), ("LICENSE", 3), (".gitignore", 4), ("CONTRIBUTING.md", 5), ("CODE_OF_CONDUCT.md", 6))


def view(df: DataFrame, columns) -> DataFrame:
    return df.selectExpr(*[f"{expr} AS {name}" for expr, name in columns])


def sql_view(source: str, columns) -> str:
    return "SELECT " + ", ".join(f"{expr} AS {name}" for expr, name in columns) + f" FROM {source}"


def source_files(spark, sf_dir, columns=CORPUS) -> DataFrame:
    return view(spread(table(spark, sf_dir, "part")), columns)


def documents(spark, sf_dir) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def repo_listing(spark, sf_dir) -> DataFrame:
    """Paths of the corpus and the hygiene files of its repositories; every part row may name one of them."""
    part = table(spark, sf_dir, "part")
    files = view(part, CORPUS[1:3])
    names = F.array(*[F.when(F.expr(f"p_partkey % 20 % {d} = 0"), F.lit(n)) for n, d in HYGIENE_NAMES])
    extra = part.select(F.expr("concat('pkg', p_partkey % 20)").alias("repo"), F.explode(F.array_compact(names)).alias("n")).distinct()
    return files.unionByName(extra.select("repo", F.concat_ws("/", "repo", "n").alias("file_path")))


SQL_LISTING = (
    f"{sql_view('part', CORPUS[1:3])} UNION ALL "
    + " UNION ALL ".join(
        f"SELECT DISTINCT concat('pkg', p_partkey % 20) AS repo, concat('pkg', p_partkey % 20, '/{n}') AS file_path "
        f"FROM part WHERE p_partkey % 20 % {d} = 0"
        for n, d in HYGIENE_NAMES
    )
)

# --- commits from lineitem and events ------------------------------------------------------------
COMMITS_SUPP = (("concat('supp/', l_suppkey)", "file_path"), ("CAST(l_partkey AS STRING)", "author"), ("l_shipdate", "ts"))
COMMITS_PART = (("concat('part/', l_partkey)", "file_path"), ("CAST(l_suppkey AS STRING)", "author"), ("l_shipdate", "ts"))
# A fifth of all commits and measurements is about 65 files of many imports, which so are hotspots with short gaps.
BUSY_FILE = corpus_path("(CASE WHEN l_orderkey % 5 = 0 THEN l_partkey % 65 * 13 + 5 ELSE l_partkey END)")
COMMITS_CORPUS = ((BUSY_FILE, "file_path"), *COMMITS_PART[1:])
COMMITS_EVENTS = (
    ("concat('key/', get_json_object(props, '$.k'))", "file_path"), ("CAST(user_id AS STRING)", "author"), ("ts", "ts"),
)
SQL_COMMITS_EVENTS = (
    ("concat('key/', json_extract_string(props, '$.k'))", "file_path"), ("CAST(user_id AS VARCHAR)", "author"), ("ts", "ts"),
)
SHIP_AS_OF = "2001-11-04 00:00:00"
EVENTS_AS_OF = "2024-01-31 00:00:00"

# Lines of a commit log as text exports, a tenth of them broken in one way or another.
_LOG_TIME = "CASE l_orderkey % 50 WHEN 3 THEN '' WHEN 8 THEN 'yesterday' ELSE concat(substr(CAST(l_shipdate AS STRING), 1, 10), ' 00:00:00') END"
_LOG_PATH = "CASE WHEN l_orderkey % 50 = 13 THEN '' ELSE concat('part/', l_partkey) END"
CSV_LINE = f"CASE WHEN l_orderkey % 50 = 18 THEN concat('r,', l_partkey) ELSE concat_ws(',', 'r', {_LOG_PATH}, concat('c', l_orderkey), CAST(l_suppkey AS STRING), {_LOG_TIME}) END"


def _json_field(name: str, value: str) -> str:
    return f"concat(chr(34), '{name}', chr(34), ':', chr(34), {value}, chr(34))"


JSON_LINE = (
    "CASE WHEN l_orderkey % 50 IN (18, 23) THEN concat('{', chr(34), 'repo', chr(34), ': r') ELSE concat('{', concat_ws(',', "
    + ", ".join(_json_field(n, v) for n, v in (("repo", "'r'"), ("file_path", _LOG_PATH), ("author", "CAST(l_suppkey AS STRING)"), ("ts", _LOG_TIME)))
    + "), '}') END"
)
# The files of a written tree, by the part that a line is about.
TREE_PATH = f"concat('mono/', {LISTING[0][0].replace('p_partkey', 'l_partkey')})"
COMMITS_TREE = ((TREE_PATH, "file_path"), *COMMITS_PART[1:])

# --- history from lineitem -----------------------------------------------------------------------
METRICS = (
    ("concat('part/', l_partkey)", "file_path"),
    ("l_shipdate", "ts"),
    ("nullif(l_quantity, 25)", "cyclomatic_complexity"),
    ("CAST(l_linenumber AS INT)", "lines_of_code"),
    ("100 - 2 * l_quantity", "maintainability_index"),
    ("CAST(l_suppkey % 50 AS INT)", "change_frequency"),
    ("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"), ("l_quantity", "l_quantity"),
)
METRICS_TREE = ((TREE_PATH, "file_path"), *METRICS[1:])
METRICS_CORPUS = ((BUSY_FILE, "file_path"), *METRICS[1:])
METRICS_ORDER = ("l_orderkey", "l_linenumber", "l_quantity", "lines_of_code", "change_frequency")
SQL_METRICS_ORDER = "ts DESC, " + ", ".join(f"{c} DESC" for c in METRICS_ORDER)

# --- predictions from orders ---------------------------------------------------------------------
PREDICTIONS = (
    ("o_orderkey", "prediction_id"),
    ("concat('cust/', o_custkey)", "file_path"),
    ("o_orderdate", "ts"),
    ("CAST(round(o_totalprice * 100) AS BIGINT)", "cents"),
    ("CAST(round(o_totalprice * 100) AS BIGINT) / 5e5", "decay_score"),
    (
        "CASE WHEN CAST(round(o_totalprice * 100) AS BIGINT) >= 40000000 THEN 'critical' "
        "WHEN CAST(round(o_totalprice * 100) AS BIGINT) >= 30000000 THEN 'high' "
        "WHEN CAST(round(o_totalprice * 100) AS BIGINT) >= 20000000 THEN 'medium' ELSE 'low' END",
        "risk_level",
    ),
)
PREDICTION_GROUP = ("concat('grp', o_custkey % 20)", "repo")
STATUS_REQUESTS = (("concat('cust/', c_custkey)", "file_path"),)

# --- patterns and query vectors from embeddings --------------------------------------------------
PATTERNS = (
    ("CASE WHEN label < 2 THEN 'decay_patterns' ELSE 'bug_patterns' END", "collection"),
    ("lpad(CAST(vec_id AS STRING), 12, '0')", "pattern_id"),
    ("embedding", "embedding"),
    ("CASE label WHEN 2 THEN 'injection' WHEN 3 THEN 'overflow' END", "bug_type"),
    ("CASE label WHEN 2 THEN 'critical' WHEN 3 THEN 'high' END", "severity"),
)


def patterns(spark, sf_dir) -> DataFrame:
    return view(table(spark, sf_dir, "embeddings").filter("label < 4"), PATTERNS)


def query_vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("label >= 4").selectExpr("vec_id AS query_id", "embedding")


# --- URLs from pages -----------------------------------------------------------------------------
SOURCE_URLS = """CASE page_id % 12
  WHEN 0 THEN concat('https://github.com/own', page_id, '/repo', page_id % 7)
  WHEN 1 THEN concat('https://www.github.com/own/repo', page_id, '.git')
  WHEN 2 THEN concat('https://github.com/own/repo/blob/main/src/f', page_id, '.py')
  WHEN 3 THEN concat('https://github.com/own/repo/tree/v', page_id)
  WHEN 4 THEN concat('https://raw.githubusercontent.com/own/repo/v1.0/docs/', page_id, '/README.md')
  WHEN 5 THEN concat('http://github.com/own/repo', page_id)
  WHEN 6 THEN concat('https://github.com/own', page_id)
  WHEN 7 THEN concat('https://raw.githubusercontent.com/own/repo', page_id)
  WHEN 8 THEN concat('https://evil.example.com/own/repo', page_id)
  WHEN 9 THEN concat('  https://user@GitHub.com/own/repo/issues/', page_id, '?tab=1#top  ')
  WHEN 10 THEN concat('https://github.com:443/own/repo', page_id)
  ELSE '' END"""


def source_urls(spark, sf_dir) -> DataFrame:
    """Each page's own URL and one made from its id, so that every accepted and refused form occurs."""
    both = F.array(
        F.struct(F.lit("page").alias("origin"), F.col("url").alias("url")),
        F.struct(F.lit("derived").alias("origin"), F.expr(SOURCE_URLS).alias("url")),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.explode(both).alias("u")).select("page_id", "u.origin", "u.url")


SQL_SOURCE_URLS = (
    "SELECT page_id, 'page' AS origin, url FROM pages UNION ALL "
    f"SELECT page_id, 'derived' AS origin, {SOURCE_URLS} AS url FROM pages"
)
