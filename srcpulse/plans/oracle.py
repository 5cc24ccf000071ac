"""The registered queries once more, in plain SQL for DuckDB, written from the rules and not from the Spark plans."""

from __future__ import annotations

from srcpulse.functions import style as st
from srcpulse.functions.text import STYLE_EXTENSIONS, SUPPORTED_EXTENSIONS
from srcpulse.operators import rollups as ru, style as so
from srcpulse.sources import adapters as A


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(q(v) for v in values)


def round_exact(x: str, digits: int = 2) -> str:
    """Round a double to even by its exact value, as ``round_half_even`` does; ``x`` is a column name."""
    s = f"1e{digits}"
    low = f"floor({x} * {s})"
    carry = f"({x} * 134217729e0)"
    high = f"({carry} - ({carry} - {x}))"
    side = f"(({high} * (2 * {s}) - ({low} * 2 + 1)) + ({x} - {high}) * (2 * {s}))"
    return f"(CASE WHEN {side} > 0 OR ({side} = 0 AND {low} % 2 <> 0) THEN {low} + 1 ELSE {low} END / {s})"


EXT = r"regexp_extract(file_path, '[^/](\.[^/.]+)$', 1)"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


# --- predictions ---------------------------------------------------------------------------------
PRED = f"pred AS ({A.sql_view('orders', A.PREDICTIONS)})"
LATEST = (
    f"{PRED}, newest AS (SELECT file_path, max(ts) AS ts FROM pred GROUP BY file_path), "
    "latest AS (SELECT pred.* FROM pred JOIN newest USING (file_path, ts))"
)
LATEST_ONE = (
    f"{PRED}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, "
    "decay_score DESC, prediction_id) AS r FROM pred) WHERE r = 1)"
)
MEAN = "coalesce(CAST(sum(CAST(decay_score AS DECIMAL(20,10))) AS DOUBLE) / nullif(count(*), 0), 0e0)"


def summary(levels, where) -> str:
    counts = ", ".join(f"count(*) FILTER (risk_level = '{lv}') AS {lv}_count" for lv in levels)
    return (
        f"WITH {LATEST}, s AS (SELECT count(*) AS total_files_analyzed, {counts}, {MEAN} AS m FROM latest {where}) "
        f"SELECT total_files_analyzed, {', '.join(lv + '_count' for lv in levels)}, {round_exact('m')} AS average_decay_score FROM s"
    )


# --- history -------------------------------------------------------------------------------------
def numbered(columns) -> str:
    return (
        f"met AS ({A.sql_view('lineitem', columns)}), num AS (SELECT *, row_number() OVER "
        f"(PARTITION BY file_path ORDER BY {A.SQL_METRICS_ORDER}) AS rn FROM met)"
    )


def trend(metric: str, order: str, first: int = 1, last: int = 10, name: str = "t") -> str:
    """CTEs ending in ``name(file_path, trend)``."""
    way = "rn" if order == "reference" else "rn DESC"
    return f"""
{name}_v AS (SELECT file_path, {metric} AS v, row_number() OVER (PARTITION BY file_path ORDER BY {way}) AS i,
    count(*) OVER (PARTITION BY file_path) AS n
  FROM num WHERE rn BETWEEN {first} AND {last} AND {metric} IS NOT NULL),
{name}_h AS (SELECT file_path, max(n) AS n,
    sum(v ORDER BY i) FILTER (i <= n // 2) / nullif(max(n // 2), 0) AS a,
    sum(v ORDER BY i) FILTER (i > n // 2) / max(n - n // 2) AS b
  FROM {name}_v GROUP BY file_path),
{name}_r AS (SELECT file_path, count(*) AS rows_seen FROM num WHERE rn BETWEEN {first} AND {last} GROUP BY file_path),
{name} AS (SELECT file_path, CASE WHEN rows_seen < 2 OR coalesce(n, 0) < 2 THEN 'insufficient_data' WHEN a = 0 THEN 'stable'
    WHEN (b - a) / a * 100 > 10 THEN 'increasing' WHEN (b - a) / a * 100 < -10 THEN 'decreasing' ELSE 'stable' END AS trend
  FROM {name}_r LEFT JOIN {name}_h USING (file_path))"""


def trends(order: str) -> str:
    return (
        f"WITH {numbered(A.METRICS)}, {trend('cyclomatic_complexity', order, name='c')}, "
        f"{trend('maintainability_index', order, name='m')} "
        "SELECT file_path, c.trend AS cyclomatic_complexity_trend, m.trend AS maintainability_index_trend "
        "FROM c JOIN m USING (file_path)"
    )


def complexity_risk(cc: str, tr: str) -> str:
    return (
        f"least(1e2, greatest(0e0, CASE WHEN {cc} >= 30 THEN 4e1 WHEN {cc} >= 20 THEN 25e0 ELSE {cc} / 2e1 * 15e0 END + "
        f"CASE {tr} WHEN 'increasing' THEN 25e0 WHEN 'decreasing' THEN -1e1 ELSE 0e0 END))"
    )


def complexity_warnings(cc: str, mi: str, tr: str) -> list[str]:
    return [
        f"CASE WHEN {cc} >= 30 THEN 'Very high complexity (' || CAST({cc} AS VARCHAR) || '). Consider refactoring.' "
        f"WHEN {cc} >= 20 THEN 'High complexity (' || CAST({cc} AS VARCHAR) || '). Monitor closely.' END",
        f"CASE WHEN {mi} < 20 THEN 'Very low maintainability index (' || CAST({mi} AS VARCHAR) || '). Refactor recommended.' END",
        f"CASE WHEN {tr} = 'increasing' THEN 'Complexity is increasing over time.' END",
    ]


CURRENT_WITH_TREND = f"""WITH {numbered(A.METRICS)}, {trend('cyclomatic_complexity', 'reference', 2, 11, 'c')},
cur AS (SELECT file_path, coalesce(cyclomatic_complexity, 0) AS cc, maintainability_index AS mi FROM num WHERE rn = 1),
j AS (SELECT file_path, cc, mi, coalesce(c.trend, 'insufficient_data') AS tr FROM cur LEFT JOIN c USING (file_path))
SELECT file_path, cc AS current_complexity, tr AS complexity_trend, {complexity_risk('cc', 'tr')} AS complexity_risk_score,
 concat_ws(' | ', {', '.join(complexity_warnings('cc', 'mi', 'tr'))}) AS complexity_warnings FROM j"""


# --- commits -------------------------------------------------------------------------------------
def recent(source: str, columns, as_of: str, days: int) -> str:
    return (
        f"com AS ({A.sql_view(source, columns)}), rec AS (SELECT * FROM com WHERE ts >= TIMESTAMP '{as_of}' - INTERVAL {days} DAY "
        f"AND ts <= TIMESTAMP '{as_of}')"
    )


def sliding_churn(source: str, columns, days: int, slide: int) -> str:
    """Statistics, risk and flags per file and window end, from every commit and window end that holds it."""
    ch = {"n": "n", "a": "authors", "g": "gap"}
    return f"""WITH com AS ({A.sql_view(source, columns)}),
ends AS (SELECT TIMESTAMP '1970-01-01' + to_days(CAST(d AS INTEGER)) AS window_end FROM
  (SELECT unnest(range(CAST(floor(epoch(min(ts)) / 86400 / {slide}) AS BIGINT) * {slide},
    CAST(ceil(epoch(max(ts)) / 86400) AS BIGINT) + {days + slide}, {slide})) AS d FROM com)),
held AS (SELECT window_end, com.* FROM com JOIN ends ON ts <= window_end AND ts >= window_end - INTERVAL {days} DAY),
gaps AS (SELECT *, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY file_path, window_end ORDER BY ts))) / 86400000000) AS gap FROM held),
agg AS (SELECT file_path, window_end, count(*) AS n, count(DISTINCT author) AS authors, sum(gap) / nullif(count(*) - 1, 0) AS g,
  min(ts) AS last_modified, max(ts) AS latest_change FROM gaps GROUP BY file_path, window_end),
done AS (SELECT *, CASE WHEN n > 1 THEN {round_exact('g')} ELSE {days}e0 END AS gap FROM agg)
SELECT file_path, window_end, n AS change_frequency, authors AS authors_count, gap AS avg_days_between_changes, last_modified, latest_change,
  {CHURN_RISK.format(**ch)} AS churn_risk_score, n > 10 AS is_hotspot, {CHURN_WARNINGS.format(**ch)} AS churn_warnings FROM done"""


def churn(source: str, columns, as_of: str, days: int) -> str:
    """CTEs ending in ``churn``; gaps between neighbouring commits, one by one."""
    return f"""{recent(source, columns, as_of, days)},
gaps AS (SELECT *, CAST(floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY file_path ORDER BY ts))) / 86400000000) AS BIGINT) AS gap FROM rec),
agg AS (SELECT file_path, count(*) AS n, count(DISTINCT author) AS authors, CAST(sum(gap) AS DOUBLE) / nullif(count(*) - 1, 0) AS g,
  min(ts) AS first_ts, max(ts) AS last_ts FROM gaps GROUP BY file_path),
churn AS (SELECT file_path, n AS change_frequency, authors AS authors_count,
  CASE WHEN n > 1 THEN {round_exact('g')} ELSE {days}e0 END AS avg_days_between_changes, first_ts AS last_modified,
  last_ts AS latest_change FROM agg)"""


CHURN_RISK = (
    "least(1e2, CASE WHEN {n} > 20 THEN 3e1 WHEN {n} > 10 THEN 2e1 WHEN {n} > 5 THEN 1e1 ELSE 0e0 END + "
    "CASE WHEN {a} > 5 THEN 2e1 WHEN {a} > 3 THEN 1e1 ELSE 0e0 END + "
    "CASE WHEN {g} > 0 AND {g} < 7 THEN 25e0 WHEN {g} < 14 THEN 15e0 ELSE 0e0 END)"
)
CHURN_WARNINGS = (
    "concat_ws(' | ', CASE WHEN {n} > 15 THEN 'High churn: ' || {n} || ' changes in 90 days.' END, "
    "CASE WHEN {a} > 4 THEN 'Multiple authors (' || {a} || ') may indicate coordination issues.' END, "
    "CASE WHEN {n} > 20 AND {a} > 5 THEN 'Critical: High churn + many authors = high risk.' END)"
)
_CH = {"n": "change_frequency", "a": "authors_count", "g": "avg_days_between_changes"}

# --- text ----------------------------------------------------------------------------------------
CORPUS = f"corpus AS ({A.sql_view('part', A.CORPUS)})"


def lines(source: str, key: str, text: str) -> str:
    """CTE ``ln`` of a text table: one row per line with its position, the next line and the number of lines."""
    return f"""txt AS (SELECT {key}, string_split(CASE WHEN {text} LIKE '%' || chr(10) THEN left({text}, length({text}) - 1) ELSE {text} END, chr(10)) AS ls
  FROM {source} WHERE {text} <> ''),
ex AS (SELECT {key}, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM txt),
ln AS (SELECT *, {strip('line')} AS s, lead(line) OVER (PARTITION BY {key.split(',')[0]} ORDER BY pos) AS nxt FROM ex)"""


def line_profile(source: str, key: str, text: str) -> str:
    return f"""WITH {CORPUS}, {lines(source, key, text)},
c AS (SELECT {key}, CAST(count(*) AS INTEGER) AS line_count, CAST(count(*) FILTER (s <> '') AS INTEGER) AS nonblank_lines,
  CAST(count(*) FILTER (s LIKE '#%' OR s LIKE '//%') AS INTEGER) AS comment_lines FROM ln GROUP BY {key}),
r AS (SELECT *, CAST(comment_lines AS DOUBLE) / line_count AS x FROM c)
SELECT {key}, line_count, nonblank_lines, comment_lines, {round_exact('x', 3)} AS comment_ratio FROM r"""


BLOCKS = r"len(regexp_extract_all(content, '(?m)^\s*(?:async\s+)?def\s'))"
BODY = r"substr(content, length(regexp_extract(content, '(?s)^(.*?(?:^|\n)\s*(?:async\s+)?def\s)', 1)) + 1)"
WORDS = rf"len(regexp_extract_all({BODY}, '\b(?:if|elif|for|while|except|with|assert|and|or)\b'))"
COMPLEXITY = f"""cx AS (SELECT *, {EXT} AS ext, {BLOCKS} AS b, {WORDS} AS w FROM corpus),
cy AS (SELECT *, CAST(b + w AS DOUBLE) / nullif(b, 0) AS x FROM cx),
cc AS (SELECT * EXCLUDE (x), CASE WHEN ext = '.py' AND b > 0 THEN {round_exact('x')} ELSE 0e0 END AS complexity FROM cy)"""
FILE_METRICS = rf"""WITH {CORPUS}, {COMPLEXITY}, {lines('corpus', 'file_path', 'content')},
l AS (SELECT file_path, count(*) AS n, count(*) FILTER (s <> '') AS code, count(*) FILTER (s LIKE '#%' OR s LIKE '//%') AS com FROM ln GROUP BY file_path),
tk AS (SELECT *, regexp_extract_all(content, '\w+|[^\w\s]') AS tok FROM cc JOIN l USING (file_path)),
r AS (SELECT *, len(tok) * log2(len(list_distinct(tok))) AS vol, CAST(com AS DOUBLE) / n AS cr FROM tk),
m AS (SELECT *, 171 - 5.2 * ln(vol) - 0.23 * complexity - 16.2 * ln(n) + 50 * sin(sqrt(2.4 * radians(com * 1e2 / n))) AS raw FROM r)
SELECT file_path, CASE WHEN ext IN ({listed(SUPPORTED_EXTENSIONS)}) THEN 'completed' ELSE 'unsupported_file' END AS status,
 CASE WHEN ext IN ({listed(SUPPORTED_EXTENSIONS)}) THEN complexity END AS cyclomatic_complexity,
 CASE WHEN ext = '.py' THEN round(least(1e2, greatest(0e0, raw * 1e2 / 171)), 2) WHEN ext IN ({listed(SUPPORTED_EXTENSIONS)}) THEN 0e0 END AS maintainability_index,
 CASE WHEN ext = '.py' THEN CAST(n AS INTEGER) WHEN ext IN ({listed(SUPPORTED_EXTENSIONS)}) THEN CAST(code AS INTEGER) END AS lines_of_code,
 CASE WHEN ext = '.py' THEN {round_exact('cr', 3)} WHEN ext IN ({listed(SUPPORTED_EXTENSIONS)}) THEN 0e0 END AS comment_ratio
FROM m"""

IMPORTS = r"""im AS (SELECT *, regexp_extract(file_path, '[^/](\.[^/.]+)$', 1) AS ext FROM corpus),
imp AS (SELECT file_path, ext, list_sort(list_distinct(CASE WHEN ext = '.py' THEN regexp_extract_all(content, '(?m)^\s*(?:from|import)\s+([\w.]+)', 1)
  WHEN ext IN ('.js', '.ts', '.jsx', '.tsx') THEN regexp_extract_all(content, 'import\s+.*?from\s+[''"]([^''"]+)[''"]', 1)
  ELSE CAST([] AS VARCHAR[]) END)) AS names FROM im),
deps AS (SELECT file_path, CAST(len(names) AS INTEGER) AS import_count,
  CAST(coalesce(list_max(list_transform(names, lambda x: length(x) - length(replace(x, '.', '')))), 0) AS INTEGER) AS dependency_depth,
  array_to_string(names, ',') AS imports FROM imp)"""
DEPENDENCY_RISK = (
    "least(1e2, CASE WHEN {n} > 30 THEN 3e1 WHEN {n} > 20 THEN 2e1 WHEN {n} > 10 THEN 1e1 ELSE 0e0 END + "
    "CASE WHEN {d} > 5 THEN 25e0 WHEN {d} > 3 THEN 15e0 ELSE 0e0 END)"
)


# --- style ---------------------------------------------------------------------------------------
def _line_rule(order, kind, severity, category, where, message, at="pos") -> str:
    return (
        f"SELECT repo, file_path, {order} AS rule_ord, '{kind}' AS type, '{severity}' AS severity, CAST({at} AS INTEGER) AS line, "
        f"{message} AS message, '{category}' AS category FROM ln WHERE {where}"
    )


def _file_rule(order, kind, severity, category, where, message) -> str:
    return (
        f"SELECT repo, file_path, {order} AS rule_ord, '{kind}' AS type, '{severity}' AS severity, 0 AS line, "
        f"{q(message)} AS message, '{category}' AS category FROM fl WHERE {where}"
    )


def _labels(patterns) -> str:
    cases = " ".join(f"WHEN regexp_matches(line, {q(p.replace('(?iU)', '(?i)'))}) THEN {q(name)}" for p, name in patterns)
    return f"(CASE {cases} END)"


def style_cte(corpus: str = CORPUS) -> str:
    """CTEs ending in ``issues``."""
    todo, secret = _labels(st.PLACEHOLDERS), _labels(st.SECRETS)
    todo_text = f"{q(st.PLACEHOLDER_TEXT[0])} || {todo} || {q(st.PLACEHOLDER_TEXT[1])}"
    secret_text = f"{q(st.SECRET_TEXT[0])} || {secret} || {q(st.SECRET_TEXT[1])}"
    generic = " + ".join(f"CAST(regexp_matches(content, {q(p.replace('(?U)', ''))}) AS INTEGER)" for p in st.GENERIC_NAMES)
    py = "ext = '.py'"
    rules = [
        _line_rule(1, "bare_except", "high", st.BUG_PRONE,
                   rf"{py} AND regexp_matches(line, '\bexcept\s*:') AND NOT contains(line, 'pass') AND NOT contains(line, '#')", q(st.BARE_EXCEPT_TEXT)),
        _line_rule(2, "empty_except", "medium", st.BUG_PRONE,
                   rf"{py} AND regexp_matches(s, '^except\s+.*:\s*$') AND nxt IS NOT NULL AND ({strip('nxt')} IN ('pass', '') OR {strip('nxt')} LIKE '#%')",
                   q(st.EMPTY_EXCEPT_TEXT), "pos + 1"),
        _line_rule(3, "empty_catch", "medium", st.BUG_PRONE, "ext IN ('.js', '.ts') AND contains(line, 'catch') AND contains(line, '{}')", q(st.EMPTY_CATCH_TEXT)),
        _line_rule(4, "placeholder_comment", "low", st.AI_STYLE, f"{todo} IS NOT NULL", todo_text),
        _file_rule(5, "magic_numbers", "low", st.BUG_PRONE, r"len(regexp_extract_all(content, '\b(?:[2-9]|[1-9]\d{2,})\b')) >= 5", st.MAGIC_NUMBER_TEXT),
        _file_rule(6, "broad_except_pass", "medium", st.BUG_PRONE, rf"{py} AND regexp_matches(content, 'except\s+Exception\s*:') AND contains(content, 'pass')", st.BROAD_EXCEPT_TEXT),
        _line_rule(7, "hardcoded_secret", "critical", st.BUG_PRONE, f"{secret} IS NOT NULL", secret_text),
        _file_rule(8, "high_comment_ratio", "low", st.AI_STYLE, "code >= 10 AND CAST(com AS DOUBLE) / code > 0.6e0", st.COMMENT_RATIO_TEXT),
        _line_rule(9, "placeholder_comment", "low", st.AI_STYLE, f"{todo} IS NOT NULL", todo_text),
        _file_rule(10, "generic_names", "low", st.AI_STYLE, f"{generic} >= 4", st.GENERIC_NAME_TEXT),
        _line_rule(11, "duplicate_lines", "medium", st.BUG_PRONE, f"pos <= n - 2 AND s = {strip('nxt')} AND length(s) > 20", q(st.DUPLICATE_TEXT)),
    ]
    return f"""{corpus},
sc AS (SELECT * FROM (SELECT *, {EXT} AS ext FROM corpus) WHERE ext IN ({listed(STYLE_EXTENSIONS)}) AND content IS NOT NULL),
{lines('sc', 'file_path, repo, ext', 'content')},
fl AS (SELECT sc.*, coalesce(code, 0) AS code, coalesce(com, 0) AS com FROM sc LEFT JOIN (SELECT file_path, count(*) FILTER (s <> '' AND s NOT LIKE '#%') AS code,
  count(*) FILTER (s LIKE '#%' OR contains(line, '//')) AS com FROM ln GROUP BY file_path) USING (file_path)),
issues AS ({' UNION ALL '.join(rules)})"""


ISSUE_COLUMNS = "file_path, rule_ord, type, severity, line, message, category"
WEIGHT = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 ELSE 3 END"
BY_FILE = (
    f"per AS (SELECT file_path, count(*) AS n, sum({WEIGHT}) AS w, "
    + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in st.SEVERITIES)
    + ", "
    + ", ".join(f"count(*) FILTER (category = '{c}') AS {c}" for c in st.CATEGORIES)
    + " FROM issues GROUP BY file_path)"
)
RANKED = "rk AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rule_ord, line) AS i FROM issues)"


def gate(all_issues: str, files: str) -> str:
    sums = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in st.SEVERITIES)
    return f"""g AS (SELECT count(*) AS total_issues, count(DISTINCT file_path) AS files_with_issues, {sums} FROM {all_issues}),
f AS (SELECT count(*) AS files_checked FROM {files})
SELECT critical = 0 AND high = 0 AS ok, files_checked, files_with_issues, total_issues, {', '.join(st.SEVERITIES)},
 CASE WHEN files_checked = 0 THEN {q(so.NO_FILES)} WHEN critical = 0 AND high = 0 THEN {q(so.GATE_PASSED)} ELSE {q(so.GATE_FAILED)} END AS message
FROM g, f"""


UNREADABLE = (
    f"unread AS (SELECT repo, file_path, 0 AS rule_ord, 'check_error' AS type, 'medium' AS severity, 0 AS line, "
    f"{q(st.UNREADABLE_TEXT)} AS message, 'system' AS category FROM corpus WHERE content IS NULL AND {EXT} IN ({listed(STYLE_EXTENSIONS)}))"
)
GAPS_CORPUS = f"corpus AS ({A.sql_view('part', A.CORPUS_WITH_GAPS)})"


def requests_looked_at(max_files: int | None = None, max_bytes: int = 2 * 1024 * 1024) -> str:
    """CTEs ending in ``looked``: every request, or those that a batch of ``max_files`` looks at."""
    if max_files is None:
        max_files = 2**40
    return f"""req AS ({A.sql_view('part', A.PATH_REQUESTS)}), fs AS ({A.sql_view('part', A.SIZED_FILES)}),
o AS (SELECT req.*, row_number() OVER (PARTITION BY batch_id ORDER BY request_ord) AS n,
  CASE WHEN size_bytes IS NULL OR requested_path NOT LIKE repo || '/%' THEN 'rejected' WHEN size_bytes > {max_bytes} THEN 'oversized' ELSE 'valid' END AS outcome
  FROM req LEFT JOIN fs ON requested_path = fs.file_path),
run AS (SELECT *, coalesce(sum(CASE WHEN outcome = 'valid' THEN 1 ELSE 0 END) OVER (PARTITION BY batch_id ORDER BY request_ord
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WHERE n <= {max_files + 1}),
looked AS (SELECT batch_id, repo, request_ord, requested_path, outcome FROM run WHERE before < {max_files})"""


def check_changes() -> str:
    sums = ", ".join(f"sum(coalesce(per.{s}, 0)) AS {s}" for s in st.SEVERITIES)
    shown = ", ".join(
        f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}"
        for c in ("files_checked", "files_with_issues", "total_issues", *st.SEVERITIES, "paths_rejected")
    )
    ok = "coalesce(critical, 0) = 0 AND coalesce(high, 0) = 0"
    return f"""WITH {style_cte(GAPS_CORPUS)}, {BY_FILE}, {requests_looked_at()},
b AS (SELECT batch_id, count(*) AS requested FROM req GROUP BY batch_id),
rj AS (SELECT batch_id, count(*) FILTER (outcome <> 'valid') AS paths_rejected FROM looked GROUP BY batch_id),
s AS (SELECT batch_id, count(*) AS files_checked, count(per.n) AS files_with_issues, sum(coalesce(per.n, 0)) AS total_issues, {sums}
  FROM looked LEFT JOIN per ON requested_path = per.file_path WHERE outcome = 'valid' GROUP BY batch_id)
SELECT batch_id, 'accepted' AS batch_status, {ok} AS ok, {shown},
 CASE WHEN coalesce(files_checked, 0) = 0 THEN {q(so.NO_VALID_FILES)} WHEN {ok} THEN {q(so.GATE_PASSED)} ELSE {q(so.GATE_FAILED)} END AS message
FROM b LEFT JOIN rj USING (batch_id) LEFT JOIN s USING (batch_id)"""


# --- similarity ----------------------------------------------------------------------------------
_DOT = "list_inner_product(q.e, p.e)"
COSINE = f"greatest(0e0, 1e0 - {_DOT} / (sqrt(list_inner_product(q.e, q.e)) * sqrt(list_inner_product(p.e, p.e))))"
SQUARED = "list_inner_product(q.e, q.e) + list_inner_product(p.e, p.e) - 2e0 * " + _DOT


def knn(queries: str, distance: str = COSINE) -> str:
    """CTEs ending in ``nb``: five decay and three bug neighbours of each query."""
    return f"""qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {queries}),
pv AS (SELECT collection, pattern_id, bug_type, severity, CAST(embedding AS DOUBLE[]) AS e FROM ({A.sql_view('embeddings WHERE label < 4', A.PATTERNS)})),
ds AS (SELECT query_id, collection, pattern_id, bug_type, severity, round({distance}, 9) AS distance FROM qv q, pv p),
rd AS (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY distance, pattern_id) AS rank FROM ds),
nb AS (SELECT * FROM rd WHERE rank <= CASE collection WHEN 'decay_patterns' THEN 5 ELSE 3 END)"""


KNN_ROWS = "SELECT query_id, collection, CAST(rank AS INTEGER) AS rank, pattern_id, round(distance, 6) AS distance, bug_type, severity FROM nb"
PATTERN_POINTS = "least(1e2, sum((1e0 - least(distance, 1e0)) * CASE collection WHEN 'decay_patterns' THEN 20 ELSE 30 END ORDER BY collection DESC, rank))"

# --- the whole score -----------------------------------------------------------------------------
ANALYSED = f"""{CORPUS}, {IMPORTS}, {numbered(A.METRICS_CORPUS)},
{trend('cyclomatic_complexity', 'reference', 2, 11, 'c')},
cur AS (SELECT file_path, cyclomatic_complexity AS cc, maintainability_index AS mi FROM num WHERE rn = 1),
{churn('lineitem', A.COMMITS_CORPUS, A.SHIP_AS_OF, 1095)},
{knn('true')},
pr AS (SELECT query_id, {PATTERN_POINTS} AS pattern_risk, count(*) FILTER (collection = 'decay_patterns') AS pm,
  count(*) FILTER (collection = 'bug_patterns') AS bm,
  list(coalesce(bug_type, 'unknown') ORDER BY rank) FILTER (collection = 'bug_patterns') AS bugs FROM nb GROUP BY query_id),
sig AS (SELECT co.repo, co.file_path, coalesce(cc, 0) AS cc, mi, coalesce(c.trend, 'insufficient_data') AS tr, coalesce(change_frequency, 0) AS n,
  coalesce(authors_count, 0) AS a, coalesce(avg_days_between_changes, 1095e0) AS g, import_count, dependency_depth, pattern_risk, pm, bm, bugs,
  {EXT.replace('file_path', 'co.file_path')} IN ({listed(SUPPORTED_EXTENSIONS)}) AS done
  FROM corpus co JOIN deps USING (file_path) LEFT JOIN cur USING (file_path) LEFT JOIN c USING (file_path) LEFT JOIN churn USING (file_path)
  LEFT JOIN pr ON pr.query_id = co.file_id % (SELECT count(*) FROM embeddings)),
rs AS (SELECT *, {complexity_risk('cc', 'tr')} AS cr, {CHURN_RISK.format(n='n', a='a', g='g')} AS vr,
  {DEPENDENCY_RISK.format(n='import_count', d='dependency_depth')} AS dr FROM sig),
raw AS (SELECT *, least(1e2, greatest(0e0, cr * 0.3e0 + vr * 0.25e0 + dr * 0.2e0 + coalesce(pattern_risk, 0) * 0.25e0)) AS x FROM rs),
an AS (SELECT *, CASE WHEN done THEN {round_exact('x')} END AS decay_score, CASE WHEN NOT done THEN NULL WHEN x >= 80 THEN 'critical'
  WHEN x >= 60 THEN 'high' WHEN x >= 40 THEN 'medium' ELSE 'low' END AS risk_level FROM raw)"""
# Strings and comments as one pattern, leftmost first; written for an engine without possessive loops.
_STRINGS = r"""\"\"\"(?:[^\\]|\\(?s:.))*?(?:\"\"\"|\z)|\x27\x27\x27(?:[^\\]|\\(?s:.))*?(?:\x27\x27\x27|\z)|\"(?:[^\"\\\n]|\\(?s:.))*\"?|\x27(?:[^\x27\\\n]|\\(?s:.))*\x27?"""
_SIGNS = r"\*\*=?|//=?|<<=?|>>=?|[<>!=]=|[-+*/%&|^@]=|[-+*/%&|^~<>@]"
_KEY = "False None True as assert async await break class continue def del elif else except finally for from global if import lambda nonlocal pass raise return try while with yield"
LEXED = rf"""tc AS ({A.sql_view('part', A.TEXT_CORPUS)}),
ln AS (SELECT file_path, i, replace(lines[i], chr(9), '        ') AS line FROM
  (SELECT file_path, string_split(regexp_replace(content, '{_STRINGS}|#[^\n]*', ' ', 'g'), chr(10)) AS lines FROM tc WHERE file_path LIKE '%.py') x, unnest(range(1, len(lines) + 1)) t(i)),
li AS (SELECT file_path, i, length(line) - length(ltrim(line)) AS indent, regexp_matches(line, '^\s*(?:async\s+)?def\s') AS starts,
  len(regexp_extract_all(line, '\b(?:if|elif|for|while|except|with|assert|and|or)\b')) AS words
  FROM ln WHERE NOT regexp_matches(line, '^\s*([)\]}}].*)?$')),
ends AS (SELECT d.file_path, d.i, min(l.i) AS stop FROM li d LEFT JOIN li l ON l.file_path = d.file_path AND l.i > d.i AND l.indent <= d.indent WHERE d.starts GROUP BY ALL),
ins AS (SELECT li.*, EXISTS (SELECT 1 FROM ends e WHERE e.file_path = li.file_path AND e.i < li.i AND li.i < coalesce(e.stop, 1000000000)) AS inside FROM li),
fn AS (SELECT file_path, count(*) FILTER (starts AND NOT inside) AS functions,
  (count(*) FILTER (starts) + sum(CASE WHEN inside OR starts THEN words ELSE 0 END))::DOUBLE AS paths FROM ins GROUP BY file_path),
mc AS (SELECT file_path, paths / nullif(functions, 0) AS m FROM fn),
lx AS (SELECT tc.file_path, CASE WHEN m IS NULL THEN 0e0 ELSE {round_exact('m')} END AS cc FROM tc LEFT JOIN mc USING (file_path))"""
TOKEN_CLASSES = rf"""WITH tc AS ({A.sql_view('part', A.TEXT_CORPUS)}),
tk AS (SELECT file_path, [t FOR t IN regexp_extract_all(content, '{_STRINGS}|#[^\n]*|\w+|->|:=|{_SIGNS}') IF t[1] <> '#' AND t NOT IN ('->', ':=')] AS k
  FROM tc WHERE file_path LIKE '%.py'),
cl AS (SELECT file_path, [t FOR t IN k IF t IN ('and', 'in', 'is', 'not', 'or') OR NOT regexp_matches(t, '^[\w\"\x27]')] AS o,
  [t FOR t IN k IF regexp_matches(t, '^[\w\"\x27]') AND NOT list_contains(string_split('{_KEY} and in is not or', ' '), t)] AS d FROM tk)
SELECT file_path, len(o)::INTEGER AS operators, len(list_distinct(o))::INTEGER AS distinct_operators, len(d)::INTEGER AS operands, len(list_distinct(d))::INTEGER AS distinct_operands,
  round((len(o) + len(d)) * log2((len(list_distinct(o)) + len(list_distinct(d)))::DOUBLE), 6) AS volume FROM cl"""
ANALYSED_TEXT = ANALYSED.replace(CORPUS, f"corpus AS ({A.sql_view('part', A.TEXT_CORPUS)}), {LEXED}").replace(
    trend("cyclomatic_complexity", "reference", 2, 11, "c"), trend("cyclomatic_complexity", "reference", 1, 10, "c")
).replace("cur AS (SELECT file_path, cyclomatic_complexity AS cc, maintainability_index AS mi FROM num WHERE rn = 1)", "cur AS (SELECT file_path, cc, 0e0 AS mi FROM lx)")
REFACTOR_DAYS = "CASE WHEN x >= 70 AND g < 14 THEN 30 WHEN x >= 60 THEN 60 WHEN x >= 40 THEN 90 ELSE 180 END"
DECAY_SCORES = f"""WITH {ANALYSED} SELECT file_path, CASE WHEN done THEN 'completed' ELSE 'unsupported_file' END AS status,
 CASE WHEN done THEN cr END AS complexity_risk_score, CASE WHEN done THEN vr END AS churn_risk_score,
 CASE WHEN done THEN dr END AS dependency_risk_score, CASE WHEN done THEN round(pattern_risk, 6) END AS pattern_risk_score,
 decay_score, risk_level, CASE WHEN done THEN 0.75e0 END AS confidence,
 CASE WHEN done THEN TIMESTAMP '{A.SHIP_AS_OF}' + to_days({REFACTOR_DAYS}) END AS optimal_refactor_date FROM an"""
ADVICE = f"""{', '.join(complexity_warnings('cc', 'mi', 'tr'))},
 CASE WHEN n > 10 THEN 'Consider splitting this frequently-changed file into smaller modules' END,
 CASE WHEN import_count > 20 THEN 'High dependency count - review and remove unused imports' END,
 CASE WHEN x >= 70 THEN 'CRITICAL: Schedule refactoring within next sprint' WHEN x >= 50 THEN 'Add to technical debt backlog for next quarter' END"""
RECOMMENDATIONS = f"WITH {ANALYSED} SELECT file_path, concat_ws(' | ', {ADVICE}) AS recommendations FROM an WHERE done"
EXPECTED = """ei AS (SELECT repo, file_path, 1 AS ord, 'complexity_growth' AS type, 'Complexity is increasing - may become unmaintainable' AS description, 0.7e0 AS probability, '3-6 months' AS timeframe
  FROM an WHERE done AND tr = 'increasing'
 UNION ALL SELECT repo, file_path, 2, 'high_churn', 'High change frequency indicates instability', 0.65e0, '1-3 months' FROM an WHERE done AND n > 10
 UNION ALL SELECT repo, file_path, 3, b, 'Similar to known ' || b || ' pattern', 0.6e0, '2-4 months' FROM (SELECT repo, file_path, unnest(bugs) AS b FROM an WHERE done))"""

# --- repositories --------------------------------------------------------------------------------
HYGIENE = rf"""li AS ({A.SQL_LISTING}), tops AS (SELECT repo, lower(split_part(substr(file_path, length(repo) + 2), '/', 1)) AS n FROM li),
hy AS (SELECT repo, bool_or(n = 'readme' OR n LIKE 'readme.%') AS has_readme, bool_or(n LIKE 'license%' OR n = 'copying') AS has_license,
 bool_or(n = '.gitignore') AS has_gitignore, bool_or(n LIKE 'contributing%') AS has_contributing,
 bool_or(contains(n, 'code_of_conduct') OR n = 'conduct.md') AS has_code_of_conduct FROM tops GROUP BY repo)"""


def report() -> str:
    """CTEs ending in ``rep``, one row per repository, over the files that a report lists."""
    style_part = style_cte().split(",\nsc AS", 1)[1]
    sums = ", ".join(f"CAST(sum(coalesce({c}, 0)) AS BIGINT) AS {c}" for c in (*st.CATEGORIES, *st.SEVERITIES))
    counted = ("files_analyzed", "files_skipped", "mean", "high_risk_count", "total_issues", *st.CATEGORIES, *st.SEVERITIES)
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in counted)
    return f"""{ANALYSED}, {EXPECTED}, sc AS{style_part}, {BY_FILE}, {HYGIENE},
cut AS (SELECT * FROM an WHERE regexp_matches(file_path, '\\.(py|js|ts|jsx|tsx|go|rs|java)$')),
sel AS (SELECT cut.*, per.n AS issue_n, {', '.join('per.' + c for c in (*st.SEVERITIES, *st.CATEGORIES))}
  FROM cut LEFT JOIN per ON per.file_path = cut.file_path),
sm AS (SELECT repo, count(*) AS files_analyzed, CAST(0 AS BIGINT) AS files_skipped,
  CAST(sum(CAST(coalesce(decay_score, 0) AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS mean,
  count(*) FILTER (risk_level IN ('high', 'critical')) AS high_risk_count, CAST(sum(coalesce(issue_n, 0)) AS BIGINT) AS total_issues, {sums} FROM sel GROUP BY repo),
rep AS (SELECT * REPLACE ({filled}), concat_ws(' | ', CASE WHEN NOT has_readme THEN {q(ru.ADD_README)} END, CASE WHEN NOT has_license THEN {q(ru.ADD_LICENSE)} END,
  CASE WHEN NOT has_gitignore THEN {q(ru.ADD_GITIGNORE)} END, CASE WHEN NOT has_contributing THEN {q(ru.ADD_CONTRIBUTING)} END,
  CASE WHEN critical > 0 THEN {q(ru.FIX_CRITICAL)} END, CASE WHEN ai_style >= 5 THEN {q(ru.TIGHTEN_STYLE)} END,
  CASE WHEN high_risk_count > 0 THEN high_risk_count || {q(ru.HIGH_RISK_FILES)} WHEN mean >= 50 THEN {q(ru.ELEVATED_RISK)} END,
  CASE WHEN bug_prone_style >= 8 THEN {q(ru.TIGHTEN_ERRORS)} END) AS suggestions FROM hy LEFT JOIN sm USING (repo))"""


# --- URLs ----------------------------------------------------------------------------------------
URLS = rf"""u AS (SELECT page_id, origin, url, trim(url) AS t FROM ({A.SQL_SOURCE_URLS})),
p AS (SELECT *, regexp_extract(t, '^([a-z]+)://', 1) AS scheme,
  replace(lower(regexp_replace(regexp_extract(t, '^[a-z]+://([^/?#]*)', 1), '^.*@', '')), 'www.github.com', 'github.com') AS host,
  list_filter(string_split(regexp_extract(t, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS seg FROM u),
c AS (SELECT *, CASE WHEN t = '' THEN 'empty' WHEN scheme <> 'https' THEN 'not_https'
  WHEN host NOT IN ('github.com', 'raw.githubusercontent.com') THEN 'host_not_allowed'
  WHEN host = 'raw.githubusercontent.com' AND len(seg) < 4 THEN 'missing_raw_path'
  WHEN host = 'github.com' AND len(seg) < 2 THEN 'missing_owner_or_repo' END AS reason FROM p),
cu AS (SELECT *, host = 'raw.githubusercontent.com' AS raw, seg[3] IN ('blob', 'tree') AND len(seg) >= 4 AS tree FROM c)"""
SOURCE_URLS = rf"""WITH {URLS} SELECT page_id, origin, url, reason, CASE WHEN reason IS NULL THEN seg[1] END AS owner,
 CASE WHEN reason IS NULL THEN regexp_replace(seg[2], '\.git$', '') END AS repo,
 CASE WHEN reason IS NOT NULL THEN NULL WHEN raw THEN seg[3] WHEN tree THEN seg[4] END AS ref,
 CASE WHEN reason IS NOT NULL THEN NULL WHEN raw THEN array_to_string(seg[4:], '/') WHEN tree AND len(seg) > 4 THEN array_to_string(seg[5:], '/') END AS path_in_repo,
 CASE WHEN reason IS NULL THEN raw END AS is_raw_file FROM cu"""

DOCS = "docs AS (SELECT doc_id, text FROM documents)"
SCAN_PROJECT = f"""WITH l AS ({A.sql_view('part', A.LISTING)}) SELECT file_path, size_bytes FROM l WHERE regexp_matches(file_path, '\\.(py|js|ts)$')
 AND size_bytes <= 2097152 AND NOT regexp_matches(file_path, '(^|/)(\\.git|node_modules|__pycache__|venv|\\.venv)/')"""
SCAN_REPOSITORY = f"""WITH l AS ({A.sql_view('part', A.LISTING)}) SELECT file_path, size_bytes FROM l WHERE file_path LIKE 'src/%'
 AND regexp_matches(file_path, '\\.(py|js|ts|jsx|tsx|go|rs|java)$') AND size_bytes <= 2097152
 AND NOT regexp_matches(file_path, '/(\\.git|node_modules|__pycache__|venv|\\.venv|dist|build)/') AND NOT regexp_matches(file_path, '/\\.[^/]+/')"""

# --- every query ---------------------------------------------------------------------------------
ORACLE: dict[str, str] = {
    "high_risk_latest": f"WITH {LATEST} SELECT prediction_id, file_path, ts, decay_score, risk_level FROM latest WHERE decay_score >= 70",
    "high_risk_report": f"WITH {LATEST} SELECT 7e1 AS threshold, count(*) AS count FROM latest WHERE decay_score >= 70",
    "latest_predictions": f"WITH {LATEST} SELECT prediction_id, file_path, ts, decay_score, risk_level FROM latest",
    "latest_one_per_file": f"WITH {LATEST_ONE} SELECT prediction_id, file_path, ts, decay_score, risk_level FROM one",
    "prediction_status": f"WITH {LATEST_ONE}, r AS ({A.sql_view('customer', A.STATUS_REQUESTS)}) SELECT r.file_path, "
    "CASE WHEN one.ts IS NULL THEN 'not_analyzed' ELSE 'analyzed' END AS status, decay_score, risk_level, ts FROM r LEFT JOIN one ON r.file_path = one.file_path",
    "summary_reference": summary(("critical", "high", "medium"), "WHERE decay_score >= 60"),
    "risk_summary": summary(("critical", "high", "medium", "low"), ""),
    "history_last_n": f"WITH {numbered(A.METRICS)} SELECT file_path, ts, cyclomatic_complexity, lines_of_code, maintainability_index, change_frequency FROM num WHERE rn <= 10",
    "trend_reference": trends("reference"),
    "trend_chronological": trends("chronological"),
    "current_with_trend": CURRENT_WITH_TREND,
    "current_with_stored_trend": f"WITH {CORPUS}, {COMPLEXITY}, {numbered(A.METRICS_CORPUS)}, {trend('maintainability_index', 'chronological', name='m')} "
    "SELECT file_path, complexity AS cyclomatic_complexity, coalesce(m.trend, 'insufficient_data') AS maintainability_index_trend FROM cc LEFT JOIN m USING (file_path)",
    "commit_gaps": f"WITH {churn('lineitem', A.COMMITS_SUPP, A.SHIP_AS_OF, 90)}, d AS (SELECT file_path, CAST(floor(epoch_us(ts) / 86400000000) AS BIGINT) AS day, "
    "count(*) AS commits, max(gap) AS g FROM gaps GROUP BY ALL) "
    "SELECT file_path, day, commits, CASE WHEN day > min(day) OVER (PARTITION BY file_path) THEN g END AS gap_days FROM d",
    "change_stats_90d": f"WITH {churn('lineitem', A.COMMITS_SUPP, A.SHIP_AS_OF, 90)} SELECT * FROM churn",
    "change_stats_all_files": f"WITH {churn('lineitem', A.COMMITS_CORPUS, A.SHIP_AS_OF, 90)}, {CORPUS} SELECT file_path, coalesce(change_frequency, 0) AS change_frequency, "
    "coalesce(authors_count, 0) AS authors_count, coalesce(avg_days_between_changes, 9e1) AS avg_days_between_changes, last_modified, latest_change "
    "FROM corpus LEFT JOIN churn USING (file_path)",
    "change_stats_events": f"WITH {churn('events', A.SQL_COMMITS_EVENTS, A.EVENTS_AS_OF, 90)} SELECT * FROM churn",
    "churn_risk": f"WITH {churn('lineitem', A.COMMITS_SUPP, A.SHIP_AS_OF, 90)} SELECT file_path, {CHURN_RISK.format(**_CH)} AS churn_risk_score, "
    f"{CHURN_WARNINGS.format(**_CH)} AS churn_warnings FROM churn",
    "hotspots": f"WITH {churn('lineitem', A.COMMITS_SUPP, A.SHIP_AS_OF, 90)} SELECT file_path, change_frequency FROM churn WHERE change_frequency > 10",
    "recent_changed_paths": f"WITH {recent('lineitem', A.COMMITS_PART, A.SHIP_AS_OF, 30)} SELECT DISTINCT file_path FROM rec",
    "support_status": f"WITH {GAPS_CORPUS} SELECT file_path, CASE WHEN {EXT} NOT IN ({listed(SUPPORTED_EXTENSIONS)}) THEN 'extension' WHEN content IS NULL THEN 'unreadable' END AS reason, "
    f"CASE WHEN {EXT} NOT IN ({listed(SUPPORTED_EXTENSIONS)}) OR content IS NULL THEN 'unsupported_file' ELSE 'supported' END AS status FROM corpus",
    "line_profile": line_profile("corpus", "file_path", "content"),
    "line_profile_docs": line_profile("documents", "doc_id", "text"),
    "branch_complexity": f"WITH {CORPUS}, {COMPLEXITY} SELECT file_path, complexity AS cyclomatic_complexity FROM cc",
    "maintainability": FILE_METRICS,
    "style_issues": f"WITH {style_cte()} SELECT {ISSUE_COLUMNS} FROM issues",
    "style_risk": f"WITH {style_cte()}, {BY_FILE} SELECT corpus.file_path, CAST(coalesce(n, 0) AS INTEGER) AS issue_count, CAST(least(100, coalesce(w, 0)) AS INTEGER) AS style_risk_score "
    "FROM corpus LEFT JOIN per USING (file_path)",
    "style_issues_top25": f"WITH {style_cte()}, {RANKED}, k AS (SELECT file_path, count(*) AS c FROM issues GROUP BY file_path) "
    "SELECT file_path, CAST(i AS INTEGER) AS issue_no, type, line, CAST(c AS INTEGER) AS style_issue_count FROM rk JOIN k USING (file_path) WHERE i <= 25",
    "style_warnings_top10": f"WITH {style_cte()}, {RANKED}, w AS (SELECT file_path, string_agg(message, ' | ' ORDER BY i) AS m FROM rk WHERE i <= 10 GROUP BY file_path) "
    "SELECT corpus.file_path, coalesce(m, '') AS style_warnings FROM corpus LEFT JOIN w USING (file_path)",
    "duplicate_lines_docs": f"WITH {DOCS}, {lines('docs', 'doc_id', 'text')} SELECT doc_id, CAST(pos AS INTEGER) AS line FROM ln "
    f"WHERE pos <= n - 2 AND s = {strip('nxt')} AND length(s) > 20",
    "user_rule_docs": rf"WITH {DOCS}, {lines('docs', 'doc_id', 'text')} SELECT doc_id, CAST(pos AS INTEGER) AS line, 'token_in_text' AS type, 'critical' AS severity FROM ln "
    r"""WHERE regexp_matches(line, 'token\s*=\s*"[0-9a-f]{40}"')""",
    "magic_numbers_docs": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '\b(?:[2-9]|[1-9]\d{2,})\b')) >= 5",
    "gate_report": f"WITH {style_cte()}, {gate('issues', 'corpus')}",
    "severity_counts": f"WITH {style_cte()} SELECT " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in st.SEVERITIES) + " FROM issues",
    "style_rollup": f"WITH {style_cte()} SELECT 'category' AS dimension, category AS value, count(*) AS issues FROM issues GROUP BY category "
    "UNION ALL SELECT 'severity', severity, count(*) FROM issues GROUP BY severity UNION ALL SELECT 'total', 'all', count(*) FROM issues",
    "check_errors": f"WITH {style_cte(GAPS_CORPUS)}, {UNREADABLE}, al AS (SELECT * FROM issues UNION ALL SELECT * FROM unread), {gate('al', 'corpus')}",
    "change_set": f"WITH s AS ({A.sql_view('part', A.CHANGE_STATUS)}) SELECT repo, file_path, status FROM s WHERE status = 'staged' "
    "OR (status = 'modified' AND repo NOT IN (SELECT repo FROM s WHERE status = 'staged'))",
    "paths_in_repo": f"WITH r AS ({A.sql_view('part', A.PATH_REQUESTS)}), f AS ({A.sql_view('part', A.SIZED_FILES)}) "
    "SELECT batch_id, requested_path, requested_path IN (SELECT file_path FROM f) AS known FROM r",
    "validate_paths": f"WITH {requests_looked_at()} SELECT * FROM looked",
    "validate_paths_first60": f"WITH {requests_looked_at(60)} SELECT * FROM looked",
    "path_counts": f"WITH {requests_looked_at()} SELECT batch_id, count(*) FILTER (outcome = 'valid') AS valid_paths, count(*) FILTER (outcome <> 'valid') AS paths_rejected FROM looked GROUP BY batch_id",
    "validate_repos": f"WITH r AS ({A.sql_view('part', A.REPO_REQUESTS)}), k AS (SELECT DISTINCT concat('pkg', p_partkey % 20) AS repo FROM part) "
    "SELECT request_id, length(repo_path) AS path_length, CASE WHEN repo_path = '' OR repo_path = '/' OR length(repo_path) > 4096 THEN 'invalid' "
    "WHEN repo_path NOT IN (SELECT repo FROM k) THEN 'not_found' ELSE 'ok' END AS repo_status FROM r",
    "check_changes": check_changes(),
    "check_changes_issues": f"WITH {style_cte(GAPS_CORPUS)}, {requests_looked_at()} SELECT batch_id, {ISSUE_COLUMNS} FROM looked JOIN issues ON requested_path = file_path WHERE outcome = 'valid'",
    "import_stats": f"WITH {CORPUS}, {IMPORTS} SELECT file_path, import_count, dependency_depth, imports FROM deps",
    "dependency_risk": f"WITH {CORPUS}, {IMPORTS} SELECT file_path, {DEPENDENCY_RISK.format(n='import_count', d='dependency_depth')} AS dependency_risk_score, "
    "CASE WHEN import_count > 25 THEN 'Very high import count (' || import_count || '). Consider modularization.' "
    "WHEN import_count > 15 THEN 'High import count (' || import_count || '). Monitor dependencies.' ELSE '' END AS dependency_warnings FROM deps",
    "knn_patterns": f"WITH {knn('label >= 4')} {KNN_ROWS}",
    "knn_patterns_codes": f"WITH {knn('label >= 4')} {KNN_ROWS}",
    "knn_patterns_cells": f"WITH {knn('label >= 4')} {KNN_ROWS}",
    "knn_patterns_squared": f"WITH {knn('label >= 4', SQUARED)} {KNN_ROWS}",
    "knn_patterns_squared_codes": f"WITH {knn('label >= 4', SQUARED)} {KNN_ROWS}",
    "pattern_risk": f"WITH {knn('label >= 4')}, x AS (SELECT query_id, {PATTERN_POINTS} AS r, "
    "string_agg(coalesce(bug_type, 'unknown') || '/' || coalesce(severity, 'unknown'), ',' ORDER BY rank) FILTER (collection = 'bug_patterns') AS similar_issues, "
    "count(*) FILTER (collection = 'bug_patterns') AS b, bool_or(collection = 'bug_patterns' AND severity = 'critical') AS crit FROM nb GROUP BY query_id) "
    "SELECT query_id, round(r, 6) AS pattern_risk_score, coalesce(similar_issues, '') AS similar_issues, concat_ws(' | ', CASE WHEN b > 0 THEN 'Similar to ' || b || ' known bug patterns.' END, "
    "CASE WHEN crit THEN 'Matches critical bug pattern - immediate review recommended.' END) AS pattern_warnings FROM x",
    "decay_scores": DECAY_SCORES,
    "decay_recommendations": RECOMMENDATIONS,
    "dashboard_cards": f"WITH {ANALYSED} SELECT file_path, decay_score, upper(risk_level) AS risk, array_to_string(list_filter([{ADVICE}], lambda m: m IS NOT NULL)[1:2], ' | ') AS recommendations "
    "FROM an WHERE done AND decay_score >= 40",
    "predicted_issues": f"WITH {ANALYSED}, {EXPECTED} SELECT file_path, type, description, probability, timeframe FROM ei",
    "top_predicted_types": f"WITH {ANALYSED}, {EXPECTED} SELECT type, count(*) AS n FROM ei GROUP BY type ORDER BY n DESC, type LIMIT 20",
    "avg_decay": f"WITH {ANALYSED}, m AS (SELECT CAST(sum(CAST(coalesce(decay_score, 0) AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS x FROM an) SELECT {round_exact('x')} AS avg_decay_score FROM m",
    "top_risky_files": f"WITH {ANALYSED}, t AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY decay_score DESC, file_path) AS r FROM an WHERE risk_level IN ('high', 'critical')) "
    "SELECT repo, CAST(r AS INTEGER) AS risk_rank, file_path, decay_score, risk_level FROM t WHERE r <= 15",
    "top_risky_predictions": f"WITH p AS ({A.sql_view('orders', (*A.PREDICTIONS, A.PREDICTION_GROUP))}), o AS (SELECT *, row_number() OVER (PARTITION BY file_path "
    "ORDER BY ts DESC, decay_score DESC, prediction_id) AS n FROM p), t AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY decay_score DESC, file_path) AS r "
    "FROM o WHERE n = 1 AND risk_level IN ('high', 'critical')) SELECT repo, CAST(r AS INTEGER) AS risk_rank, file_path, decay_score, risk_level FROM t WHERE r <= 15",
    "repo_hygiene": f"WITH {HYGIENE} SELECT * FROM hy",
    "shareability": f"WITH {report()} SELECT repo, suggestions FROM rep",
    "repo_report": f"WITH {report()} SELECT repo, files_analyzed, files_skipped, {round_exact('mean')} AS avg_decay_score, high_risk_count, "
    f"{', '.join(ru.HYGIENE_FLAGS)}, total_issues, {', '.join(st.CATEGORIES)}, {', '.join(st.SEVERITIES)}, suggestions, "
    "(SELECT coalesce(string_agg(type || '=' || n, ',' ORDER BY n DESC, type), '') FROM (SELECT type, count(*) AS n FROM ei JOIN sel USING (file_path) WHERE sel.repo = rep.repo GROUP BY type ORDER BY n DESC, type LIMIT 20)) AS predicted_issue_types, "
    "(SELECT coalesce(string_agg(file_path, ',' ORDER BY decay_score DESC, file_path), '') FROM (SELECT * FROM sel WHERE sel.repo = rep.repo AND risk_level IN ('high', 'critical') "
    "ORDER BY decay_score DESC, file_path LIMIT 15)) AS highest_risk_files FROM rep",
    "repo_file_results": f"WITH {report()} SELECT repo, file_path, CASE WHEN done THEN 'completed' ELSE 'unsupported_file' END AS status, decay_score, risk_level, "
    "CASE WHEN done THEN (SELECT coalesce(string_agg(type, ',' ORDER BY ord, nth), '') FROM (SELECT *, row_number() OVER () AS nth FROM ei) e WHERE e.file_path = sel.file_path) END AS predicted_issue_types, "
    f"CASE WHEN done THEN concat_ws(' | ', {ADVICE}) END AS recommendations, CAST(coalesce(issue_n, 0) AS BIGINT) AS style_issue_count, "
    "(SELECT coalesce(string_agg(type || ':' || line, ',' ORDER BY rule_ord, line), '') FROM issues i WHERE i.file_path = sel.file_path) AS findings FROM sel",
    "source_url_triage": f"WITH {URLS} SELECT coalesce(reason, 'accepted') AS reason, count(*) AS urls FROM cu GROUP BY 1",
    "source_urls": SOURCE_URLS,
    "url_targets": f"WITH t AS ({A.sql_view('part', A.URL_TARGETS)}), l AS ({A.sql_view('part', A.LISTING[:1])}), "
    "p AS (SELECT *, CASE WHEN NOT is_raw_file AND path_in_repo NOT LIKE '%..%' THEN rtrim(path_in_repo, '/') END AS path FROM t), "
    "d AS (SELECT DISTINCT path FROM p WHERE EXISTS (SELECT 1 FROM l WHERE starts_with(l.file_path, p.path || '/'))) "
    "SELECT url_id, path_in_repo, CASE WHEN path IN (SELECT file_path FROM l) THEN path END AS focus_path, "
    "CASE WHEN path IN (SELECT path FROM d) THEN path END AS walk_root FROM p",
    "pattern_catalogue": f"""WITH p AS ({A.sql_view('embeddings', A.PATTERNS)}),
 s(collection, pattern_id, bug_type, severity) AS (VALUES ('decay_patterns', 'pattern_001', NULL, NULL), ('decay_patterns', 'pattern_002', NULL, NULL), ('decay_patterns', 'pattern_003', NULL, NULL),
  ('bug_patterns', 'bug_001', 'division_by_zero', 'high'), ('bug_patterns', 'bug_002', 'sql_injection', 'critical'), ('bug_patterns', 'bug_003', 'security', 'critical')),
 a AS (SELECT collection, pattern_id, bug_type, severity, CASE WHEN collection = 'bug_patterns' AND CAST(pattern_id AS BIGINT) % 3 = 0 THEN 'reviewed' ELSE severity END AS meta_severity FROM p)
 SELECT collection, pattern_id, bug_type, severity, severity AS meta_severity FROM s UNION ALL SELECT collection, pattern_id, bug_type, severity, meta_severity FROM a""",
    "corpus_scan": SCAN_PROJECT,
    "corpus_scan_repository": SCAN_REPOSITORY,
    "code_sample": "SELECT doc_id, md5(text) AS sample_md5, CAST(length(text) AS INTEGER) AS sample_length FROM documents",
    "code_sample_first10": "WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents) SELECT doc_id, "
    "md5(CASE WHEN len(ls) > 10 THEN array_to_string(ls[1:10], chr(10)) || chr(10) ELSE text END) AS sample_md5, "
    "CAST(length(CASE WHEN len(ls) > 10 THEN array_to_string(ls[1:10], chr(10)) || chr(10) ELSE text END) AS INTEGER) AS sample_length FROM d",
    "short_path": "SELECT page_id, CASE WHEN length(url) > 30 THEN '...' || right(url, 27) ELSE url END AS short_url FROM pages",
    "select_bounded": f"WITH {CORPUS}, r AS (SELECT repo, file_path, row_number() OVER (PARTITION BY repo ORDER BY CASE WHEN file_id % 50 = 7 THEN 0 ELSE 1 END, file_path) AS r, count(*) OVER (PARTITION BY repo) AS c FROM corpus) "
    "SELECT repo, file_path, greatest(c - 60, 0) AS files_skipped FROM r WHERE r <= 60",
    "metrics_append": f"WITH {ANALYSED} SELECT file_path, TIMESTAMP '{A.SHIP_AS_OF}' AS ts, CAST(cc AS DOUBLE) AS cyclomatic_complexity, CAST(n AS INTEGER) AS change_frequency, "
    "CAST(a AS INTEGER) AS authors_count, import_count, dependency_depth FROM an WHERE done",
    "predictions_append": f"WITH {ANALYSED} SELECT file_path, TIMESTAMP '{A.SHIP_AS_OF}' AS ts, decay_score, risk_level, 0.75e0 AS confidence FROM an WHERE done",
    "rf_train_score": f"WITH {ANALYSED} SELECT file_path, decay_score AS target, true AS in_range, true AS beats_mean FROM an WHERE done",
    "decay_features": f"WITH {ANALYSED} SELECT file_path, CAST(cc AS DOUBLE) AS current_complexity, CASE WHEN tr = 'increasing' THEN 1e0 ELSE 0e0 END AS complexity_increasing, "
    "CAST(n AS DOUBLE) AS change_frequency, CAST(a AS DOUBLE) AS authors_count, CAST(import_count AS DOUBLE) AS import_count, "
    "CAST(dependency_depth AS DOUBLE) AS dependency_depth, CAST(coalesce(pm, 0) AS DOUBLE) AS pattern_matches, CAST(coalesce(bm, 0) AS DOUBLE) AS bug_pattern_matches FROM an WHERE done",
    "stream_churn": f"""WITH e AS ({A.sql_view('events', A.SQL_COMMITS_EVENTS)}),
 d AS (SELECT date_trunc('day', ts) AS s, file_path, count(*) AS commits, count(DISTINCT author) AS authors FROM e GROUP BY ALL)
 SELECT s AS window_start, s + INTERVAL 1 DAY AS window_end, file_path, commits AS change_frequency, authors AS authors_count FROM d""",
    "tree_scan": f"""WITH files AS ({A.sql_view('part', A.TREE_FILES)}),
sized AS (SELECT file_path, content, octet_length(encode(content)) AS size_bytes FROM files),
kept AS (SELECT 'project' AS scan, * FROM sized WHERE regexp_matches(file_path, '[.](py|js|ts)$')
    AND NOT regexp_matches('/' || file_path, '/([.]git|node_modules|__pycache__|venv|[.]venv)/')
  UNION ALL SELECT 'repository', * FROM sized WHERE file_path LIKE 'src/%' AND regexp_matches(file_path, '[.](py|js|ts|jsx|tsx|go|rs|java)$')
    AND NOT regexp_matches('/' || file_path, '/([.][^/]*|node_modules|__pycache__|venv|dist|build)/'))
SELECT scan, file_path, size_bytes, CASE WHEN size_bytes > {A.TREE_MAX_BYTES} THEN 'oversized' END AS reason,
  CASE WHEN size_bytes <= {A.TREE_MAX_BYTES} THEN md5(content) END AS content_md5 FROM kept""",
    "project_scan_runs": f"""WITH files AS ({A.sql_view('part', A.TREE_FILES)}),
{recent('lineitem', A.COMMITS_TREE, A.SHIP_AS_OF, 1095)},
kept AS (SELECT 'mono/' || file_path AS file_path, octet_length(encode(content)) > {A.TREE_MAX_BYTES} AS big FROM files
  WHERE regexp_matches(file_path, '[.](py|js|ts)$') AND NOT regexp_matches('/' || file_path, '/([.]git|node_modules|__pycache__|venv|[.]venv)/')),
n AS (SELECT file_path, count(*) AS commits FROM rec GROUP BY file_path)
SELECT 'metrics' AS stored, file_path, 2::BIGINT AS copies, coalesce(commits, 0) AS commits FROM kept LEFT JOIN n USING (file_path) WHERE NOT big
UNION ALL SELECT 'predictions', file_path, 2, NULL FROM kept WHERE NOT big
UNION ALL SELECT 'oversized', file_path, 0, NULL FROM kept WHERE big""",
    "branch_complexity_lexed": f"WITH {LEXED} SELECT file_path, cc AS cyclomatic_complexity FROM lx",
    "token_classes": TOKEN_CLASSES,
    "decay_scores_text": f"""WITH {ANALYSED_TEXT} SELECT file_path, CASE WHEN done THEN 'completed' ELSE 'unsupported_file' END AS status,
 CASE WHEN done THEN cc END AS cyclomatic_complexity, CASE WHEN done THEN cr END AS complexity_risk_score, CASE WHEN done THEN vr END AS churn_risk_score,
 CASE WHEN done THEN dr END AS dependency_risk_score, decay_score, risk_level FROM an""",
    "high_risk_with_count": f"WITH {LATEST}, h AS (SELECT * FROM latest WHERE decay_score >= 70) "
    "SELECT prediction_id, file_path, ts, decay_score, risk_level, 7e1 AS threshold, (SELECT count(*) FROM h) AS count FROM h",
    "repo_report_lists": f"WITH {report()} SELECT repo, "
    "(SELECT coalesce(string_agg(k, ',' ORDER BY k), '') FROM (SELECT type || '=' || count(*) AS k FROM ei JOIN sel USING (file_path) WHERE sel.repo = rep.repo GROUP BY type)) AS predicted_issue_types, "
    "(SELECT coalesce(string_agg(file_path, ',' ORDER BY decay_score DESC, file_path), '') FROM sel WHERE sel.repo = rep.repo AND risk_level IN ('high', 'critical')) AS highest_risk_files FROM rep",
    "rf_out_of_fold": f"WITH {ANALYSED} SELECT file_path, CAST(CAST('0x' || substr(md5(file_path), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold, decay_score AS target, "
    "true AS in_range, true AS beats_mean, true AS same_after_load FROM an WHERE done",
    "commit_log_rejects": " UNION ALL ".join(f"""SELECT '{kind}' AS export, reason, count(*) AS lines, CASE WHEN reason = 'accepted' THEN count(DISTINCT l_partkey) END AS files,
  CASE WHEN reason = 'accepted' THEN count(DISTINCT l_shipdate::DATE) END AS days FROM (SELECT *, CASE WHEN l_orderkey % 50 IN ({bad}) THEN 'malformed' ELSE
  CASE l_orderkey % 50 WHEN 13 THEN 'no_path' WHEN 3 THEN 'no_time' WHEN 8 THEN 'bad_time' ELSE 'accepted' END END AS reason FROM lineitem) GROUP BY reason"""
        for kind, bad in (("csv", "18"), ("json", "18, 23"))),
    "url_reports": f"""WITH {ANALYSED}, lp AS ({A.sql_view('part', (A.LISTING[0], (A.CORPUS[2][0], 'corpus_path')))}),
s AS (SELECT lp.file_path, decay_score, risk_level FROM lp JOIN an ON an.file_path = corpus_path),
t AS ({A.sql_view('part', A.URL_TARGETS)}), p AS (SELECT *, CASE WHEN NOT is_raw_file AND path_in_repo NOT LIKE '%..%' THEN rtrim(path_in_repo, '/') END AS path FROM t),
d AS (SELECT DISTINCT path FROM p WHERE EXISTS (SELECT 1 FROM lp WHERE starts_with(lp.file_path, p.path || '/'))),
tg AS (SELECT url_id, path_in_repo, CASE WHEN path IN (SELECT file_path FROM lp) THEN path END AS focus_path, CASE WHEN path IN (SELECT path FROM d) THEN path END AS walk_root FROM p),
roots AS (SELECT DISTINCT coalesce(walk_root, '') AS root FROM tg),
m AS (SELECT root, s.* FROM roots JOIN s ON (root = '' OR starts_with(s.file_path, root || '/')) AND regexp_matches(s.file_path, '[.](py|js|ts|jsx|tsx|go|rs|java)$')
  AND NOT regexp_matches('/' || substr(s.file_path, CASE WHEN root = '' THEN 1 ELSE length(root) + 2 END), '/([.][^/]*|node_modules|__pycache__|venv|dist|build)/')),
e AS (SELECT url_id, m.file_path, decay_score, risk_level FROM tg JOIN m ON root = coalesce(walk_root, '')
  UNION SELECT url_id, s.* FROM tg JOIN s ON s.file_path = focus_path),
g AS (SELECT url_id, count(*) AS n, CAST(sum(CAST(coalesce(decay_score, 0) AS DECIMAL(20,10))) AS DOUBLE) / count(*) AS x, count(*) FILTER (risk_level IN ('high', 'critical')) AS risky, min(file_path) AS first
  FROM e GROUP BY url_id)
SELECT tg.*, coalesce(n, 0) AS files_analyzed, coalesce({round_exact('x')}, 0e0) AS avg_decay_score, coalesce(risky, 0) AS high_risk_count, coalesce(focus_path, first) AS first_file FROM tg LEFT JOIN g USING (url_id)""",
    "stream_churn_risk": sliding_churn("lineitem", A.COMMITS_SUPP, 90, 30),
    "stream_churn_risk_events": sliding_churn("events", A.SQL_COMMITS_EVENTS, 7, 3),
    "stream_progress": "WITH d AS (SELECT date_trunc('hour', ts) AS s, event_type AS step, count(*) AS events FROM events GROUP BY ALL) "
    "SELECT s AS window_start, s + INTERVAL 1 HOUR AS window_end, step, events FROM d",
    "stream_latest": f"WITH {LATEST} SELECT prediction_id, file_path, ts, decay_score, risk_level FROM latest",
    "stream_latest_upsert": f"WITH {LATEST} SELECT prediction_id, file_path, ts, decay_score, risk_level FROM latest",
    "stream_style_gate": f"WITH {style_cte()}, {gate('issues', 'corpus')}",
}
