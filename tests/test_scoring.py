"""Boundary values of every scalar function."""

import itertools

from pyspark.sql import functions as F

from srcpulse.functions import scoring as s
from srcpulse.functions.numbers import bind, round_half_even

C = F.col


def test_rounding_equals_python(spark):
    numbers = sorted({a / b for b in (1, 3, 7, 8, 16, 40, 64, 100, 120, 200) for a in range(0, 500)} | {2.675, 1.005, 0.125, 38.875, 0.29})
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    rows = df.select("x", round_half_even(C("x")).alias("r2"), round_half_even(C("x"), 3).alias("r3")).collect()
    assert [(r.x, r.r2, r.r3) for r in rows if (r.r2, r.r3) != (round(r.x, 2), round(r.x, 3))] == []


def test_bind_names_a_value(values):
    assert values([(3,)], "x int", bind(C("x") + 1, lambda v: v * v)) == [(16,)]


def test_complexity_risk(values):
    rows = [
        (0.0, "stable", 0.0), (10.0, "stable", 7.5), (10.0, "decreasing", 0.0), (19.99, "stable", 14.9925), (20.0, "stable", 25.0),
        (29.99, "increasing", 50.0), (30.0, "increasing", 65.0), (30.0, "decreasing", 30.0), (5.0, "insufficient_data", 3.75),
    ]
    for got, want in values(rows, "cc double, t string, w double", s.complexity_risk(C("cc"), C("t")), "w"):
        assert abs(got - want) < 1e-9


def test_complexity_warnings(values):
    rows = [(30.0, 19.9, "increasing"), (20.0, 20.0, "stable"), (19.0, 50.0, "decreasing")]
    got = values(rows, "cc double, mi double, t string", s.complexity_warnings(C("cc"), C("mi"), C("t")))
    assert got[0][0] == [
        "Very high complexity (30.0). Consider refactoring.", "Very low maintainability index (19.9). Refactor recommended.",
        "Complexity is increasing over time.",
    ]
    assert got[1][0] == ["High complexity (20.0). Monitor closely."]
    assert got[2][0] == []


def test_churn_risk(values):
    rows = [
        (5, 3, 90.0, 0.0), (6, 3, 90.0, 10.0), (11, 4, 14.0, 30.0), (11, 4, 13.99, 45.0), (21, 6, 6.99, 75.0), (21, 6, 7.0, 65.0),
        (2, 1, 0.0, 15.0), (1, 1, 90.0, 0.0),
    ]
    for got, want in values(rows, "n int, a int, g double, w double", s.churn_risk(C("n"), C("a"), C("g")), "w"):
        assert got == want


def test_hotspot_and_churn_warnings(values):
    rows = [(10, 4), (11, 5), (16, 1), (21, 6)]
    got = values(rows, "n int, a int", s.is_hotspot(C("n")), s.churn_warnings(C("n"), C("a")))
    assert [g[0] for g in got] == [False, True, True, True]
    assert [len(g[1]) for g in got] == [0, 1, 1, 3]
    assert got[2][1] == ["High churn: 16 changes in 90 days."]


def test_dependency(values):
    rows = [(10, 3, 0.0), (11, 4, 25.0), (21, 5, 35.0), (31, 6, 55.0)]
    for got, want in values(rows, "n int, d int, w double", s.dependency_risk(C("n"), C("d")), "w"):
        assert got == want
    got = values([(15,), (16,), (25,), (26,)], "n int", s.dependency_warnings(C("n")))
    assert [len(g[0]) for g in got] == [0, 1, 1, 1]
    assert got[2][0][0].startswith("High import") and got[3][0][0].startswith("Very high import")


NB = "array<struct<pattern_id:string,distance:double,bug_type:string,severity:string>>"


def _nb(*distances, severity="high"):
    return [("p", d, "kind", severity) for d in distances]


def test_pattern_risk_and_warnings(values):
    rows = [
        ([], [], 0.0), (_nb(0.0, 0.5, 1.0, 2.0), _nb(0.25), 52.5), (_nb(*[0.0] * 5), _nb(*[0.0] * 3, severity="critical"), 100.0),
    ]
    got = values(
        rows, f"d {NB}, b {NB}, w double", s.pattern_risk(C("d"), C("b")), "w", s.pattern_warnings(C("b")), s.similar_issues(C("b"))
    )
    for risk, want, _, _ in got:
        assert risk == want
    assert got[0][2] == []
    assert got[1][2] == ["Similar to 1 known bug patterns."]
    assert got[2][2] == ["Similar to 3 known bug patterns.", "Matches critical bug pattern - immediate review recommended."]
    assert got[1][3][0].asDict() == {"type": "kind", "severity": "high", "source": "historical_bug_pattern"}


def test_missing_metadata_reads_unknown(values):
    got = values([([("p", 0.1, None, None)],)], f"b {NB}", s.similar_issues(C("b")))
    assert (got[0][0][0]["type"], got[0][0][0]["severity"]) == ("unknown", "unknown")


def test_score_and_level(values):
    rows = [(65.0, 75.0, 55.0, 100.0, 74.25), (0.0, 0.0, 0.0, 0.0, 0.0), (25.0, 45.0, 35.0, 52.5, 38.875), (None, 40.0, None, None, 10.0)]
    for got, want in values(rows, "c double, v double, d double, p double, w double", s.decay_score(C("c"), C("v"), C("d"), C("p")), "w"):
        assert abs(got - want) < 1e-9
    levels = values([(39.99,), (40.0,), (59.99,), (60.0,), (79.99,), (80.0,)], "x double", s.risk_level(C("x")))
    assert [v[0] for v in levels] == ["low", "medium", "medium", "high", "high", "critical"]


def test_refactor_days_and_default_gap(values):
    rows = [(70.0, 13.9, 30), (70.0, 14.0, 60), (60.0, 1.0, 60), (40.0, 1.0, 90), (39.9, 1.0, 180), (75.0, None, 60)]
    for got, want in values(rows, "x double, g double, w int", s.refactor_days(C("x"), C("g")), "w"):
        assert got == want


def test_predicted_issues_and_recommendations(values):
    rows = [("increasing", True, [("security", "critical", "historical_bug_pattern")], ["w"], 21, 70.0), ("stable", False, [], [], 20, 49.9)]
    ddl = "t string, h boolean, s array<struct<type:string,severity:string,source:string>>, w array<string>, n int, x double"
    got = values(rows, ddl, s.predicted_issues(C("t"), C("h"), C("s")), s.recommendations(C("w"), C("h"), C("n"), C("x")))
    assert [(i["type"], i["probability"], i["timeframe"]) for i in got[0][0]] == [
        ("complexity_growth", 0.7, "3-6 months"), ("high_churn", 0.65, "1-3 months"), ("security", 0.6, "2-4 months"),
    ]
    assert got[0][0][2]["description"] == "Similar to known security pattern"
    assert got[0][1] == ["w", s.SPLIT_HOTSPOT, s.TRIM_IMPORTS, s.REFACTOR_NOW]
    assert got[1] == ([], [])


def test_thresholds_are_arguments(values):
    cfg = s.ScoreConfig(hotspot_commits=3, weight_complexity=1.0)
    assert values([(4,)], "n int", s.is_hotspot(C("n"), cfg)) == [(True,)]
    assert values([(50.0,)], "c double", s.decay_score(C("c"), F.lit(None), F.lit(None), F.lit(None), cfg)) == [(50.0,)]


def test_scores_stay_in_range_and_levels_are_monotone(values):
    grid = [(c, v, d, p) for c, v, d, p in itertools.product((0.0, 33.0, 100.0), repeat=4)]
    score = s.decay_score(C("c"), C("v"), C("d"), C("p"))
    got = sorted(values(grid, "c double, v double, d double, p double", score, s.risk_level(score)))
    order = ["low", "medium", "high", "critical"]
    assert all(0 <= x <= 100 for x, _ in got)
    ranks = [order.index(level) for _, level in got]
    assert ranks == sorted(ranks)
