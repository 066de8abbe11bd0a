"""The query language: what it accepts, what it rejects, what it returns."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from phasegrid.operators import search as S


def f(field, op, value):
    return {"field": field, "op": op, "value": value}


ACCEPTED = [
    f("outcome", "eq", "goal"), f("competition", "in", ["Euro 2020", "Euro 2024"]), f("xg", "gte", 1),
    f("duration_s", "between", [0, 15]), f("start_type", "in", ["corner"]), f("has_360", "neq", False),
    f("team_name", "neq", "A"), f("minute", "eq", 0), f("phase_id", "in", ["1-0001"]),
]
REJECTED = [
    f("pass_completion", "gte", 0.8), f("xg", "contains", 0.5), f("start_zone", "eq", "midfield"),
    f("competition", "eq", "euro 2024"), f("competition", "neq", "Euro 2024"), f("competition", "between", ["a", "b"]),
    f("n_passes", "gte", "five"), f("duration_s", "gte", "10"), f("xg", "gte", True), f("n_passes", "eq", 8.5),
    f("counterattack", "eq", "true"), f("counterattack", "eq", 1), f("team_name", "eq", 7), f("reached_box", "gte", True),
    f("outcome", "between", ["goal", "lost_ball"]), f("duration_s", "between", [5]), f("duration_s", "between", [1, 2, 3]),
    f("duration_s", "between", 5), f("duration_s", "between", []), f("duration_s", "between", [30, 10]),
    f("outcome", "in", []), f("outcome", "in", "goal"), f("team_name", "eq", ["A"]), f("xg", "gte", float("nan")),
    {**f("xg", "gte", 0.1), "negate": True}, {"field": "xg", "op": "gte"},
]


@pytest.mark.parametrize("one", ACCEPTED)
def test_accepts(one):
    assert S.check_query({"filters": [one]})["filters"] == [one]


@pytest.mark.parametrize("one", REJECTED)
def test_rejects(one):
    with pytest.raises(S.QueryError):
        S.check_query({"filters": [one]})


@pytest.mark.parametrize(
    "query",
    [{"version": 2}, {"sql": "SELECT 1"}, {"limit": "lots"}, {"limit": True}, {"limit": 2.5},
     {"order_by": {"field": "outcome", "dir": "desc"}}, {"order_by": {"field": "xg", "dir": "descending"}},
     {"order_by": {"field": "xg", "nulls": "first"}}],
)
def test_rejects_queries(query):
    with pytest.raises(S.QueryError):
        S.check_query(query)


@pytest.mark.parametrize("given,kept", [(0, 1), (-10, 1), (1, 1), (20, 20), (96, 96), (500, 96)])
def test_limit_is_clamped(given, kept):
    assert S.check_query({"limit": given})["limit"] == kept


def test_defaults():
    assert S.check_query({}) == {"version": 1, "filters": [], "order_by": None, "limit": 48}
    assert len(S.FIELDS) == 29 and len(S.RESULT_COLUMNS) == 31 and len(S.PRESETS) == 5


@pytest.fixture(scope="module")
def phases(spark):
    rows = [
        ("1-0001", 1, "A", 0.1, 10.0, 3, True, None), ("1-0002", 1, "B", 0.1, 12.0, 9, False, "goal"),
        ("1-0003", 1, "A", 0.7, -3.0, 5, True, "goal"), ("2-0001", 2, "A", 0.0, 55.5, 2, False, "lost_ball"),
    ]
    return spark.createDataFrame(
        rows, "phase_id string, match_id long, team_name string, xg float, progression_m float, n_passes int, counterattack boolean, outcome string")


def ids(df):
    return [r["phase_id"] for r in df.collect()]


def test_results(phases):
    def run(*filters, **more):
        return ids(S.search(phases, {"filters": list(filters), **more}, ["phase_id"]))

    assert run() == ["1-0003", "1-0002", "1-0001", "2-0001"]
    assert run(f("xg", "eq", 0.1)) == ["1-0002", "1-0001"]
    assert run(f("xg", "lte", 0.1), order_by={"field": "xg", "dir": "asc"}) == ["2-0001", "1-0001", "1-0002"]
    assert run(f("outcome", "neq", "goal")) == ["2-0001"]  # a missing outcome matches nothing
    assert run(f("n_passes", "between", [3, 5]), f("counterattack", "eq", True), limit=1) == ["1-0003"]
    assert run(f("team_name", "in", ["B", "C"])) == ["1-0002"]
    assert ids(S.search(phases, {}, ["phase_id"], [F.col("match_id") == 2])) == ["2-0001"]
    assert S.count_matches(phases, {"filters": [f("counterattack", "neq", True)]}).first()["n"] == 2


def test_filters_reach_the_scan(spark, phases, tmp_path):
    path = str(tmp_path / "phases")
    phases.write.parquet(path)
    q = {"filters": [f("xg", "gte", 0.1), f("team_name", "eq", "A")], "order_by": {"field": "xg", "dir": "desc"}}
    plan = S.search(spark.read.parquet(path), q, ["phase_id"])._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(xg,0.1)" in plan and "EqualTo(team_name,A)" in plan
    assert "TakeOrderedAndProject" in plan
    assert "ReadSchema: struct<phase_id:string,team_name:string,xg:float>" in plan


def test_many_queries_in_one_scan(phases):
    df = S.search_many(phases, {"all": {"limit": 2}, "goals": {"filters": [f("outcome", "eq", "goal")]}})
    # A query that matches most of the table is cut to its limit before the shuffle.
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()
    got = df.collect()
    assert sorted((r["query"], r["rank"], r["phase_id"], r["n_matches"]) for r in got) == [
        ("all", 1, "1-0003", 4), ("all", 2, "1-0002", 4), ("goals", 1, "1-0003", 2), ("goals", 2, "1-0002", 2)]


def test_pins_and_vocabulary(spark, phases):
    pins = spark.createDataFrame(
        [("b", 1, "1-0002"), ("a", 2, "1-0003"), ("a", 1, "9-0001"), ("c", 1, "1-0003")], "section string, ordinal int, phase_id string")
    assert ids(S.pinned_phases(phases, pins, ["phase_id"])) == ["1-0003", "1-0002"]
    assert ids(S.missing_pins(phases, pins)) == ["9-0001"]
    names = S.vocabulary(phases, "team_name")
    assert [r[0] for r in names.collect()] == ["A", "B"]
    assert [r[0] for r in S.search_vocabulary(names, "team_name", " a ", ("B",)).collect()] == ["A", "B"]
    extra = phases.withColumns({"n_shots": F.lit(1), "duration_s": F.lit(2.0)})
    s = S.summarize(extra, pins).first()
    assert (s["n"], s["goals"], s["matches"], s["teams"], s["n_with_xg"]) == (2, 2, 1, 2, 2)
    empty = S.summarize(extra, pins.limit(0)).first()
    assert (empty["n"], empty["avg_xg"]) == (0, None)


def test_query_errors_agree_with_single_checks(spark):
    """The columns judge every field, operator and value as the checker of one query does."""
    from phasegrid.operators import saved as SV

    kinds = {"int": int, "float": float, "bool": lambda t: {"true": True, "false": False}[t], "enum": str, "text": str}
    values = (["12"], ["1.5"], ["true"], ["mid_third_left"], [], ["1", "5"], ["5", "1"], ["x", "y"], ["goal", "goal"])
    rows, want = [], []
    for field in [*S.FIELDS, "nothing"]:
        for op in (*S._ORDERED, "like"):
            for texts in values:
                rows.append((len(rows), [(field, op, texts)], None, None))
                try:
                    typed = [kinds[S.FIELDS[field]](t) for t in texts] if field in S.FIELDS else texts
                except (ValueError, KeyError):
                    typed = [object() for _ in texts]
                value = typed if op in ("in", "between") or len(typed) != 1 else typed[0]
                try:
                    S.check_filter({"field": field, "op": op, "value": value}, "filters[0]")
                    want.append(None)
                except S.QueryError as e:
                    want.append(e.path)
    orders = [(None, None, None), ("xg", "asc", None), ("xg", None, None), ("outcome", "asc", "order_by.field"),
              (None, "asc", "order_by.field"), ("minute", "up", "order_by.dir")]
    rows += [(len(rows) + i, [], f, d) for i, (f, d, _) in enumerate(orders)]
    want += [e for _, _, e in orders]
    df = spark.createDataFrame(rows, "query_id long, filters array<struct<field: string, op: string, values: array<string>>>, order_field string, order_dir string")
    got = [r["error"] for r in SV.query_errors(df).orderBy("query_id").collect()]
    assert [(r, g, w) for r, g, w in zip(rows, got, want) if g != w] == []
