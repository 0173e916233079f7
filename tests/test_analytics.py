"""The 21 demo trials with their expected analytics."""

import pytest

from granary.operators import analytics as H
from granary.operators.evaluation import best_per_model, param_grid, running_best
from granary.operators.relations import lookup_speed
from granary.sinks.reports import report_lines

DEMO = {
    "Logistic Regression": (
        ("C", "max_iter"),
        [((0.1, 1000), 0.75), ((1.0, 1000), 0.82), ((10.0, 2000), 0.78),
         ((0.1, 2000), 0.79), ((1.0, 2000), 0.84), ((10.0, 1000), 0.76)],
    ),
    "Naive Bayes": (("var_smoothing",), [((1e-9,), 0.70), ((1e-8,), 0.73), ((1e-7,), 0.71)]),
    "Decision Tree": (
        ("max_depth", "min_samples_split"),
        [((10, 5), 0.70), ((15, 5), 0.79), ((20, 5), 0.77), ((10, 10), 0.72), ((15, 10), 0.80), ((20, 10), 0.78)],
    ),
    "Random Forest": (
        ("n_estimators", "max_depth"),
        [((50, 15), 0.81), ((100, 15), 0.85), ((200, 15), 0.83), ((50, 20), 0.82), ((100, 20), 0.86), ((200, 20), 0.84)],
    ),
}


@pytest.fixture(scope="module")
def trials(spark):
    rows = [
        (m, model, i, {n: str(v) for n, v in zip(names, values)}, f1)
        for m, (model, (names, results)) in enumerate(DEMO.items(), 1)
        for i, (values, f1) in enumerate(results, 1)
    ]
    return spark.createDataFrame(
        rows, "model_idx int, model string, combo_idx int, params map<string,string>, f1 double"
    )


def by_model(df, column):
    return {r["model"]: r[column] for r in df.collect()}


def test_best_and_mean(trials):
    best = best_per_model(trials)
    assert by_model(best, "combo_idx") == {
        "Logistic Regression": 5, "Naive Bayes": 2, "Decision Tree": 5, "Random Forest": 5,
    }
    assert set(round(v, 6) for v in by_model(H.compare_models(best), "mean_f1").values()) == {0.8075}


def test_profile(trials):
    got = {r["model"]: r for r in H.model_profile(best_per_model(trials), trials).collect()}
    expected = {
        "Logistic Regression": (0.959971, 0.75, 0.9),
        "Naive Bayes": (0.982516, 0.875, 1.0),
        "Decision Tree": (0.951357, 0.75, 0.7),
        "Random Forest": (0.979547, 0.75, 0.5),
    }
    for model, values in expected.items():
        r = got[model]
        assert (r["stability"], r["simplicity"], r["speed"]) == pytest.approx(values, abs=1e-6)


def test_sensitivity(trials):
    got = {(r["model"], r["param"]): (round(r["sensitivity"], 6), r["tier"]) for r in H.param_sensitivity(trials).collect()}
    assert got == {
        ("Logistic Regression", "C"): (0.028284, "medium"),
        ("Logistic Regression", "max_iter"): (0.013333, "low"),
        ("Naive Bayes", "var_smoothing"): (0.012472, "low"),
        ("Decision Tree", "max_depth"): (0.036286, "medium"),
        ("Decision Tree", "min_samples_split"): (0.006667, "low"),
        ("Random Forest", "n_estimators"): (0.016330, "low"),
        ("Random Forest", "max_depth"): (0.005000, "low"),
    }
    last = {r["param"]: round(r["sensitivity"], 6) for r in H.param_sensitivity(trials, last_model_wins=True).collect()}
    assert last["max_depth"] == 0.005 and len(last) == 6


def test_ranking_and_summary(trials):
    places = {r["place"]: r["model"] for r in H.rank_configs(best_per_model(trials)).collect()}
    assert places == {1: "Random Forest", 2: "Logistic Regression", 3: "Decision Tree", 4: "Naive Bayes"}
    assert tuple(H.results_summary(trials).first()) == (4, 21, 0.86)


def test_progression_and_running_best(trials):
    rows = H.score_progression(trials).where("model = 'Logistic Regression'").orderBy("position").collect()
    assert [r["is_best"] for r in rows] == [False, False, False, False, True, False]
    run = running_best(trials).where("model = 'Decision Tree'").orderBy("combo_idx").collect()
    assert [r["best_so_far"] for r in run] == [0.70, 0.79, 0.79, 0.79, 0.80, 0.80]


def test_first_best_wins_and_zero_scores_have_none(spark):
    rows = [("m", 1, {}, 0.5), ("m", 2, {"a": "1"}, 0.7), ("m", 3, {}, 0.7), ("z", 1, {}, 0.0)]
    df = spark.createDataFrame(rows, "model string, combo_idx int, params map<string,string>, f1 double")
    got = {r["model"]: (r["combo_idx"], r["f1_score"]) for r in best_per_model(df).collect()}
    assert got == {"m": (2, 0.7), "z": (None, 0.0)}


def test_grid_has_sixty_combinations(spark):
    grid = param_grid(spark.createDataFrame([("e",)], "experiment_id string"))
    assert {r["model"]: r["count"] for r in grid.groupBy("model").count().collect()} == {
        "Logistic Regression": 6, "Naive Bayes": 3, "Decision Tree": 27, "Random Forest": 24,
    }


def test_unknown_model_speed(spark):
    df = spark.createDataFrame([("SVM",)], "model string")
    assert lookup_speed(df).first()["speed"] == 0.5
    table = spark.createDataFrame([("SVM", 0.2)], "model string, speed double")
    assert lookup_speed(df, table).first()["speed"] == 0.2


def test_report_line(trials):
    line = by_model(report_lines(best_per_model(trials)), "line")["Naive Bayes"]
    assert line == f"{'Naive Bayes':<25} F1:{0.73:>7.4f}"
