import pytest

from kinspot.operators import evaluate as ev
from kinspot.sources.tables import read_labelled, label_counts, write_metrics

# confusion counts (tp, tn, fp, fn) and the metrics published for them
PUBLISHED = {
    "embedding": ((0, 31, 0, 30), (0.5081967213114754, 0.0, 0.0, 0.0)),
    "direct": ((3, 28, 3, 27), (0.5081967213114754, 0.5, 0.1, 0.16666666666666666)),
    "dense": ((23, 24, 7, 7), (0.7704918032786885, 0.7666666666666667, 0.7666666666666667, 0.7666666666666667)),
    "hybrid": ((22, 27, 4, 8), (0.8032786885245902, 0.8461538461538461, 0.7333333333333333, 0.7857142857142857)),
}


@pytest.fixture(scope="module")
def predictions(spark):
    rows = []
    for method, ((tp, tn, fp, fn), _) in PUBLISHED.items():
        cases = [(1, 1)] * tp + [(0, 0)] * tn + [(0, 1)] * fp + [(1, 0)] * fn
        rows += [(method, i, y, p) for i, (y, p) in enumerate(cases)]
    return spark.createDataFrame(rows, "method string, case_id bigint, y_true int, y_pred int")


def test_published_metrics(predictions):
    counts = ev.confusion(predictions, "method")
    got = {r.method: tuple(r)[1:] for r in counts.collect()}
    assert got == {m: c for m, (c, _) in PUBLISHED.items()}
    exact = {r.method: tuple(r)[1:] for r in ev.metrics_of(counts, "method", digits=None).collect()}
    for method, (_, values) in PUBLISHED.items():
        assert exact[method] == pytest.approx(values, abs=1e-12)


def test_no_predictions_give_zero_not_an_error(spark, predictions):
    assert ev.metrics(predictions.where("false"), "method").count() == 0
    row = ev.metrics(spark.createDataFrame([("m", 0, 0)], "method string, y_true int, y_pred int"), "method").first()
    assert tuple(row) == ("m", 1.0, 0.0, 0.0, 0.0)


def test_error_report_counts_all_and_shows_three(predictions):
    got = {(r.method, r.error_type): (r.n_cases, r.examples) for r in ev.error_report(predictions).collect()}
    assert got["dense", "FP"] == (7, [47, 48, 49]) and got["dense", "FN"] == (7, [54, 55, 56])
    assert ("embedding", "FP") not in got
    assert ev.error_cases(predictions, "FN").count() == 30 + 27 + 7 + 8


def test_pivot_and_ranking(predictions):
    scores = ev.metrics(predictions, "method")
    pivot = {r.metric: r for r in ev.metrics_by_method(scores, sorted(PUBLISHED)).collect()}
    assert pivot["f1"].hybrid == pytest.approx(0.785714)
    position = {(r.metric, r.method): r.position for r in ev.rank_methods(scores).collect()}
    assert position["accuracy", "hybrid"] == 1 and position["accuracy", "embedding"] == position["accuracy", "direct"] == 3


def test_failed_cases_predict_zero_and_cost_no_time(spark):
    cases = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1)], "case_id bigint, y_true int")
    verdicts = spark.createDataFrame(
        [(1, True, None, 0.7, 2.0, None), (2, True, 0.9, None, 9.0, "missing field"), (3, None, None, None, 4.0, None)],
        "query_id bigint, is_match boolean, confidence double, max_similarity double, elapsed double, error string",
    )
    got = ev.predict(cases, verdicts, "m")
    rows = {r.case_id: (r.y_pred, r.confidence, r.elapsed, r.error) for r in got.collect()}
    assert rows == {
        1: (1, 0.7, 2.0, None), 2: (0, 0.0, None, "missing field"), 3: (0, 0.5, 4.0, None), 4: (0, 0.0, None, "no verdict"),
    }
    times = ev.timing(got, "method").first()
    assert (times.avg_time, times.total_time, times.n_errors) == (3.0, 6.0, 2)


def test_sweeps(spark):
    cases = spark.createDataFrame([(1, 1), (2, 0)], "case_id bigint, y_true int")
    judged = spark.createDataFrame(
        [(1, 1, 0.1), (1, 4, 0.9), (2, 9, 0.9)], "query_id bigint, rank int, containment double"
    )
    got = {r.k: r.accuracy for r in ev.sweep_k(judged, cases, 0.8).collect()}
    assert got == {3: 0.5, 5: 1.0, 10: 0.5}
    best = spark.createDataFrame([(1, 0.85)], "query_id bigint, max_similarity double")
    got = {r.threshold: r.recall for r in ev.sweep_threshold(best, cases).collect()}
    assert got == {0.7: 1.0, 0.8: 1.0, 0.9: 0.0}


def test_metrics_csv_and_labelled_array_file(spark, predictions, tmp_path):
    path = str(tmp_path / "metrics")
    write_metrics(ev.metrics(predictions, "method"), path)
    assert spark.read.option("header", True).csv(path).columns == ["method", *ev.METRICS]
    array = tmp_path / "set.json"
    array.write_text('[\n {"code": "a\\nb", "label": 1, "ast_similarity": 0.9},\n {"code": "c", "label": 0}\n]')
    cases = read_labelled(spark, str(array), array_file=True)
    assert tuple(label_counts(cases).first()) == (2, 1, 1)
    assert cases.where("label = 0").first().ast_similarity is None
