import pytest

from loglattice.plans.detection import DetectionPlan, evaluate, labelled_rows, run, train
from loglattice.sources import logs

LINE = (
    '{d:02d}/Oct/2017:00:{m:02d}:{s:02d} +0000 {rt} 10.0.0.{c} 51000 TCP_MISS/{code} {size} GET '
    'http://example.com/{page} 93.184.216.34 - DEFAULT_PARENT/example.com text/html "-" "ua"'
)


@pytest.fixture(scope="module")
def plane(spark):
    lines = []
    for i in range(240):
        big = i % 3 == 0 or i > 230
        lines.append(LINE.format(d=1, m=i // 60, s=i % 60, rt=i % 7, c=i % 4, code=200 if big else 404,
                                 size=9000 if big else 10, page="a.html" if big else "b.js"))
    df = spark.createDataFrame(list(enumerate(lines)), "row_id long, value string")
    return logs.parse_lines(df).persist()


BASE = dict(
    features=("size_of_reply", "status_to_client", "file_type"), numeric=("size_of_reply",), clusters=2,
    mode="chunk", feature_options={"jittered": False},
)


@pytest.mark.parametrize("clusterer", ["kmeans", "gmm", "dbscan"])
def test_clusterers_separate_the_planted_groups(plane, clusterer):
    rows, _ = labelled_rows(plane, DetectionPlan(**BASE, clusterer=clusterer))
    assert rows.count() == 240
    assert rows.join(plane.select("row_id", "status_to_client"), "row_id").select("label", "status_to_client").distinct().count() == 2


@pytest.mark.parametrize(
    "detector,options,per_sequence",
    [("markov", {}, 2), ("session", {"l": 3}, 20), ("lcs", {}, 2), ("ngram", {}, 2), ("directional", {"kappa": 50.0}, 1),
     ("frequency", {}, 1)],
)
def test_detectors_flag_every_sequence(plane, detector, options, per_sequence):
    if detector == "frequency":
        options = {"clusters": 2}
    plan = DetectionPlan(**BASE, detector=detector, eps=(0.5, 1.5), detector_options=options)
    assert run(plane, plan).count() == 24 * per_sequence


@pytest.mark.parametrize("detector,options", [("markov", {}), ("session", {"l": 3}), ("directional", {"kappa": 50.0})])
def test_what_one_log_teaches_labels_another(plane, detector, options):
    plan = DetectionPlan(**BASE, detector=detector, eps=(0.5,), detector_options=options)
    taught = train(plane, plan)
    again = run(plane.where("row_id < 120"), plan, trained=taught)
    assert again.count() == 12 * (10 if detector == "session" else 1)


def test_flags_against_known_labels(spark, plane):
    flags = run(plane, DetectionPlan(**BASE, detector="markov", eps=(0.5, 5.0)))
    truth = flags.where("eps = 0.5").selectExpr("seq_id", "cast(is_anomaly as int) AS label")
    quality = {r.eps: r for r in evaluate(flags, truth).collect()}
    assert set(quality) == {0.5, 5.0} and quality[0.5].fp == quality[0.5].fn == 0
