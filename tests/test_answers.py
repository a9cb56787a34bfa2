import json
import math
import re

import numpy as np
from pyspark.sql import functions as F

from faultline.operators import calibration, responses
from faultline.plans.records import _CASES


def first_object(text):
    """Brute force: every brace, the longest value it starts."""
    text = (text or "").strip()
    m = re.search(r"FINAL_JSON:\s*(\{.*\})", text, re.I | re.S)
    for candidate in ([m.group(1)] if m else []) + [text]:
        for b in re.finditer(r"\{", candidate):
            try:
                value, _ = json.JSONDecoder().raw_decode(candidate[b.start() :])
            except ValueError:
                continue
            if {"label", "confidence", "reason"} <= set(value):
                return value
    return None


def test_answers(spark):
    df = spark.createDataFrame(list(_CASES), "case int, answer string")
    got = {r.case: r for r in df.select("case", responses.payload(F.coalesce("answer", F.lit(""))).alias("object"), responses.parse(F.col("answer")).alias("r"), responses.parse(F.col("answer"), strict=True).alias("s")).collect()}
    for case, answer in _CASES:
        expected = first_object(answer)
        assert (got[case].object is None) == (expected is None) and (expected is None or set(got[case].object) == set(expected)), case
    read = {c: (g.r.label, g.r.confidence, g.r.error) for c, g in got.items()}
    assert read[1] == (1, 0.9, None) and list(got[1].r.vulnerable_lines) == ["3-5", "9"]
    assert read[2] == (0, 1.0, None) and list(got[2].r.vulnerable_lines) == ["4"] and got[2].s.error == "confidence out of range"
    assert read[3][2] == "invalid confidence" and read[4][2] == "missing reason" and read[8][2] == "invalid label"
    assert read[5] == (0, 0.75, None) and read[6] == (0, 0.5, None) and got[6].r.reason == "length is checked first"
    assert all(read[c][2] == "no label" for c in (7, 9, 11)) and read[10] == (0, 0.0, None)


def test_evidence_and_failures(spark):
    rows = [(1, ["3"], "memcpy", None, 1), (1, [], "memcpy", "x", 0), (1, ["3"], " ", "", 0), (0, [], None, None, 0), (1, None, "a", "b", 0)]
    df = spark.createDataFrame(rows, "label int, lines array<string>, sink string, guard string, expected int")
    label, _ = responses.verified(F.col("label"), F.col("lines"), F.col("sink"), F.col("guard"))
    assert all(r.z == r.expected for r in df.select("expected", label.alias("z")).collect())
    kinds = spark.createDataFrame([("No module named torch",), ("CUDA out of memory",), ("file not found",), ("?",)], "m string").select(responses.failure_kind(F.col("m"))).collect()
    assert [r[0] for r in kinds] == ["missing_dependencies", "out_of_memory", "model_missing", "other"]


def logistic(x, y, steps=200):
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + penalty, x.T @ (q - y) + penalty @ w)
    return w


def pool(p, y):
    """Brute force isotonic regression: merge neighbours that fall."""
    blocks = []
    for a in sorted(set(p)):
        own = [b for q, b in zip(p, y) if q == a]
        blocks.append([sum(own), len(own), [a]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, a_ = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + a_]
    return {a: s / n for s, n, xs in blocks for a in xs}


def test_calibrators(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.beta(2, 3, 400), 2).clip(0.01, 0.99)
    y = (rng.random(400) < p**1.5).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)] + [(None, 1), (float("nan"), 1), (0.5, None)], "p double, y int")
    scores = calibration.distinct_scores(df, "p", "y")
    platt = calibration.fit(scores, "platt")["parameters"]
    assert np.allclose([platt["coef"], platt["intercept"]], logistic(np.log(p / (1 - p))[:, None], y), atol=1e-6)
    beta = calibration.fit(scores, "beta")["parameters"]
    assert np.allclose(list(beta.values()), logistic(np.c_[np.log(p), np.log1p(-p)], y), atol=1e-6)
    isotonic = calibration.fit(scores, "isotonic")
    expected = pool(list(p), list(y))
    got = {r.p: r.q for r in df.where("p is not null and not isnan(p)").select("p", calibration.apply(F.col("p"), isotonic).alias("q")).collect()}
    assert all(abs(got[a] - expected[a]) < 1e-9 for a in expected)
    best = calibration.choose(scores)
    assert best["candidate_metrics"][best["method"]]["nll"] == min(m["nll"] for m in best["candidate_metrics"].values())
    for method in calibration.METHODS:
        one = calibration.fit(scores.where("y = 1"), method)  # one class
        q = spark.createDataFrame([(0.3,), (None,)], "p double").select(calibration.apply(F.col("p"), one).alias("q")).collect()
        expected_one = 0.3 / 1.3 if method == "beta" else 0.3  # beta's identity has the weights 1 and 0
        assert abs(q[0].q - expected_one) < 1e-9 and q[1].q is None, method
    assert calibration.quality(scores.limit(0), F.col("p")) == {"nll": 0.0, "ece": 0.0, "brier": 0.0}


def test_mcnemar():
    for a, b in ((0, 0), (3, 3), (1, 8), (10, 4), (0, 20)):
        n = a + b
        assert abs(calibration.mcnemar_p(a, b) - (min(1.0, 2 * sum(math.comb(n, i) for i in range(min(a, b) + 1)) / 2**n) if n else 1.0)) < 1e-9
