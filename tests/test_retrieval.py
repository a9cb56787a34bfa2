import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from faultline.operators import retrieval
from faultline.plans.retrieval import q_tfidf_scores


def best(queries, bank, k):
    """The same, pair by pair."""
    terms = lambda t: Counter(t + [f"{a} {b}" for a, b in zip(t, t[1:])])
    queries, bank = ({i: terms(t) for i, t in docs} for docs in (queries, bank))
    df = Counter(t for d in bank.values() for t in d)
    idf = {t: math.log((1 + len(bank)) / (1 + n)) + 1 for t, n in df.items() if n >= 2}

    def unit(d):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in d.items() if t in idf}
        length = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / length for t, x in w.items()}

    bank, rows = {i: unit(d) for i, d in bank.items()}, []
    for q, d in queries.items():
        w = unit(d)
        scored = sorted((-round(sum(x * b[t] for t, x in w.items() if t in b), 9), i) for i, b in bank.items() if w.keys() & b.keys())
        rows += [(q, i, n, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return rows


def documents(seed, n, words):
    rng = np.random.default_rng(seed)
    return [[f"t{x}" for x in rng.zipf(1.5, rng.integers(0, 25)) if x < words] for _ in range(n)]


def same(got, expected):
    assert [r[:3] for r in got] == [r[:3] for r in expected] and all(abs(a[3] - b[3]) < 2e-9 for a, b in zip(got, expected))


def test_tfidf_in_parts(spark, monkeypatch):
    demos = documents(0, 40, 60)
    bank = [(f"d{i:03}", t) for i, t in enumerate(demos + demos[:20] + [[], ["only"]])]  # copies tie
    queries = list(enumerate(documents(1, 60, 80) + demos[:5] + [[], ["unknown"], ["unknown"] * 3 + ["t1"]]))
    q, b = spark.createDataFrame(queries, "id bigint, tokens array<string>"), spark.createDataFrame(bank, "id string, tokens array<string>").repartition(3)
    run = lambda: [(r["query"], r.record_id, r["rank"], r.score) for r in retrieval.tfidf_best(q, b, 5).orderBy("query", "rank").collect()]
    expected = best(queries, bank, 5)
    same(run(), expected)
    for postings in (60, 500):
        monkeypatch.setattr(retrieval, "POSTINGS", postings)
        same(run(), expected)
    assert retrieval.tfidf_best(q, b.where("id = 'd000'"), 5).collect() == []  # no term stands in two documents


def test_tfidf_scores_write_no_pairs(spark, tmp_path):
    n = 700
    texts = [" ".join(["x", *t]) for t in documents(2, 2 * n, 200)]  # all share a term
    rows = spark.createDataFrame([(20 * i, f"r{i:05}", texts[i], i % 2) for i in range(2 * n)], "row_id bigint, record_id string, text string, label int")
    rows.where(f"row_id < {20 * n}").withColumnRenamed("text", "code").write.parquet(str(tmp_path / "function_records.parquet"))
    rows.where(f"row_id >= {20 * n}").withColumnRenamed("text", "tokenized_text").write.parquet(str(tmp_path / "demo_bank.parquet"))
    rows.select("record_id", F.array_repeat(F.lit(1.0), 64).alias("semantic_embeddings")).write.parquet(str(tmp_path / "feature_store.parquet"))
    jvm = spark._jvm
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    written = lambda: (lambda s: {s.apply(i).stageId(): s.apply(i).shuffleWriteRecords() for i in range(s.size())})(stages())
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are larger than it
    try:
        got = q_tfidf_scores(spark, str(tmp_path)).orderBy("query", "rank").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sum(w for s, w in written().items() if s not in before) < 0.5 * n * n
    assert len(got) == 5 * n and len({r["query"] for r in got}) == n
