import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import mixing, neighbours, overlap, records, spam, splits, tokens


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def test_copies(spark):
    rows = [
        (5, "int A = { .x = f(1, 2), .y = { .p = 1, .q = \"a,}\" } };"),
        (3, "INT a={.y={.q=\"A,}\",.p=1,},.x=f(1,2)}"),
        (7, "int a = { f(1, 2), 1 };"),
        (8, None),
        (9, " ;; "),
        (10, ""),
        (1, "x" * 50_000),
        (2, "X " * 50_000),
        (2, "X " * 50_000),
        (11, "{ .a = 1"),
        (12, "a1"),
    ]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "row_id long, code string, _root int, row_id_first int")
    assert rows_of(records.copies(df, "row_id", "code")) == {(3, 5), (1, 2), (11, 12)}
    assert rows_of(records.copies(df.limit(0), "row_id", "code")) == set()


def test_trees_of_any_depth_and_without_an_end():
    deep = "{ .a = " * 10_000 + "1" + ", .b = 2 }" * 10_000
    assert records.tree(deep) == records.tree(deep.upper().replace(" ", "\n")) and len(records.tree(deep)[1]) > 30_000
    assert records.tree("{ .a = 1, " * 100_000)[1] == b"a1" * 100_000
    nested = "x = { .q = { .m = 1, .k = 2 }, .p = f(1, 2) };"
    assert records.tree(nested) == records.tree("X={.p=f(1,2),.q={.k=2,.m=1,}}") != records.tree("x = { .q = { .m = 2, .k = 1 }, .p = f(1, 2) };")
    for hostile in ("{ .a = 1, " + '"' + '\\"' * 50_000, "{ .a = 1, " + "/*" * 50_000, "{" + "." * 100_000, "{._" + "_" * 100_000, "{ .a = 1, “" * 20_000):
        assert records.tree(hostile)[1] == records.leaf(hostile)


def test_copies_in_one_hot_group(spark):
    df = spark.range(6000).selectExpr("id as row_id", "if(id % 10 < 9, concat('Hot ', repeat(' ', int(id % 7)), '1;'), concat('t', int(id / 20))) as code")
    found = records.copies(df, "row_id", "code")
    assert found.where("row_id_first = 0").count() == 5399 and found.count() == 5399 + 300


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[j - 1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_overlap_matches_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for n in range(120):
        base = [rng.choice(words) for _ in range(rng.choice([1, 4, 5, 9, 10, 11, 19, 20, 40, 90]))]
        other = list(base)
        for _ in range(rng.randint(0, max(1, len(base) // 8))):
            k = rng.randrange(len(other) + 1)
            rng.choice([lambda: other.insert(k, "new"), lambda: other.__delitem__(slice(k, k + 1)), lambda: other.__setitem__(slice(k, k + 1), ["set"])])()
        rows += [(f"t{n}", " Train\t", base), (f"e{n}", rng.choice(["VAL", "valid", "test"]), other)]
    rows += [("n", None, rows[0][2]), (None, "test", rows[0][2])]
    df = spark.createDataFrame([(i, s, " ".join(w), "x") for i, s, w in rows] + [("t0", "train", " ".join(rows[0][2]), "y")], "record_id string, split string, code string, cls string")
    members = overlap.classes(df, "record_id", "code", "split")
    train, others = ([(i, w) for i, s, w in rows if i and w and s and (s == " Train\t") == t] for t in (True, False))
    expected = {tuple(sorted((a, b))) for a, x in train for b, y in others if "".join(x) == "".join(y) or edit(x, y) * 10 <= max(len(x), len(y))}
    assert rows_of(overlap.record_pairs(members, overlap.class_links(members))) == expected
    assert overlap.overlap_report(members, overlap.class_links(members), ()).first().n_overlapping == len({p for pair in expected for p in pair if p[0] == "e"})


@pytest.mark.parametrize("copies", [0, 40])
def test_nearest(spark, copies):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 64))
    x = (centres[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 64))).astype(np.float32)
    if copies:
        x[:copies] = x[0]
    rows = [(f"r{i:05}", v.tolist(), 0.0) for i, v in enumerate(x)] + [("bad1", None, 0.0), ("bad2", [0.0] * 64, 0.0), ("bad3", [1.0] * 63, 0.0), ("bad4", [float("nan")] * 64, 0.0), ("bad5", [None] * 64, 0.0)]
    found = neighbours.nearest(spark.createDataFrame(rows, "record_id string, e array<float>, cosine double"), "record_id", "e").collect()
    assert len(found) == 1500 * 5 and not any("bad" in r.id + r.neighbour or r.id == r.neighbour for r in found)
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    fifth = np.sort(s, axis=1)[:, -5]
    good = sum(s[int(r.id[1:]), int(r.neighbour[1:])] >= fifth[int(r.id[1:])] - 1e-6 for r in found)
    assert good / len(found) > 0.95


@pytest.mark.parametrize("kind", ["gauss", "low rank", "clusters"])
def test_recall_off_the_planted_data(spark, kind):
    rng = np.random.default_rng(1)
    n = 4000
    x = {"gauss": lambda: rng.normal(size=(n, 64)), "low rank": lambda: rng.normal(size=(n, 8)) @ rng.normal(size=(8, 64)) + 0.1 * rng.normal(size=(n, 64)), "clusters": lambda: rng.normal(size=(40, 64))[rng.integers(0, 40, n)] + 0.3 * rng.normal(size=(n, 64))}[kind]()
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x.astype(np.float32))], "record_id string, e array<float>")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    true = {(i, j) for i, row in enumerate(np.argpartition(-s, 4, axis=1)[:, :5]) for j in row}
    found = {(int(r.id), int(r.neighbour)) for r in neighbours.nearest(df, "record_id", "e").collect()}
    assert len(found & true) / len(true) >= 0.95
    few = df.limit(600)
    exact = {(int(r.id), int(r.neighbour)) for r in neighbours.nearest(few, "record_id", "e", settings=neighbours.Settings(exact=True)).collect()}
    ids = sorted({i for i, _ in exact})
    part = s[np.ix_(ids, ids)]
    assert exact == {(ids[i], ids[j]) for i, row in enumerate(np.argpartition(-part, 4, axis=1)[:, :5]) for j in row}


def test_broadcast_index_needs_no_package_on_workers():
    import pickle
    import sys

    x = np.random.default_rng(0).normal(size=(200, 64)).astype(np.float32)
    index = tuple(neighbours.fit(neighbours._unit(x), 200, 5, neighbours.Settings()))
    assert not any(type(part).__module__.startswith("faultline") for part in index) and b"faultline" not in pickle.dumps(index) and sys.modules["faultline"]


def test_nearest_of_nothing(spark):
    assert neighbours.nearest(spark.createDataFrame([], "record_id string, e array<float>"), "record_id", "e").count() == 0


def test_nearest_among_copies_of_few_vectors(spark):
    few = neighbours.Settings(sample=64)  # as with millions of rows
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((8, 64)))], "g long, e array<float>")
    df = spark.range(20_000).withColumn("g", F.col("id") % 8).join(F.broadcast(vectors), "g").select(F.col("id").cast("string").alias("record_id"), "e", "g")
    for some in (df, df.where("g = 3")):
        found = neighbours.nearest(some, "record_id", "e", settings=few).groupBy("id").agg(F.count("*").alias("n"), F.min("cosine").alias("least"))
        assert found.where("n = 5 and least > 0.999").count() == some.count()


def test_forest_and_splits(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 3.0), ("x", "y", 1.0), ("z", "z", 1.0), (None, "a", 0.0), ("a", "b", 1.0)]
    labels, forest = splits.spanning_forest(spark.createDataFrame(edges, "a string, b string, weight double"))
    groups = {}
    for node, root in rows_of(labels):
        groups.setdefault(root, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [["a", "b", "c"], ["x", "y"], ["z"]]
    assert rows_of(forest) == {("a", "b", 1.0), ("b", "c", 2.0), ("x", "y", 1.0)}
    rows = [(i, f"r{i}", ["Proj-1", "proj_1", "PROJ 1"][i % 3] if i % 2 else (None if i % 4 else f"p{i % 60}"), i % 5 == 0) for i in range(6000)]
    df = spark.createDataFrame([(a, b, c, int(d), "old") for a, b, c, d in rows], "row_id long, record_id string, project string, label int, split_name string")
    targets = spark.createDataFrame([("train", 0.8), ("val", 0.1), ("test", 0.1)], "split_name string, share double")
    got = splits.assign_splits(df, targets, "project", "label", ["record_id"]).collect()
    assert len(got) == 6000 and all(r.split_name for r in got)
    assert len({r.split_name for r in got if r.project and r.project.lower().startswith("proj")}) == 1
    shares = {s: sum(r.split_name == s for r in got) / 6000 for s in ("train", "val", "test")}
    assert abs(shares["train"] - 0.8) < 0.02 and abs(shares["val"] - 0.1) < 0.02
    assert rows_of(splits.spelling_pairs(df.limit(60), "project")) == {("PROJ 1", "Proj-1"), ("PROJ 1", "proj_1"), ("Proj-1", "proj_1")}


def test_tokens(spark):
    tiktoken = pytest.importorskip("tiktoken")
    rng = random.Random(2)
    texts = ["", None, "   ", "<|endoftext|> it's", "  x  y\n\n\n z", "在函数 🇺🇳 naïve ﬁＡＢ", "9" * 700, "9a" * 4000, "".join(rng.choice(string.printable) for _ in range(3000)), "abcXYZ" * 200, "á​"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "null id")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id int, text string, ids int")
    import public_tokenizers as P

    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tokens.ranks(), special_tokens={})
    got = tokens.encode(df, "doc_id", "text")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids) for r in got.collect()) == sorted((i is None, i or 0, known.encode_ordinary(t or "")) for i, t in rows)
    back = {(r.doc_id, r.text) for r in tokens.decode(got, "ids").select("doc_id", "text").collect()}
    assert back == {(i, t or "") for i, t in rows}
    counted = tokens.token_counts(df.withColumn("again", F.col("text")), "text").collect()
    assert len(counted) == len(rows) and all(r.n_tokens == len(known.encode_ordinary(r.again or "")) for r in counted)


def test_mix(spark):
    docs = [(i, "big", 50 + i % 40) for i in range(900)] + [(2000 + i, "small", 60) for i in range(20)] + [(3000 + i, "other", 10) for i in range(10)] + [(4000, "big", None), (4001, None, 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n long")
    targets = spark.createDataFrame([("big", 0.7, 2), ("small", 0.06, 4), ("gone", 0.04, 3), ("none", 0.0, 2)], "source string, target_share double, max_uses int")
    plan = {r.source: r for r in mixing.allocation(df, targets).collect()}
    assert {s for s, r in plan.items() if not r.reachable} == {"gone"}
    uses, report = mixing.mix(df, targets)
    total = sum(n for _, s, n in docs if s in ("big", "small") and n)
    got = {r.source: r for r in report.collect()}
    assert abs(got["big"].tokens - 0.7 * total) <= 45 and abs(got["small"].tokens - 0.06 * total) <= 30 and got["gone"].tokens == 0
    assert all(r.uses <= {"big": 2, "small": 4}[r.source] for r in uses.collect())


def test_spam(spark):
    prose = "The reviewer asked whether the pointer may be null when the queue is empty, and nobody answered. I read the loop line by line and still can't see how it could overrun the buffer on item {i}."
    rows = [(i, prose.format(i=i) + " " + prose.format(i=i * 7)) for i in range(60)]
    rows += [(100 + i, f"cheap deal laptop{i} | " * 30) for i in range(8)] + [(200 + i, " ".join(f"https://www.a{k}.example/x{i}" for k in range(30))) for i in range(8)]
    rows += [(300 + i, "\n".join(f"SKU:B{k}5550 best hosting {i} €748.52" for k in range(20))) for i in range(8)] + [(400, None), (401, ""), (402, "9" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id for r in spam.spam_pages(df, "doc_id", "text").where("score >= 0.5").collect()}
    assert found == {i for i, _ in rows if 100 <= i < 400}
    assert spam.spam_pages(df.limit(0), "doc_id", "text").count() == 0


def test_spam_in_damaged_encoding(spark):
    keywords = {0: "купить дешёвый ноутбук, ", 1: "günstige Prüfgeräte kaufen | ", 2: "安い 無料 監査, ", 3: "promoções grátis nação, ", 4: "vé rẻ hà nội đặt sớm, "}
    rows = [(i, text * 30) for i, text in keywords.items()]
    rows += [(10 + i, t.encode().decode("cp1252", "replace")) for i, t in rows] + [(20 + i, t.encode().decode("latin-1")) for i, t in rows] + [(30 + i, t.encode().decode("latin-1").encode().decode("latin-1")) for i, t in rows]
    prose = "Der Prüfer bestätigt den Absturz auf dem Fehlerpfad, denn die Summe läuft über. Unser Testlauf fände ein Leck, sobald zwei Fäden gleichzeitig über die Größe schreiben."
    rows += [(50, prose), (51, prose.encode().decode("cp1252", "replace")), (52, "«Spaß“ – l'été… ação, PERÚ”")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    share = {r.doc_id: r.run_share for r in spam.page_features(df, "text").collect()}
    assert {i for i, s in share.items() if s > 0.9} == {i for i, _ in rows if i < 50} and share[50] == share[51] <= 0.5
    back = {r.doc_id: r.t for r in df.select("doc_id", spam.repaired(F.col("text")).alias("t")).collect()}
    assert all(back[20 + i] == back[30 + i] == back[i] == t for i, t in rows if i < 5) and back[51] == prose and back[52] == rows[-1][1]


def test_spam_of_longer_pieces_and_mixed_runs(spark):
    names = [a + b for a in ("lap", "desk", "mug", "cam", "sof", "phon") for b in ("ora", "ino", "eta", "uli", "axa", "oby", "ick")]
    prose = "The reviewer asked whether the pointer may be null when the queue is empty, and nobody answered. I read the loop line by line and still can't see how it could overrun the buffer. "
    rows = [
        (1, "cheap fast online price audit tool\n" * 60),
        (2, "\n".join(" ".join(names[(i * 5 + k * (i + 1)) % 42] for k in range(9)) for i in range(40))),
        (3, "official cheap policy backup lumi-vox\n" * 40),
        (4, "best price of the audit tool today\n" * 20),
        (5, prose * 2 + "\n" + "cheap laptop | fast mug, " * 11 + "\n" + " ".join(names)),
        (6, "[cheap laptop](https://a.example/x)\n[fast mug](https://b.example/y)\n[new hosting](https://c.example/z)"),
        (11, prose * 5),
        (12, "\n".join(f"The {w} asked whether the pointer may be null when the queue is empty" for w in names)),
        (13, "9" * 3000),
        (14, "\n".join(f"Читатель {w} сообщает о переполнении в функции, так как сумма велика" for w in names)),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    share = {r.doc_id: r.run_share for r in spam.page_features(df, "text").collect()}
    assert all(share[i] > 0.5 for i in range(1, 7)) and all(share[i] <= 0.5 for i in range(11, 15)) and max(share.values()) <= 1


def test_spam_of_one_class(spark):
    prose = "The reviewer asked whether the pointer may be null when the queue is empty, and nobody answered. "
    rows = [(1, "cheap laptop | fast mug | " * 6 + "\n" + prose), (2, "cheap laptop | fast mug"), (3, prose + "I read the loop line by line and still can't see how it could overrun the buffer.")]
    for ids in ((1,), (1, 2), (1, 3), (2, 3), (1, 2, 3)):
        df = spark.createDataFrame([r for r in rows if r[0] in ids], "doc_id long, text string")
        assert {r.doc_id for r in spam.spam_pages(df, "doc_id", "text").where("score >= 0.5").collect()} == {i for i in ids if i < 3}


def test_unreachable_sources_come_from_the_mix(spark, monkeypatch):
    from faultline.llm import tables

    docs = spark.createDataFrame([(i, s, 10) for i, s in enumerate(["a"] * 9 + ["b"])], "doc_id long, source string, n long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.5, 1)], "source string, target_share double, max_uses int")
    mixed = []
    mix = mixing.mix
    monkeypatch.setattr(tables, "_sized", lambda s, d: docs)
    monkeypatch.setattr(tables, "table", lambda s, d, name: targets)
    monkeypatch.setattr(mixing, "mix", lambda *a: mixed.append(1) or mix(*a))
    assert rows_of(tables.p7_found(spark, "")) == {("b",)} and mixed


def test_containment_of_linked_classes(spark):
    words = [f"w{i}" for i in range(40)]
    other = [*words[:20], "new", *words[21:]]
    rows = [("t1", "train", words), ("t2", "train", words), ("e1", "val", words), ("e2", "test", other), ("e3", "test", ["x"] * 9)]
    df = spark.createDataFrame([(i, s, " ".join(w)) for i, s, w in rows], "record_id string, split string, code string")
    members = overlap.classes(df, "record_id", "code", "split")
    got = {(r.record_id_train, r.record_id_eval): (r.n_train, r.n_eval, r.distance, r.containment) for r in overlap.containments(members, overlap.class_links(members)).collect()}
    assert got == {("t1", "e1"): (2, 1, 0, 1.0), ("t1", "e2"): (2, 1, 1, round(31 / 36, 6))}


def test_splits_with_a_hot_project_and_many_names(spark):
    df = spark.range(5000).selectExpr("id as row_id", "concat('r', id) as record_id", "if(id % 10 < 4, 'Hot', if(id % 10 < 8, null, concat('p', id % 900))) as project", "int(id % 7 = 0) as label")
    targets = spark.createDataFrame([("train", 0.7)] + [(f"s{i}", 0.3 / 30) for i in range(30)], "split_name string, share double")
    got = splits.assign_splits(df, targets, "project", "label", ["record_id"])
    rows = got.collect()
    assert len(rows) == 5000 and all(r.split_name for r in rows) and got.columns == [*df.columns, "split_name"]
    assert len({r.split_name for r in rows if r.project == "Hot"}) == 1 and len({r.split_name for r in rows}) > 20
