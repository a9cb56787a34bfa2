import math
import random

from pyspark.sql import functions as F

from faultline.functions import text as X
from faultline.operators import codegraph
from faultline.operators.hot_keys import exact_quantiles, per_key_results
from faultline.workspace import join_groups


def lower_quantile(values, p):
    return sorted(values)[max(1, math.ceil(p * len(values))) - 1]


def test_quantiles_match_brute_force(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([-5.0, 1e300, rng.gauss(0, 1)]), i) for i in range(800)] + [(None, float(i % 7), i) for i in range(40)] + [("nan", float("nan"), 0), ("null", None, 1), ("one", 3.5, 2)]
    got = {r.k: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double, bin int"), "k", "x", [0, 0.5, 0.9, 1], bins=16).collect()}
    assert set(got) == {"hot", None, "one", "nan", "null"} and all(got[k].n == 0 and got[k].n_rows == 1 and got[k].quantiles is None for k in ("nan", "null"))
    for key in ("hot", None, "one"):
        own = [x for k, x, _ in rows if k == key and x is not None and x == x]
        assert got[key].n == len(own) and list(got[key].quantiles) == [lower_quantile(own, p) for p in (0, 0.5, 0.9, 1)]


def test_quantiles_of_large_integers(spark):
    rows = [("a", 2**60 + i) for i in range(50)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, x long"), "k", "x", [0.5], bins=8).first()
    assert got.quantiles == [2**60 + 24]


def test_per_key_results(spark):
    rows = [("a", 1, "h1", 5), ("a", 0, "h1", 7), ("a", None, None, None), (None, 1, "h2", 1)]
    df = spark.createDataFrame(rows, "k string, label int, h string, n int")
    got = {r.k: (r.n_rows, r.total_rows, r.n_positive, r.n_distinct, r.n_values, r.quantiles) for r in per_key_results(df, "k", "label", "h", "n", [0.5]).collect()}
    assert got == {"a": (3, 4, 1, 1, 2, [5]), None: (1, 4, 1, 1, 1, [1])}
    assert per_key_results(df.limit(0), "k", "label", "h", "n").count() == 0


def test_tokens_and_calls(spark):
    code = 'int f(char *dst, int n) {\r\n\tif (n == 0x1F) return -1;\r\n  parseHTTPHeader_v2("a\\"b", \'c\');   \n\n\n\n  ___ = strcpy(dst, "x");\n}\n'
    row = spark.createDataFrame([(code,)], "c string").select(X.normalize_code(F.col("c")).alias("n"), X.tokens(F.col("c")).alias("t"), X.skeleton(F.col("c")).alias("s")).first()
    assert row.n == 'int f(char *dst, int n) {\n    if (n == 0x1F) return -1;\n  parseHTTPHeader_v2("a\\"b", \'c\');\n\n  ___ = strcpy(dst, "x");\n}'
    assert row.t == "int f ( char * dst , int n ) { if ( n == num_lit ) return - num_lit ; parse httpheader v2 ( str_lit , str_lit ) ;".split() + [""] + "= strcpy ( dst , str_lit ) ; }".split()
    assert row.s == "int call ( char * id , int id ) { if ( id == num ) return - num ; call ( lit , lit ) ; id = call ( id , lit ) ; }"
    got = spark.createDataFrame([(row.n,)], "n string").select(X.calls(F.col("n")), X.function_name(F.col("n")), X.signature_parameters(F.col("n"))).first()
    assert tuple(got) == (["f", "parseHTTPHeader_v2", "strcpy"], "f", 2)


def test_graph_of_a_function(spark):
    df = spark.createDataFrame([(1, "int f(int a) {\nx = a;\nx = g(x);\nreturn x;\n}")], "row_id int, code string")
    rows = codegraph.ast_sequence(codegraph.edges(codegraph.nodes(codegraph.with_statements(df, "code")))).first()
    assert [(n.id, n.type) for n in rows.nodes] == [(1, "METHOD"), (2, "PARAM"), (3, "CALL"), (4, "CALL"), (5, "EXPRESSION"), (6, "CALL"), (7, "CALL"), (8, "CONTROL_STRUCTURE"), (9, "STATEMENT")]
    assert {(e.source, e.target) for e in rows.edges if e.type == "REACHES"} == {(5, 6), (6, 8)}
    assert rows.ast_sequence.startswith("( METHOD ( PARAM ) PARAM ( CALL ( CALL ) CALL ) CALL ( EXPRESSION ) EXPRESSION")


def test_one_key_and_one_value_hold_nearly_all_rows(spark):
    rows = spark.range(20_000).selectExpr("if(id % 10 = 0, concat('k', id), 'hot') as k", "if(id % 7 = 0, id, 5) as x", "1 as w")
    got = {r.k: (r.n_rows, r.quantiles) for r in exact_quantiles(rows, "k", "x", [0.5, 0.99]).collect()}
    hot = [i if i % 7 == 0 else 5 for i in range(20_000) if i % 10]
    assert len(got) == 2001 and got["hot"] == (18_000, [5, lower_quantile(hot, 0.99)]) and got["k70"] == (1, [70, 70])


def test_join_of_hot_groups(spark):
    rows = spark.range(9000).selectExpr("if(id % 10 < 9, 'hot', if(id % 20 = 9, null, concat('k', id))) as k", "id as x")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = join_groups(rows, groups, "k", "n", 9000, how).collect()
        assert len(got) == (9000 if how == "left" else 8550) and sum(r.n == 8100 for r in got) == 8100 and sum(r.n is None for r in got) == (450 if how == "left" else 0)


