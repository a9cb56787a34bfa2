"""Queries over source code: normalisation, tokens, features, graph and suspicious lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text as X
from faultline.operators import codegraph, features, localizer, runs
from faultline.plans.scores import _LATEST, latest
from faultline.workspace import spread, table


def _code(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spread(table(spark, d, "function_records").where("code is not null").select("row_id", "code", *more))


def q_normalize_code(spark, d):
    text = X.normalize_code(F.col("code"))
    return _code(spark, d).select("row_id", F.sha2(text, 256).alias("text_hash"), F.char_length(text).alias("n_chars"))


def q_sanitize_literals(spark, d):
    return _code(spark, d).select("row_id", F.sha2(X.sanitize_literals(X.normalize_code(F.col("code"))), 256).alias("text_hash"))


def q_token_counts(spark, d):
    rows = _code(spark, d).withColumn("t", X.tokens(F.col("code")))
    return rows.select("row_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("token_hash"))


def q_token_frequency_top(spark, d):
    rows = _code(spark, d).select(F.explode_outer(X.tokens(F.col("code"))).alias("token")).where("token is not null")
    return rows.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(50)


def q_skeleton(spark, d):
    return _code(spark, d).select("row_id", F.sha2(X.skeleton(F.col("code")), 256).alias("skeleton_hash"))


def q_function_signature(spark, d):
    text = X.normalize_code(F.col("code"))
    return _code(spark, d).select("row_id", X.function_name(text).alias("function_name"), X.signature_parameters(text).alias("signature_parameters"), X.head_parameters(text).alias("head_parameters"))


def q_calls_risky(spark, d):
    rows = _code(spark, d).withColumn("c", X.calls(X.normalize_code(F.col("code"))))
    return rows.select("row_id", F.array_join("c", ",").alias("calls"), F.size("c").alias("n_calls"), F.size(F.filter("c", lambda c: F.lower(c).isin(*X.RISKY))).alias("n_risky"))


def q_structure_summary(spark, d):
    return _code(spark, d).select("row_id", X.structure_summary(F.col("code")).alias("summary"))


def q_truncate(spark, d):
    return _code(spark, d).select("row_id", X.truncate_text(F.col("code"), 200).alias("text"))


def q_lexical_features(spark, d):
    rows = features.lexical_features(_code(spark, d), "code")
    return rows.select("row_id", *(F.round(c, 6).alias(c) for c in features.LEXICAL))


def q_label_profile(spark, d):
    """Mean of every lexical feature per label."""
    rows = features.lexical_features(_code(spark, d, "label"), "code")
    return rows.groupBy("label").agg(F.count("*").alias("n_rows"), *(F.round(F.avg(c), 4).alias(c) for c in features.LEXICAL))


def q_graph_nodes(spark, d):
    rows = codegraph.nodes(codegraph.with_statements(_code(spark, d), "code"))
    return rows.select("row_id", F.inline_outer("nodes")).withColumnRenamed("id", "node_id")


def q_graph_edges(spark, d):
    rows = codegraph.edges(codegraph.with_statements(_code(spark, d), "code"))
    return rows.select("row_id", F.inline_outer("edges")).where("type is not null")


def q_edge_type_hist(spark, d):
    return q_graph_edges(spark, d).groupBy("type").agg(F.count("*").alias("n_edges"), F.countDistinct("row_id").alias("n_functions"))


def q_ast_sequence(spark, d):
    return codegraph.ast_sequence(codegraph.with_statements(_code(spark, d), "code")).select("row_id", "ast_sequence")


GRAPH = "backend_is_joern log_graph_nodes log_graph_edges graph_avg_degree graph_call_ratio graph_control_ratio graph_expression_ratio graph_cfg_ratio graph_ast_ratio graph_reaches_ratio graph_max_out_degree log_ast_token_count".split()


def graph_features(rows: DataFrame, code: str) -> DataFrame:
    """``rows`` with the graph's twelve features; degrees are counted on the first 96 edges, as these are what is kept."""
    rows = codegraph.ast_sequence(codegraph.edges(codegraph.nodes(codegraph.with_statements(rows, code))))
    share = lambda column, kind: F.coalesce(F.try_divide(F.size(F.filter(column, lambda x: x["type"] == kind)).cast("double"), F.size(column).cast("double")), F.lit(0.0))
    rows = rows.withColumn("_kept", F.transform(F.slice("edges", 1, codegraph.EDGES), lambda e: e["source"])).withColumn("_sources", F.array_distinct("_kept"))
    degrees = F.transform("_sources", lambda s: F.size(F.filter("_kept", lambda x: x == s)))
    values = (
        F.lit(0.0),
        F.log1p(F.size("nodes")),
        F.log1p(F.size("edges")),
        F.size("_kept").cast("double") / F.greatest(F.size("_sources"), F.lit(1)),
        share("nodes", "CALL"),
        share("nodes", "CONTROL_STRUCTURE"),
        share("nodes", "EXPRESSION"),
        share("edges", "FLOWS_TO"),
        share("edges", "IS_AST_PARENT"),
        share("edges", "REACHES"),
        F.coalesce(F.array_max(degrees), F.lit(0)).cast("double"),
        F.log1p(F.size(F.split("ast_sequence", " "))),
    )
    return rows.withColumns(dict(zip(GRAPH, values, strict=True))).drop("_kept", "_sources")


def q_graph_features(spark, d):
    return graph_features(_code(spark, d), "code").select("row_id", *(F.round(c, 6).alias(c) for c in GRAPH))


def _told(spark, d):
    """Rows with the branch scores and the band of their record's last prediction; 0.5 and 'high' where there is none."""
    p = latest(spark, d).select("record_id", *(F.coalesce(F.nullif(c, F.lit(float("nan"))), F.lit(0.5)).alias(n) for n, c in (("semantic", "prefilter_semantic_score"), ("graph", "prefilter_graph_score"), ("fusion", "calibrated_probability"))), F.coalesce("risk_band", F.lit("high")).alias("band"))
    rows = _code(spark, d, "record_id").join(p, "record_id", "left")
    return rows.fillna(0.5, ["semantic", "graph", "fusion"]).fillna("high", ["band"])


def _top(spark, d):
    return localizer.top_lines(_told(spark, d), "code", F.col("semantic"), F.col("graph"), F.col("fusion"), F.col("band"))


def q_line_scores(spark, d):
    """The most suspicious lines of every function: two for band inspect, four for high, else one."""
    return _top(spark, d).select("row_id", F.posexplode_outer("top_lines").alias("rank", "t")).where("rank is not null").select("row_id", (F.col("rank") + 1).alias("rank"), "t.line_number", "t.score", F.array_join("t.reasons", "|").alias("reasons"))


def q_suspicious_slices(spark, d):
    return localizer.slices(_top(spark, d)).select("row_id", F.inline_outer("slices")).where("start_line is not null").select("row_id", "start_line", "end_line", "score", F.array_join("reasons", "|").alias("reasons"))


def q_token_highlights(spark, d):
    """The eight most frequent identifier tokens of every function's top lines."""
    return _top(spark, d).select("row_id", F.array_join(localizer.token_highlights(), ",").alias("highlights"))


def q_slices_text(spark, d):
    """The slices of every function written out, as a digest."""
    return localizer.slices(_top(spark, d)).select("row_id", F.sha2(localizer.slices_text(), 256).alias("text_hash"), F.char_length(localizer.slices_text()).alias("n_chars"))


def q_feature_scaling(spark, d):
    """Mean and population deviation of every lexical feature over the training rows (below 1e-6: 1), and the mean of all rows' scaled values."""
    rows = features.lexical_features(_code(spark, d, "split"), "code").withColumn("train", F.coalesce(runs.split_name(F.col("split")) == "train", F.lit(False)))
    long_ = rows.select("train", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in features.LEXICAL))).alias("f")).select("train", "f.*")
    sums = long_.groupBy("feature").agg(F.avg(F.when(F.col("train"), F.col("x"))).alias("mean"), F.stddev_pop(F.when(F.col("train"), F.col("x"))).alias("std"), F.avg("x").alias("every"))
    sums = sums.withColumn("std", F.when(F.col("std") < 1e-6, 1.0).otherwise(F.col("std")))
    return sums.select("feature", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"), F.round((F.col("every") - F.col("mean")) / F.col("std"), 4).alias("scaled_mean"))


def q_vocabulary(spark, d, most: int = 200, length: int = 64):
    """Rows as numbers of their first 64 tokens, by a vocabulary of the 200 most frequent training tokens: 0 fills up, 1 is unknown."""
    rows = _code(spark, d, "split").withColumn("t", X.tokens(F.col("code")))
    train = rows.where(runs.split_name(F.col("split")) == "train").select(F.explode("t").alias("token")).where("token <> ''")
    top = train.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(most)
    known = F.broadcast(top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "token")))["token"].alias("known")))  # one row of 200 words
    number = F.transform(F.slice("t", 1, length), lambda x: F.when(F.array_contains("known", x), F.array_position("known", x) + 1).otherwise(1))
    filled = F.concat(number, F.array_repeat(F.lit(0).cast("long"), length - F.size(number)))
    return rows.crossJoin(known).select("row_id", F.sha2(F.array_join(filled, ","), 256).alias("ids_hash"), F.size(F.filter(number, lambda x: x == 1)).cast("int").alias("n_unknown"))


QUERIES = {f.__name__: f for f in (q_normalize_code, q_sanitize_literals, q_token_counts, q_token_frequency_top, q_skeleton, q_function_signature, q_calls_risky, q_structure_summary, q_truncate, q_lexical_features, q_label_profile, q_graph_nodes, q_graph_edges, q_edge_type_hist, q_ast_sequence, q_graph_features, q_line_scores, q_suspicious_slices, q_token_highlights, q_slices_text, q_feature_scaling, q_vocabulary)}

# The same in SQL, from fragments.
_ENDS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]+"
_W = lambda words: ", ".join(f"'{w}'" for w in words)
_STRIP = lambda x: f"regexp_replace({x}, '^{_ENDS}|{_ENDS}$', '', 'g')"
_NORM = lambda x: _STRIP(rf"regexp_replace(regexp_replace(replace(replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), chr(9), '    '), chr(0), ' '), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")
_SANE = lambda x: rf"""regexp_replace(regexp_replace(regexp_replace({x}, '(?s)"(?:\\.|[^"\\])*"', ' STR_LIT ', 'g'), '(?s)''(?:\\.|[^''\\])*''', ' CHAR_LIT ', 'g'), '\b(?:0x[0-9a-fA-F]+|\d+\.\d+|\d+)\b', ' NUM_LIT ', 'g')"""
_TOKEN = X.TOKEN.replace("'", "''")
_PARTS = r"list_filter(string_split(lower(replace(regexp_replace(t, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '__', '_')), '_'), lambda p: p <> '')"
_TOK = rf"""flatten(list_transform(raw, lambda t: CASE WHEN t IN ('STR_LIT', 'CHAR_LIT') THEN ['str_lit'] WHEN t = 'NUM_LIT' THEN ['num_lit'] WHEN NOT regexp_matches(t, '^[A-Za-z_]') THEN [t]
  WHEN lower(t) IN ({_W(X.KEYWORDS)}) THEN [lower(t)] WHEN len({_PARTS}) = 0 THEN [''] ELSE {_PARTS} END))"""
_BASE = f"""WITH n AS (SELECT row_id, label, {_NORM('code')} AS txt FROM function_records WHERE code IS NOT NULL),
r AS (SELECT row_id, label, txt, regexp_extract_all({_SANE('txt')}, '{_TOKEN}') AS raw, regexp_extract_all(txt, '\\b([A-Za-z_]\\w*)\\s*\\(', 1) AS called FROM n),
s AS (SELECT *, {_TOK} AS toks, list_filter(called, lambda c: lower(c) NOT IN ({_W(X.KEYWORDS)})) AS k FROM r),
c AS (SELECT *, list_filter(k, lambda v, i: list_position(list_transform(k, lambda y: lower(y)), lower(v)) = i) AS calls,
  list_filter(list_transform(string_split_regex(txt, '[\\n\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda y: {_STRIP('y')}), lambda y: y <> '') AS lns FROM s)
"""
_SIG = r"(?s)([A-Za-z_]\w*)\s*\((.*?)\)\s*\{"
_NAME = f"regexp_extract(substring(txt, 1, 1200), '{_SIG}', 1)"
_FN = f"CASE WHEN {_NAME} = '' OR lower({_NAME}) IN ({_W(X.CONTROL)}) THEN 'unknown' ELSE {_NAME} END"
_PC = lambda inside: f"CASE WHEN {_STRIP(inside)} IN ('', 'void') THEN 0 ELSE len(list_filter(string_split({_STRIP(inside)}, ','), lambda p: {_STRIP('p')} <> '')) END"
_SP = _PC(f"regexp_extract(substring(txt, 1, 1200), '{_SIG}', 2)")
_HP = _PC(r"regexp_extract(substring(txt, 1, 1000), '(?s)^[^(]*\((.*?)\)', 1)")
_CNT = lambda words: f"len(list_filter(toks, lambda t: t IN ({_W(words)})))"
_OCC = lambda part: f"((length(txt) - length(replace(txt, '{part}', ''))) // {len(part)})"
_RISKY = f"len(list_filter(calls, lambda c: lower(c) IN ({_W(X.RISKY)})))"
_N, _L = "greatest(len(toks), 1)", "greatest(len(lns), 1)"
_LEX = {
    "log_token_count": f"ln(1 + {_N}::DOUBLE)",
    "unique_token_ratio": f"len(list_distinct(toks))::DOUBLE / {_N}",
    "log_line_count": "ln(1 + len(lns)::DOUBLE)",
    "parameter_count": f"({_HP})::DOUBLE",
    "log_call_count": "ln(1 + len(calls)::DOUBLE)",
    "risky_call_count": f"{_RISKY}::DOUBLE",
    "risky_call_ratio": f"{_RISKY}::DOUBLE / greatest(len(calls), 1)",
    "control_density": f"{_CNT(X.CONTROL)}::DOUBLE / {_N}",
    "pointer_density": f"({_OCC('->')} + {_OCC('*')} + {_OCC('&')})::DOUBLE / {_L}",
    "array_access_density": f"{_OCC('[')}::DOUBLE / {_L}",
    "numeric_literal_density": f"{_CNT(['num_lit'])}::DOUBLE / {_N}",
    "memory_ops_count": f"{_CNT(X.MEMORY)}::DOUBLE",
}
_SOME = lambda x: f"coalesce(nullif(array_to_string({x}, ', '), ''), 'none')"
_CONTROL = "concat('{', array_to_string(list_filter([" + ", ".join(f"""CASE WHEN list_contains(toks, '{k}') THEN concat('"{k}": ', len(list_filter(toks, lambda t: t = '{k}'))) END""" for k in X.CONTROL) + "], lambda z: z IS NOT NULL), ', '), '}')"
_SUMMARY = f"""concat_ws(chr(10), concat('function=', {_FN}), concat('params=', {_SP}), concat('lines=', len(lns)), concat('calls=', {_SOME('calls[1:8]')}), concat('control=', {_CONTROL}),
  concat('risky_apis=', {_SOME(f"list_filter(calls, lambda c: lower(c) IN ({_W(X.RISKY)}))")}), concat('memory_ops=', {_SOME("list_filter([" + _W(X.SUMMARY_MEMORY) + "], lambda m: list_contains(toks, m))")}),
  concat('pointer_ops=', {_OCC('->')} + {_OCC('*')} + {_OCC('&')}), concat('array_accesses=', {_OCC('[')}))"""
_KW = "|".join(X.CONTROL)
# statements as rows, definitions found by a window over earlier lines: another way than the query's
_STMT = (
    _BASE
    + f""", l AS (SELECT row_id, txt, {_FN} AS fname, {_SP} AS params, unnest(lns[1:40]) AS line, generate_subscripts(lns[1:40], 1) AS i FROM c),
q AS (SELECT *, list_filter(regexp_extract_all(line, '\\b([A-Za-z_]\\w*)\\s*\\(', 1), lambda z: lower(z) NOT IN ({_W(X.CONTROL)})) AS lk FROM l),
t AS (SELECT *, list_filter(lk, lambda v, j: list_position(list_transform(lk, lambda y: lower(y)), lower(v)) = j) AS lcalls,
  CASE WHEN regexp_matches(lower(line), '^({_KW})') OR regexp_matches(lower(line), '({_KW}) ?\\(') THEN 'CONTROL_STRUCTURE' WHEN contains(line, '(') AND contains(line, ')') THEN 'CALL' WHEN contains(line, '=') THEN 'EXPRESSION' ELSE 'STATEMENT' END AS type FROM q),
st AS (SELECT *, (params + 2 + coalesce(sum(1 + len(lcalls)) OVER (PARTITION BY row_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INTEGER AS id FROM t),
cl AS (SELECT row_id, id, unnest(lcalls) AS callee, generate_subscripts(lcalls, 1) AS k FROM st),
pa AS (SELECT row_id, unnest(range(1, ({_SP})::BIGINT + 1)) AS k FROM c)
"""
)
_CUT = lambda x: f"CASE WHEN length({_NORM(x)}) <= 120 THEN {_NORM(x)} ELSE concat(regexp_replace(substring({_NORM(x)}, 1, 117), '{_ENDS}$', ''), '...') END"
_EDGES = (
    _STMT
    + r""", df AS (SELECT row_id, i, id, unnest(list_distinct(list_transform(regexp_extract_all(line, '\b([A-Za-z_]\w*)\s*=', 1), lambda z: lower(z)))) AS name FROM st),
us AS (SELECT row_id, i, id, unnest(list_distinct(list_transform(regexp_extract_all(line, '\b([A-Za-z_]\w*)\b', 1), lambda z: lower(z)))) AS name FROM st),
re AS (SELECT us.row_id, max(df.id) AS source, us.id AS target FROM us JOIN df ON us.row_id = df.row_id AND us.name = df.name AND df.i < us.i"""
    + f" WHERE us.name NOT IN ({_W(X.CONTROL)}) GROUP BY us.row_id, us.id, us.name), "
    + """e AS (SELECT row_id, 1 AS source, (k + 1)::INTEGER AS target, 'IS_AST_PARENT' AS type FROM pa UNION SELECT row_id, 1, id, 'IS_AST_PARENT' FROM st
  UNION SELECT row_id, id, (id + k)::INTEGER, 'IS_AST_PARENT' FROM cl UNION SELECT row_id, source, target, 'REACHES' FROM re
  UNION SELECT row_id, id, nxt, 'FLOWS_TO' FROM (SELECT row_id, id, lead(id) OVER (PARTITION BY row_id ORDER BY i) AS nxt FROM st) WHERE nxt IS NOT NULL)
"""
)
_GRAPH = _EDGES.rstrip() + """, nd AS (SELECT row_id, type FROM st UNION ALL SELECT row_id, 'CALL' FROM cl UNION ALL SELECT row_id, 'PARAM' FROM pa UNION ALL SELECT row_id, 'METHOD' FROM c),
nc AS (SELECT row_id, count(*) AS n, count(*) FILTER (type = 'CALL') AS nc, count(*) FILTER (type = 'CONTROL_STRUCTURE') AS nk, count(*) FILTER (type = 'EXPRESSION') AS ne FROM nd GROUP BY row_id),
ec AS (SELECT row_id, count(*) AS m, count(*) FILTER (type = 'FLOWS_TO') AS mf, count(*) FILTER (type = 'IS_AST_PARENT') AS ma, count(*) FILTER (type = 'REACHES') AS mr FROM e GROUP BY row_id),
ek AS (SELECT row_id, source, count(*) AS deg FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY source, target, type) AS nth FROM e) WHERE nth <= 96 GROUP BY ALL), dg AS (SELECT row_id, sum(deg)::DOUBLE / count(*) AS av, max(deg)::DOUBLE AS mx FROM ek GROUP BY row_id)
"""
_R = lambda a, b: f"round(coalesce({a}::DOUBLE / nullif({b}, 0), 0), 6)"
_RSTRIP = lambda x: f"regexp_replace({x}, '{_ENDS}$', '')"
# lines as rows, scored by the same chain of steps as whole texts
_LINES = (
    "WITH ra AS (SELECT row_id, record_id, string_split_regex(" + _NORM("code") + r", '[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS raw_lines FROM function_records WHERE code IS NOT NULL), "
    + "li AS (SELECT row_id, ln, " + _RSTRIP("x") + " AS code FROM (SELECT row_id, generate_subscripts(raw_lines, 1) AS ln, unnest(raw_lines) AS x FROM ra)), "
    + _BASE.replace("WITH n AS", "n AS", 1).replace("row_id, label", "row_id, ln, code AS own").replace("row_id, ln, code AS own, txt, regexp_extract_all", "row_id, ln, own, txt, regexp_extract_all").replace("FROM function_records WHERE code IS NOT NULL", "FROM li WHERE code <> ''").rstrip()
    + f""", rk AS (SELECT *, list_filter(calls, lambda z: lower(z) IN ({_W(X.RISKY)})) AS risky FROM c),
ru AS (SELECT row_id, ln, own, [struct_pack(v := 3.0::DOUBLE + 0.4::DOUBLE * len(risky), r := CASE WHEN len(risky) > 0 THEN concat('risky_api=', array_to_string(risky[1:3], ',')) END),
  struct_pack(v := 1.6::DOUBLE, r := CASE WHEN list_has_any(toks, [{_W(X.MEMORY)}]) THEN 'memory_op' END), struct_pack(v := 1.2::DOUBLE, r := CASE WHEN list_has_any(toks, [{_W(localizer.POINTERS)}]) OR contains(txt, '->') THEN 'pointer_or_array' END),
  struct_pack(v := 1.0::DOUBLE, r := CASE WHEN regexp_matches(txt, '[-+*/%]') AND list_has_any(toks, [{_W(localizer.ARITHMETIC)}]) THEN 'index_arithmetic' END), struct_pack(v := 0.8::DOUBLE, r := CASE WHEN list_has_any(toks, [{_W(localizer.VALIDATION)}]) THEN 'control_or_validation' END),
  struct_pack(v := 0.8::DOUBLE, r := CASE WHEN contains(txt, '=') AND list_has_any(toks, [{_W(localizer.BUFFERS)}]) THEN 'buffer_assignment' END), struct_pack(v := 0.5::DOUBLE, r := CASE WHEN list_contains(toks, 'return') AND list_has_any(toks, [{_W(localizer.ERRORS)}]) THEN 'error_path' END),
  struct_pack(v := 0.4::DOUBLE, r := CASE WHEN {_OCC('(')} <> {_OCC(')')} OR {_OCC('{')} <> {_OCC('}')} THEN 'unbalanced_structure' END)] AS rules FROM rk),
hi AS (SELECT row_id, ln, own, list_filter(rules, lambda z: z.r IS NOT NULL) AS hit FROM ru), """
    + _LATEST.replace("WITH l AS", "lt AS", 1)
    + """, sl AS (SELECT ra.row_id, raw_lines, 0.35::DOUBLE + 0.3::DOUBLE * coalesce(CASE WHEN CAST(prefilter_semantic_score AS VARCHAR) <> 'nan' THEN prefilter_semantic_score END, 0.5) + 0.35::DOUBLE * coalesce(CASE WHEN CAST(prefilter_graph_score AS VARCHAR) <> 'nan' THEN prefilter_graph_score END, 0.5) + 0.2::DOUBLE * coalesce(calibrated_probability, 0.5) AS scale,
  CASE coalesce(risk_band, 'high') WHEN 'inspect' THEN 2 WHEN 'high' THEN 4 ELSE 1 END AS k FROM ra LEFT JOIN lt USING (record_id)),
sc AS (SELECT row_id, ln, own, coalesce(list_sum(list_transform(hit, lambda z: z.v)), 0) * scale AS score, list_transform(hit, lambda z: z.r) AS reasons, scale, k, row_number() OVER (PARTITION BY row_id ORDER BY ln) AS pos FROM hi JOIN sl USING (row_id)),
an AS (SELECT *, max(score) OVER (PARTITION BY row_id) > 0 AS any_ FROM sc), us AS (SELECT row_id, ln, own, k, round(CAST(CAST(CASE WHEN any_ THEN score ELSE 0.1::DOUBLE * scale END AS VARCHAR) AS DECIMAL(38, 18)), 4)::DOUBLE AS score, CASE WHEN any_ THEN reasons ELSE ['fallback_context'] END AS reasons FROM an WHERE (any_ AND score > 0) OR (NOT any_ AND pos <= 3)),
tl AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, ln) AS rank FROM us QUALIFY rank <= k)
"""
)
_SLICES = _LINES + """, ce AS (SELECT row_id, list_sort(list(DISTINCT ln)) AS cs FROM tl GROUP BY row_id), sp AS (SELECT row_id, raw_lines, list_transform(cs, lambda x: greatest(1, x - 1)) AS a, list_transform(cs, lambda x: least(len(raw_lines), x + 1)) AS b FROM ce JOIN sl USING (row_id)),
f2 AS (SELECT *, a[2] > b[1] AS k2 FROM sp), f3 AS (SELECT *, CASE WHEN k2 THEN b[2] ELSE b[1] END AS e2 FROM f2), f4 AS (SELECT *, a[3] > e2 AS k3, CASE WHEN a[3] > e2 THEN b[3] ELSE e2 END AS e3 FROM f3), f5 AS (SELECT *, a[4] > e3 AS k4 FROM f4),
kp AS (SELECT row_id, raw_lines, unnest([struct_pack(a := a[1], b := b[1], k := true), struct_pack(a := a[2], b := b[2], k := k2), struct_pack(a := a[3], b := b[3], k := k3), struct_pack(a := a[4], b := b[4], k := k4)]) AS s FROM f5),
sx AS (SELECT kp.row_id, s.a AS start_line, s.b AS end_line, any_value(raw_lines) AS raw_lines, max(score) AS score, list_sort(list_distinct(flatten(list(reasons)))) AS reasons FROM kp JOIN tl ON kp.row_id = tl.row_id AND tl.ln BETWEEN s.a AND s.b WHERE s.k AND s.a IS NOT NULL GROUP BY ALL)
"""
_TRAIN = r"lower(regexp_replace(split, '^[\s\x0b\x1c-\x1f\x{85}\pZ]+|[\s\x0b\x1c-\x1f\x{85}\pZ]+$', '', 'g')) = 'train'"
ORACLES = {
    "q_normalize_code": _BASE + "SELECT row_id, sha256(txt) AS text_hash, length(txt)::INTEGER AS n_chars FROM n",
    "q_sanitize_literals": _BASE + f"SELECT row_id, sha256({_SANE('txt')}) AS text_hash FROM n",
    "q_token_counts": _BASE + "SELECT row_id, len(toks)::INTEGER AS n_tokens, len(list_distinct(toks))::INTEGER AS n_distinct, sha256(coalesce(array_to_string(toks, ' '), '')) AS token_hash FROM s",
    "q_token_frequency_top": _BASE + "SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM s) GROUP BY token ORDER BY n DESC, token LIMIT 50",
    "q_skeleton": _BASE + f"""SELECT row_id, sha256(coalesce(array_to_string(list_transform(raw, lambda t, i: CASE WHEN t IN ('STR_LIT', 'CHAR_LIT') THEN 'lit' WHEN t = 'NUM_LIT' THEN 'num' WHEN NOT regexp_matches(t, '^[A-Za-z_]') THEN t
  WHEN lower(t) IN ({_W(X.KEYWORDS)}) THEN lower(t) WHEN raw[i + 1] = '(' THEN 'call' ELSE 'id' END), ' '), '')) AS skeleton_hash FROM r""",
    "q_function_signature": _BASE + f"SELECT row_id, {_FN} AS function_name, ({_SP})::INTEGER AS signature_parameters, ({_HP})::INTEGER AS head_parameters FROM n",
    "q_calls_risky": _BASE + f"SELECT row_id, coalesce(array_to_string(calls, ','), '') AS calls, len(calls)::INTEGER AS n_calls, {_RISKY}::INTEGER AS n_risky FROM c",
    "q_structure_summary": _BASE + f"SELECT row_id, {_SUMMARY} AS summary FROM c",
    "q_truncate": _BASE + f"SELECT row_id, CASE WHEN length(txt) <= 200 THEN txt ELSE concat(regexp_replace(substring(txt, 1, 197), '{_ENDS}$', ''), '...') END AS text FROM n",
    "q_lexical_features": _BASE + "SELECT row_id, " + ", ".join(f"round({sql}, 6) AS {name}" for name, sql in _LEX.items()) + " FROM c",
    "q_label_profile": _BASE + "SELECT label, count(*) AS n_rows, " + ", ".join(f"round(avg({sql}), 4) AS {name}" for name, sql in _LEX.items()) + " FROM c GROUP BY label",
    "q_graph_nodes": _STMT + f"""SELECT row_id, 1 AS node_id, 'METHOD' AS type, {_CUT(f"concat({_FN}, '()')")} AS code FROM c UNION ALL SELECT row_id, (k + 1)::INTEGER, 'PARAM', concat('param_', k) FROM pa
  UNION ALL SELECT row_id, id, type, {_CUT('line')} FROM st UNION ALL SELECT row_id, (id + k)::INTEGER, 'CALL', {_CUT("concat(callee, '(...)')")} FROM cl""",
    "q_graph_edges": _EDGES + "SELECT * FROM e",
    "q_ast_sequence": _STMT + f""", a AS (SELECT row_id, string_agg(concat(' ( ', type, repeat(' ( CALL ) CALL', len(lcalls)), ' ) ', type), '' ORDER BY i) AS body FROM st GROUP BY row_id)
SELECT row_id, array_to_string(string_split(concat('( METHOD', repeat(' ( PARAM ) PARAM', ({_SP})::BIGINT), coalesce(body, ''), ' ) METHOD'), ' ')[1:512], ' ') AS ast_sequence FROM c LEFT JOIN a USING (row_id)""",
    "q_graph_features": _GRAPH + f"""SELECT c.row_id, 0.0::DOUBLE AS backend_is_joern, round(ln(1 + n::DOUBLE), 6) AS log_graph_nodes, round(ln(1 + coalesce(m, 0)::DOUBLE), 6) AS log_graph_edges, round(coalesce(av, 0), 6) AS graph_avg_degree, {_R('nc', 'n')} AS graph_call_ratio, {_R('nk', 'n')} AS graph_control_ratio,
  {_R('ne', 'n')} AS graph_expression_ratio, {_R('mf', 'm')} AS graph_cfg_ratio, {_R('ma', 'm')} AS graph_ast_ratio, {_R('mr', 'm')} AS graph_reaches_ratio, coalesce(mx, 0) AS graph_max_out_degree,
  round(ln(1 + least(512, 4 + 4 * ({_SP}) + coalesce((SELECT sum(4 + 4 * len(lcalls)) FROM st WHERE st.row_id = c.row_id), 0))::DOUBLE), 6) AS log_ast_token_count FROM c JOIN nc USING (row_id) LEFT JOIN ec USING (row_id) LEFT JOIN dg USING (row_id)""",
    "q_line_scores": _LINES + "SELECT row_id, rank::INTEGER AS rank, ln::INTEGER AS line_number, score, array_to_string(reasons, '|') AS reasons FROM tl",
    "q_suspicious_slices": _SLICES + "SELECT row_id, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, score, array_to_string(reasons, '|') AS reasons FROM sx",
    "q_token_highlights": _LINES + """, tk AS (SELECT tl.row_id, unnest(toks) AS x, rank * 100000 + generate_subscripts(toks, 1) AS place FROM tl JOIN c ON tl.row_id = c.row_id AND tl.ln = c.ln), co AS (SELECT row_id, x, count(*) AS n, min(place) AS place FROM tk WHERE regexp_matches(x, '^[A-Za-z_]\\w*$') AND x NOT IN ('if', 'for', 'while', 'return') GROUP BY ALL),
tp AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, place) AS nth FROM co QUALIFY nth <= 8), jo AS (SELECT row_id, string_agg(x, ',' ORDER BY nth) AS highlights FROM tp GROUP BY row_id) SELECT row_id, coalesce(highlights, '') AS highlights FROM ra LEFT JOIN jo USING (row_id)""",
    "q_feature_scaling": _BASE.replace("row_id, label", "row_id, split") + ", x AS (SELECT coalesce(" + _TRAIN + ", false) AS train, unnest([" + ", ".join(f"'{n}'" for n in _LEX) + "]) AS feature, unnest([" + ", ".join(_LEX.values()) + "]) AS v FROM c), m AS (SELECT feature, avg(v) FILTER (train) AS mean, CASE WHEN stddev_pop(v) FILTER (train) < 1e-6 THEN 1.0::DOUBLE ELSE stddev_pop(v) FILTER (train) END AS std, avg(v) AS every FROM x GROUP BY feature) SELECT feature, round(mean, 5) AS mean, round(std, 5) AS std, round((every - mean) / std, 4) AS scaled_mean FROM m",
    "q_vocabulary": _BASE.replace("row_id, label", "row_id, split") + ", v AS (SELECT list(token ORDER BY n DESC, token) AS known FROM (SELECT token, count(*) AS n FROM (SELECT unnest(toks) AS token FROM s WHERE " + _TRAIN + """) WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 200)),
i AS (SELECT row_id, coalesce(list_transform(toks[1:64], lambda t: CASE WHEN list_contains(known, t) THEN list_position(known, t) + 1 ELSE 1 END), []) AS ids FROM s, v)
SELECT row_id, sha256(array_to_string(list_concat(ids, list_transform(range(0, 64 - len(ids)), lambda z: 0)), ',')) AS ids_hash, len(list_filter(ids, lambda z: z = 1))::INTEGER AS n_unknown FROM i""",
    "q_edge_type_hist": _EDGES + "SELECT type, count(*) AS n_edges, count(DISTINCT row_id) AS n_functions FROM e GROUP BY type",
}
