"""Queries over demonstrations and imported graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.functions import text as X
from faultline.operators import codegraph, dot
from faultline.operators import retrieval as R
from faultline.plans.code import _STMT, _SP
from faultline.plans.records import sample_per
from faultline.plans.scores import _LATEST, latest
from faultline.workspace import table

#: Demonstrations of each label that a bank keeps, and those that a query gets.
PER_LABEL, K = 4000, 5


def _vectors(spark, d):
    v = F.col("semantic_embeddings")
    good = (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)
    return table(spark, d, "feature_store").where(F.col("record_id").isNotNull() & good).select("record_id", v.alias("v"))


def bank(spark, d):
    """At most 4,000 demonstrations of each label, with their vectors: a table of bounded size."""
    rows = sample_per(table(spark, d, "demo_bank").where("label in (0, 1) and record_id is not null"), "label", "record_id", PER_LABEL)
    return rows.join(_vectors(spark, d), "record_id")


def asked(spark, d):
    """Records whose row number is divisible by 20, with code and vector, as queries."""
    rows = table(spark, d, "function_records").where("row_id % 20 = 0 and code is not null").select(F.col("row_id").alias("query"), "record_id", "code")
    return rows.join(_vectors(spark, d), "record_id")


def q_cosine_topk(spark, d):
    """The 24 demonstrations of each label nearest to every query."""
    return R.nearest_per_label(asked(spark, d), bank(spark, d)).withColumn("cosine", F.round("cosine", 6))


def _scored(spark, d):
    queries = asked(spark, d)
    near = R.nearest_per_label(queries, bank(spark, d))
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda t: t != "")
    trees = codegraph.ast_sequence(codegraph.with_statements(queries.select("query", "record_id", "code"), "code"))
    p = latest(spark, d).select("record_id", F.col("calibrated_probability").alias("p"))
    own = trees.join(p, "record_id", "left").select("query", F.coalesce("p", F.lit(0.5)).alias("p"), X.tokens(F.col("code")).alias("q_tokens"), words(F.col("ast_sequence")).alias("q_ast"))
    theirs = bank(spark, d).select("record_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("b_tokens"), words(F.col("ast_sequence")).alias("b_ast"))
    rows = near.join(own, "query").join(theirs, "record_id")
    rows = rows.withColumns({"lexical": R.jaccard(F.col("q_tokens"), F.col("b_tokens")), "syntactic": R.syntactic(F.col("q_ast"), F.col("b_ast"))})
    return rows.select("query", "p", "record_id", "label", "cosine", "lexical", "syntactic", F.round(R.LEXICAL * F.col("lexical") + R.SYNTACTIC * F.col("syntactic"), 9).alias("mixed"))


def q_demo_scores(spark, d):
    """Lexical, syntactic and mixed similarity of every query and its candidates."""
    return _scored(spark, d).select("query", "record_id", *(F.round(c, 6).alias(c) for c in ("lexical", "syntactic", "mixed")))


def q_demo_retrieval(spark, d):
    """The five demonstrations of every query."""
    return R.demonstrations(_scored(spark, d), K).withColumns({c: F.round(c, 6) for c in ("mixed", "cosine")})


def q_tfidf_scores(spark, d):
    """The five demonstrations of the highest TF-IDF score for every query."""
    demos = bank(spark, d).where("tokenized_text is not null").select(F.col("record_id").alias("id"), F.filter(F.split("tokenized_text", r"\s+"), lambda t: t != "").alias("tokens"))
    queries = asked(spark, d).select(F.col("query").alias("id"), F.filter(X.tokens(F.col("code")), lambda t: t != "").alias("tokens"))
    return R.tfidf_best(queries, demos, K).select("query", "record_id", "rank", F.round("score", 6).alias("score"))


def q_bank_contamination(spark, d):
    """Test records whose tokens are nearly those of a demonstration among their candidates: Jaccard of 0.8 or more."""
    return _scored(spark, d).where("lexical >= 0.8").groupBy("query").agg(F.count("*").alias("n"), F.round(F.max("lexical"), 6).alias("most"))


_DOT = (
    ("g1", 0, 1, "digraph f {", "IS_AST_PARENT"),
    ("g1", 0, 2, '"1" [label = "(METHOD,f,)" ]', "IS_AST_PARENT"),
    ("g1", 0, 3, '"2" [label = "(CALL,,strcpy(a, b))" ];', "IS_AST_PARENT"),
    ("g1", 0, 4, '10 [label="PARAM"]', "IS_AST_PARENT"),
    ("g1", 0, 5, '"1" -> "2"', "IS_AST_PARENT"),
    ("g1", 0, 6, '"1" -> "10" [ label = "AST: x"] ;', "IS_AST_PARENT"),
    ("g1", 1, 1, '"2" [label = "(CALL,strcpy,again)" ]', "FLOWS_TO"),
    ("g1", 1, 2, '"1" -> "2" [label = "CFG: "]', "FLOWS_TO"),
    ("g1", 1, 3, '"2" -> "99"', "FLOWS_TO"),
    ("g1", 2, 1, '"1" -> "2" [label = "reaching-def: a"]', "REACHES"),
    ("g1", 2, 2, '"1" -> "2" [label = "own kind"]', "REACHES"),
    ("g1", 2, 3, '"1" -> "2" [label = "own kind"]', "REACHES"),
    ("g2", 0, 1, "n1 [ label = \"(,x)\" ];", "IS_AST_PARENT"),
    ("g2", 0, 2, "}", "IS_AST_PARENT"),
)


def _lines(spark):
    return spark.createDataFrame(list(_DOT), "graph string, part int, n int, line string, default_type string")


def q_dot_nodes(spark, d):
    """Nodes of exported graphs, merged over their representations."""
    return dot.cut(dot.parse(_lines(spark))[0])


def q_dot_edges(spark, d):
    """Edges of exported graphs whose ends are both nodes."""
    nodes, edges = dot.parse(_lines(spark))
    return dot.with_ends(edges, nodes)


QUERIES = {f.__name__: f for f in (q_cosine_topk, q_demo_scores, q_demo_retrieval, q_tfidf_scores, q_bank_contamination, q_dot_nodes, q_dot_edges)}

_PAIRS = (
    _STMT.replace("WITH n AS", "WITH fs AS (SELECT record_id, list_transform(semantic_embeddings, lambda x: x::DOUBLE) AS v FROM feature_store WHERE record_id IS NOT NULL AND len(semantic_embeddings) = 64 AND len(list_filter(semantic_embeddings, lambda x: x IS NULL OR CAST(x AS VARCHAR) = 'nan')) = 0 AND len(list_filter(semantic_embeddings, lambda x: x <> 0)) > 0), n AS", 1).rstrip()
    + ", "
    + _LATEST.replace("WITH l AS", "lt AS", 1)
    + f""", ta AS (SELECT row_id, string_agg(concat(' ( ', type, repeat(' ( CALL ) CALL', len(lcalls)), ' ) ', type), '' ORDER BY i) AS body FROM st GROUP BY row_id),
tr AS (SELECT row_id, toks, string_split(concat('( METHOD', repeat(' ( PARAM ) PARAM', ({_SP})::BIGINT), coalesce(body, ''), ' ) METHOD'), ' ')[1:512] AS q_ast FROM c LEFT JOIN ta USING (row_id)),
bk AS (SELECT b.record_id, b.label, fs.v, coalesce(tokens, []) AS b_tokens, tokenized_text, list_filter(string_split_regex(coalesce(ast_sequence, ''), '\\s+'), lambda t: t <> '') AS b_ast
  FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256(concat('42', record_id)), record_id) AS nth FROM demo_bank WHERE label IN (0, 1) AND record_id IS NOT NULL) b JOIN fs USING (record_id) WHERE nth <= 4000),
qu AS (SELECT f.row_id AS query, f.record_id, fs.v, tr.toks, tr.q_ast, coalesce(lt.calibrated_probability, 0.5) AS p FROM function_records f JOIN fs USING (record_id) JOIN tr USING (row_id) LEFT JOIN lt USING (record_id) WHERE f.row_id % 20 = 0),
ca AS (SELECT query, p, bk.record_id, bk.label, round(list_dot_product(qu.v, bk.v) / sqrt(list_dot_product(qu.v, qu.v) * list_dot_product(bk.v, bk.v)), 9) AS cosine, toks, q_ast, b_tokens, b_ast FROM qu, bk),
ne AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY cosine DESC, record_id) AS rank FROM ca QUALIFY rank <= 24),
vo AS (SELECT *, list_distinct(list_concat(q_ast[1:192], b_ast[1:192])) AS voc, len(list_distinct(list_concat(toks, b_tokens))) AS every FROM ne),
si AS (SELECT query, p, record_id, label, cosine, rank, CASE WHEN every = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(toks, b_tokens))::DOUBLE / every END AS lexical,
  CASE WHEN len(q_ast) + len(b_ast) = 0 THEN 1.0::DOUBLE ELSE (len(q_ast[1:192]) + len(b_ast[1:192]) - levenshtein(coalesce(array_to_string(list_transform(q_ast[1:192], lambda t: chr(47 + list_position(voc, t))), ''), ''), coalesce(array_to_string(list_transform(b_ast[1:192], lambda t: chr(47 + list_position(voc, t))), ''), '')))::DOUBLE / (len(q_ast[1:192]) + len(b_ast[1:192])) END AS syntactic FROM vo),
mi AS (SELECT *, round(0.7::DOUBLE * lexical + 0.3::DOUBLE * syntactic, 9) AS mixed FROM si)
"""
)
_TERMS = lambda name, src: f"""{name}1 AS (SELECT id, unnest(list_concat(tk, list_transform(range(1, len(tk)), lambda i: concat(tk[i], ' ', tk[i + 1])))) AS term FROM {src}), {name} AS (SELECT id, term, count(*) AS tf FROM {name}1 GROUP BY ALL)"""
_UNIT = lambda name, src: f"{name}2 AS (SELECT id, term, (1 + ln(tf)) * idf AS w FROM {src} JOIN idf USING (term)), {name} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}2)"
_VALUES = ", ".join("('" + g + f"', {p}, {n}, '" + line.replace("'", "''") + f"', '{t}')" for g, p, n, line, t in _DOT)
_NODE, _EDGE = dot.NODE.replace("'", "''"), dot.EDGE.replace("'", "''")
_INNER = "CASE WHEN trim(lab) LIKE '(%' AND trim(lab) LIKE '%)' THEN substring(trim(lab), 2, length(trim(lab)) - 2) ELSE trim(lab) END"
_NODES = f"""WITH li AS (SELECT * FROM (VALUES {_VALUES}) v(graph, part, n, line, default_type)), nl AS (SELECT graph, part, n, regexp_extract(line, '{_NODE}', 1) AS id, regexp_extract(line, '{_NODE}', 2) AS lab FROM li WHERE regexp_matches(line, '{_NODE}')),
ni AS (SELECT graph, id, row_number() OVER (PARTITION BY graph, id ORDER BY part DESC, n DESC) AS nth, {_INNER} AS x FROM nl), np AS (SELECT graph, id, coalesce(nullif(trim(regexp_extract(x, '^([^,]*)', 1)), ''), 'UNKNOWN') AS type,
  coalesce(nullif(trim(regexp_extract(x, '^[^,]*,([^,]*)', 1)), ''), trim(regexp_extract(x, '^[^,]*,[^,]*,(.*)$', 1))) AS code FROM ni WHERE nth = 1),
no AS (SELECT graph, id, type, coalesce(nullif(code, ''), type) AS code, row_number() OVER (PARTITION BY graph ORDER BY NOT regexp_full_match(id, '\\d+'), lpad(id, 20, '0')) AS rank FROM np)"""
ORACLES = {
    "q_cosine_topk": _PAIRS + "SELECT query, record_id, label, round(cosine, 6) AS cosine, rank::INTEGER AS rank FROM ne",
    "q_demo_scores": _PAIRS + "SELECT query, record_id, round(lexical, 6) AS lexical, round(syntactic, 6) AS syntactic, round(mixed, 6) AS mixed FROM mi",
    "q_bank_contamination": _PAIRS + "SELECT query, count(*) AS n, round(max(lexical), 6) AS most FROM mi WHERE lexical >= 0.8::DOUBLE GROUP BY query",
    "q_demo_retrieval": _PAIRS + """, rk AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY mixed DESC, cosine DESC, record_id) AS nth, least(5, greatest(1, round_even(5 * greatest(0.5::DOUBLE, least(0.75::DOUBLE, p)), 0)::INT)) AS vk FROM mi),
ch AS (SELECT *, nth <= CASE WHEN label = 1 THEN vk ELSE 5 - vk END AS chosen FROM rk), sh AS (SELECT *, 5 - sum(chosen::INT) OVER (PARTITION BY query) AS short FROM ch),
po AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, CASE WHEN chosen THEN 2 * nth - label ELSE (1 - label) * 1000 + nth END) AS position FROM sh WHERE chosen OR nth <= short)
SELECT query, position::INTEGER AS position, record_id, label, round(mixed, 6) AS mixed, round(cosine, 6) AS cosine FROM po WHERE position <= 5""",
    "q_tfidf_scores": _PAIRS + ", bd AS (SELECT record_id AS id, list_filter(string_split_regex(tokenized_text, '\\s+'), lambda t: t <> '') AS tk FROM bk WHERE tokenized_text IS NOT NULL), qd AS (SELECT query AS id, list_filter(toks, lambda t: t <> '') AS tk FROM qu), "
    + _TERMS("bt", "bd") + ", " + _TERMS("qt", "qd") + ", idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM bd)) / (1.0::DOUBLE + count(*))) + 1 AS idf FROM bt GROUP BY term HAVING count(*) >= 2), " + _UNIT("bw", "bt") + ", " + _UNIT("qw", "qt")
    + """, sc AS (SELECT qw.id AS query, bw.id AS record_id, round(sum(qw.w * bw.w), 9) AS score FROM qw JOIN bw USING (term) GROUP BY ALL)
SELECT query, record_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, record_id)::INTEGER AS rank, round(score, 6) AS score FROM sc QUALIFY rank <= 5""",
    "q_dot_nodes": _NODES + " SELECT graph, id, type, code, rank::INTEGER AS rank FROM no WHERE rank <= 72",
    "q_dot_edges": _NODES + f""", el AS (SELECT graph, regexp_extract(line, '{_EDGE}', 1) AS source, regexp_extract(line, '{_EDGE}', 2) AS target, regexp_extract(regexp_extract(line, '{_EDGE}', 3), 'label\\s*=\\s*"([^"]+)"', 1) AS lab, default_type FROM li WHERE regexp_matches(line, '{_EDGE}') AND NOT regexp_matches(line, '{_NODE}')),
en AS (SELECT *, string_split(upper(regexp_replace(trim(lab), '[- ]', '_', 'g')), ':')[1] AS name FROM el)
SELECT DISTINCT graph, source, target, CASE WHEN lab = '' THEN default_type WHEN name = '' THEN default_type ELSE coalesce(MAP {{{", ".join(f"'{a}': '{b}'" for a, b in dot.ALIASES.items())}}}[name], name) END AS type FROM en
WHERE (graph, source) IN (SELECT (graph, id) FROM no) AND (graph, target) IN (SELECT (graph, id) FROM no)""",
}
