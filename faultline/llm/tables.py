"""The training-data queries: name -> (spark, folder of tables) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import mixing, neighbours, overlap, records, spam, splits, tokens
from faultline.workspace import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return records.copies(table(spark, d, "function_records"), "row_id", "code")


def p1_copy_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every group of copies: its first row and how many rows it has."""
    return records.copy_groups(table(spark, d, "function_records"), "row_id", "code").select("row_id_first", "n_copies")


def _members(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "function_records").withColumn("split_name", F.lower(F.regexp_replace("split", r"(?U)^\s+|\s+$", "")))
    return overlap.classes(rows, "record_id", "code", "split", ("split_name", "dataset"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members = _members(spark, d)
    return overlap.record_pairs(members, overlap.class_links(members))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation records that also stand in training, counted per split and dataset."""
    members = _members(spark, d)
    members = members.withColumn("split_name", F.when(F.col("split_name") == "test", "test").otherwise("val"))
    return overlap.overlap_report(members, overlap.class_links(members), ("split_name", "dataset"))


def p3_containment(spark: SparkSession, d: str) -> DataFrame:
    """Linked texts of training and evaluation, each by its first record, with the share of the evaluation text's 5-grams that the training text holds."""
    members = _members(spark, d)
    return overlap.containments(members, overlap.class_links(members))


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(table(spark, d, "feature_store"), "record_id", "semantic_embeddings")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(_nearest(spark, d))


def p4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest records of every record, with their cosine."""
    return _nearest(spark, d)


def p4_exact(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest records of every record, all compared with all in blocks: what the approximate search is measured by."""
    return neighbours.nearest(table(spark, d, "feature_store"), "record_id", "semantic_embeddings", settings=neighbours.Settings(exact=True)).select("id", "neighbour", "rank", F.round("cosine", 6).alias("cosine"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = splits.spelling_pairs(table(spark, d, "function_records"), "project")
    return pairs.select(F.col("value_a").alias("project_a"), F.col("value_b").alias("project_b"))


def p5_assignment(spark: SparkSession, d: str) -> DataFrame:
    records_ = table(spark, d, "function_records").select("row_id", "record_id", "project", "label")
    return splits.assign_splits(records_, table(spark, d, "split_targets"), "project", "label", ["record_id"])


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Share of rows and rate of positive labels that each split reached."""
    done = p5_assignment(spark, d)
    sums = done.groupBy("split_name").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_positive"))
    total = sums.agg(F.sum("n_rows").alias("total"))
    wanted = table(spark, d, "split_targets")
    sums = wanted.join(sums, "split_name", "left").crossJoin(F.broadcast(total))
    return sums.select("split_name", "share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.round(F.try_divide("n_rows", "total"), 6).alias("share_reached"), F.round(F.try_divide("n_positive", "n_rows"), 6).alias("positive_rate"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """For every document whether its ids, decoded, give its text again (null and empty texts: the empty text)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = tokens.decode(tokens.encode(docs, "doc_id", "text"), "ids", "decoded").select("doc_id", "decoded", F.size("ids").alias("n_ids"))
    return docs.join(back, "doc_id").select("doc_id", "n_ids", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, source, n`` of the documents of target sources, n being their tokens of byte_bpe_50k."""
    goals = table(spark, d, "mix_targets").select("source").distinct()  # Spark broadcasts it where its measured size allows
    docs = table(spark, d, "documents").select("doc_id", "source", "text").join(goals, "source", "left_semi")
    return materialize(tokens.token_counts(docs, "text", "n"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[1].where("not reachable").select("source")


def p7_uses(spark: SparkSession, d: str) -> DataFrame:
    """The collection: how often each document is used."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the sources really reach."""
    return mixing.mix(_sized(spark, d), table(spark, d, "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"), "doc_id", "text").where("score >= 0.5").select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score and share of runs of every page."""
    return spam.spam_pages(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_copy_counts, p3_found, p3_report, p3_containment, p4_found, p4_neighbours, p4_exact, p5_found, p5_assignment, p5_report, p6_ids, p6_round_trip, p7_found, p7_uses, p7_report, p8_found, p8_scores)}


_P1 = r"""
WITH cut AS (
  SELECT row_id, regexp_extract_all(code, '\{[^A-Za-z0-9{}]*\.[^{}]*\}') AS inner_, string_split_regex(code, '\{[^A-Za-z0-9{}]*\.[^{}]*\}') AS outer_
  FROM function_records WHERE code IS NOT NULL),
trees AS (
  SELECT row_id, array_to_string(list_transform(range(1, len(outer_) + 1), lambda i: concat(
    lower(regexp_replace(outer_[i], '[^A-Za-z0-9]+', '', 'g')),
    coalesce(array_to_string(list_sort(list_transform(string_split_regex(inner_[i], ',[^A-Za-z0-9]*\.'), lambda e: lower(regexp_replace(e, '[^A-Za-z0-9]+', '', 'g')))), ''), ''))), '') AS tree
  FROM cut),
groups AS (SELECT tree, min(row_id) AS row_id_first, count(*) AS n_copies FROM trees WHERE tree <> '' GROUP BY tree HAVING count(*) > 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _P1 + "SELECT row_id_first, row_id AS row_id_copy FROM trees JOIN groups USING (tree) WHERE row_id <> row_id_first",
        "p1_copy_counts": _P1 + "SELECT row_id_first, n_copies FROM groups",
        "p4_exact": """
WITH u AS (SELECT DISTINCT record_id, list_transform(semantic_embeddings, lambda x: x::DOUBLE) AS v FROM feature_store
  WHERE record_id IS NOT NULL AND len(semantic_embeddings) = 64 AND len(list_filter(semantic_embeddings, lambda x: x IS NULL OR CAST(x AS VARCHAR) = 'nan')) = 0 AND list_max(list_transform(semantic_embeddings, lambda x: abs(x))) > 0),
c AS (SELECT a.record_id AS id, b.record_id AS neighbour, CASE WHEN a.v = b.v THEN 1.0::DOUBLE ELSE round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 9) END AS s FROM u a JOIN u b ON a.record_id <> b.record_id),
r AS (SELECT id, neighbour, s, row_number() OVER (PARTITION BY id ORDER BY s DESC, neighbour) AS rank FROM c)
SELECT id, neighbour, rank::INTEGER AS rank, round(s, 6) AS cosine FROM r WHERE rank <= 5""",
        "p5_found": r"""
WITH v AS (SELECT DISTINCT project AS value, lower(regexp_replace(project, '[^A-Za-z0-9]+', '', 'g')) AS name FROM function_records WHERE project <> '')
SELECT a.value AS project_a, b.value AS project_b FROM v a JOIN v b ON a.name = b.name AND a.value < b.value WHERE a.name <> ''""",
    }
