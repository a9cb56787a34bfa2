"""Queries over raw records: canonical form, labels, splits, groups, samples, answers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions import text as X
from faultline.operators import responses, runs
from faultline.plans.code import _NORM, _STRIP
from faultline.plans.reports import _NAME
from faultline.plans.scores import _LATEST, latest
from faultline.sources import readers
from faultline.workspace import spread, table


def q_canonical_records(spark, d):
    """Delivered rows in canonical form: code normalised and hashed, fields stripped, label read; rows without code or label dropped."""
    rows = table(spark, d, "function_records")
    row = F.create_map(*(x for n in ("project", "label", "code", "cwe_id", "commit_id", "hash", "size", "source_format") for x in (F.lit(n), F.col(n).cast("string"))))
    rows = rows.select("row_id", "record_id", F.col("source_path"), F.lit("").alias("stem"), F.lit("").alias("parent"), F.col("row_id").alias("index"), F.coalesce(runs.split_name(F.col("split")), F.lit("")).alias("split_hint"), row.alias("row"))
    return readers.canonical(spread(rows), "all").select(F.col("source_row").alias("row_id"), "record_id", "project", "label", "cwe_id", "split", "code_hash")


def q_label_parse(spark, d):
    """How each notation of a label is read."""
    said = table(spark, d, "predictions").select(F.col("llm_label").alias("said")).distinct().where("said is not null")
    return said.select("said", readers.label_of(F.col("said")).alias("record_label"), responses.label_of(F.col("said")).alias("answer_label"))


def q_label_from_path(spark, d):
    """Labels that paths tell, counted; the stored paths tell none, so folders and endings are put to them."""
    rows = table(spark, d, "function_records").where("source_path is not null").select("source_path").distinct()
    rows = rows.select(readers.label_of_path(F.concat(F.lit("x/"), F.when(F.char_length("source_path") % 3 == 0, "Bad/").when(F.char_length("source_path") % 3 == 1, "good/").otherwise("src/"), "source_path", F.when(F.char_length("source_path") % 2 == 0, "_1.c").otherwise("-0.c"))).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def q_dup_groups(spark, d):
    """Normalised texts that stand in more than one row: rows, datasets and labels of each."""
    rows = spread(table(spark, d, "function_records").select("row_id", "code", "dataset", "label")).withColumn("code_hash", F.sha2(X.normalize_code(F.col("code")), 256))
    groups = rows.where(F.col("code").isNotNull()).groupBy("code_hash").agg(F.count("*").alias("n_rows"), F.countDistinct("dataset").alias("n_datasets"), F.countDistinct("label").alias("n_labels"))
    return groups.where("n_rows > 1")


def q_split_summary(spark, d):
    """Rows, positives, negatives and different code hashes of every split."""
    rows = runs.with_split(table(spark, d, "function_records"))
    return rows.groupBy("split_name").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"), F.countDistinct("code_hash").alias("n_hashes"))


def q_split_assign(spark, d):
    """A split for every record by its code hash alone: eight tenths train, one each val and test; equal code is never parted."""
    rows = table(spark, d, "function_records").where("code_hash is not null")
    tenth = F.pmod(F.conv(F.substring("code_hash", 1, 8), 16, 10).cast("long"), F.lit(10))
    name = F.when(tenth == 0, "test").when(tenth == 1, "val").otherwise("train")
    return rows.groupBy(name.alias("split_name"), "dataset").agg(F.count("*").alias("n_rows"), F.countDistinct("code_hash").alias("n_groups"))


def q_split_strategy(spark, d):
    """For each dataset whether its own splits can be used (every row has one) or new ones must be drawn by groups."""
    rows = runs.with_split(table(spark, d, "function_records"))
    return rows.groupBy("dataset").agg(F.count("*").alias("n_rows"), F.count_if(F.col("split_name").isNull()).alias("n_without"), F.when(F.count_if(F.col("split_name").isNull()) == 0, "official").otherwise("groups").alias("strategy"))


def q_split_join(spark, d):
    """Feature rows put to the split of their record; rows without a known split are dropped."""
    splits = runs.with_split(table(spark, d, "function_records").where("record_id is not null")).groupBy("record_id").agg(F.min_by("split_name", "row_id").alias("split_name"))
    rows = table(spark, d, "feature_store").select("record_id", "label").join(splits, "record_id").where("split_name is not null")
    return rows.groupBy("split_name").agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("positive"))


def sample_per(df, by: str, key: str, most: int, seed: str = "42"):
    """At most ``most`` rows of every value of ``by``: those of the smallest digests of ``key``. Cut before the shuffle, so no value's rows are gathered."""
    w = Window.partitionBy(by).orderBy(F.sha2(F.concat(F.lit(seed), F.col(key)), 256), key)
    return df.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= most).drop("_nth")


def q_reservoir_sample(spark, d, most: int = 40):
    """At most 40 demonstrations of each label."""
    return sample_per(table(spark, d, "demo_bank").where("label is not null").select("record_id", "label"), "label", "record_id", most)


_CASES = (
    (1, 'FINAL_JSON: {"label": "Vulnerable", "confidence": 0.9, "reason": "unchecked copy", "vulnerable_lines": "3-5; 9", "sink_or_api": "memcpy"}'),
    (2, 'The call is checked. {"note": 1} then {"label": "safe", "confidence": 1.7, "reason": "bounded", "vulnerable_lines": [" 4 ", ""]} end'),
    (3, '{"label": "non_vulnerable", "confidence": "high", "reason": "x"}'),
    (4, '{"label": "1", "confidence": 0.4, "reason": ""}'),
    (5, "confidence: 0.75\nVerdict: safe"),
    (6, "It is hard to say.\nThe function looks non-vulnerable to me. reason: length is checked first"),
    (7, ""),
    (8, 'FINAL_JSON: {"label": "maybe", "confidence": 0.5, "reason": "unclear"}'),
    (9, "no judgement here"),
    (10, '{"label": "Vulnerable", "confidence": 0.2, {"label": "0", "confidence": -3, "reason": "inner {brace}"}'),
    (11, None),
)


def q_parse_response(spark, d):
    """How answers of many forms are read, with the evidence check."""
    rows = spark.createDataFrame(list(_CASES), "case int, answer string").select("case", responses.parse(F.col("answer")).alias("r"))
    label, status = responses.verified(F.col("r.label"), F.col("r.vulnerable_lines"), F.col("r.sink_or_api"), F.col("r.missing_guard"))
    return rows.select("case", "r.label", F.round("r.confidence", 6).alias("confidence"), "r.reason", F.array_join("r.vulnerable_lines", "|").alias("lines"), "r.error", label.alias("verified_label"), F.when(F.col("r.label").isNotNull(), status).alias("status"))


def q_answer_labels(spark, d):
    """Stored labels of answers read to 0 and 1, their confidence cut to [0, 1]: answers, readable ones, positives and mean confidence."""
    rows = latest(spark, d).where("llm_label is not null")
    said, told = responses.label_of(F.col("llm_label")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nullif("llm_confidence", F.lit(float("nan")))))
    return rows.groupBy("dataset").agg(F.count("*").alias("n"), F.count(said).alias("n_read"), F.count_if(said == 1).alias("n_positive"), F.round(F.avg(told), 6).alias("mean_confidence"))


def q_cache_join(spark, d):
    """Prompts whose key an earlier attempt has already answered, counted by dataset: hits and misses."""
    rows = table(spark, d, "predictions").where("record_id is not null")
    prompts = latest(spark, d).select("dataset", responses.cache_key(F.lit("model"), F.col("record_id")).alias("key"))
    again = rows.groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1").select(responses.cache_key(F.lit("model"), F.col("record_id")).alias("key"), "n")
    hits, misses = runs.cached(prompts, again, "key")
    both = hits.select("dataset", F.lit(1).alias("hit")).unionByName(misses.select("dataset", F.lit(0).alias("hit")))
    return both.groupBy("dataset").agg(F.sum("hit").alias("hits"), F.sum(1 - F.col("hit")).alias("misses"))


def q_json_props(spark, d):
    """Fields of the events' JSON, read with their types; what can't be read is null."""
    props = F.from_json("props", "map<string,string>")
    rows = table(spark, d, "events").select("event_type", props.alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p").alias("n_objects"), F.sum(F.coalesce(F.size("p"), F.lit(0))).alias("n_fields"))


QUERIES = {
    f.__name__: f
    for f in (
        q_canonical_records, q_label_parse, q_label_from_path, q_dup_groups, q_split_summary, q_split_assign, q_split_strategy, q_split_join, q_reservoir_sample, q_parse_response, q_answer_labels, q_cache_join, q_json_props,
    )
}
_T = "('1', 'true', 'yes', 'vulnerable', 'positive')"
_F = "('0', 'false', 'no', 'non-vulnerable', 'benign', 'negative')"
_SAID = "replace(lower(" + _STRIP("said") + "), '_', '-')"
_READ = f"CASE WHEN {_SAID} IN ('vulnerable', '1') THEN 1 WHEN {_SAID} IN ('non-vulnerable', 'not vulnerable', 'non vulnerable', 'safe', 'benign', '0') THEN 0 END"
_TENTH = "(CAST(concat('0x', substr(code_hash, 1, 8)) AS BIGINT) % 10)"
ORACLES = {
    "q_canonical_records": f"""WITH n AS (SELECT *, {_NORM('code')} AS txt FROM function_records WHERE code IS NOT NULL AND label IS NOT NULL)
SELECT row_id, coalesce(nullif(record_id, ''), concat('all--', row_id)) AS record_id, coalesce({_STRIP('project')}, '') AS project, label, coalesce({_STRIP('cwe_id')}, '') AS cwe_id, {_NAME} AS split, sha256(txt) AS code_hash FROM n WHERE txt <> ''""",
    "q_label_parse": f"SELECT DISTINCT llm_label AS said, CASE WHEN lower({_STRIP('llm_label')}) IN {_T} THEN 1 WHEN lower({_STRIP('llm_label')}) IN {_F} THEN 0 END AS record_label, {_READ.replace('said', 'llm_label')} AS answer_label FROM predictions WHERE llm_label IS NOT NULL",
    "q_label_from_path": """WITH p AS (SELECT DISTINCT source_path FROM function_records WHERE source_path IS NOT NULL),
w AS (SELECT lower(concat('x/', CASE WHEN length(source_path) % 3 = 0 THEN 'Bad/' WHEN length(source_path) % 3 = 1 THEN 'good/' ELSE 'src/' END, source_path, CASE WHEN length(source_path) % 2 = 0 THEN '_1.c' ELSE '-0.c' END)) AS path FROM p),
k AS (SELECT path, list_filter(list_transform(list_reverse(string_split(path, '/')), lambda x: CASE WHEN x IN ('1', 'vulnerable', 'positive', 'bad') THEN 1 WHEN x IN ('0', 'non-vulnerable', 'benign', 'negative', 'good') THEN 0 END), lambda x: x IS NOT NULL)[1] AS known FROM w)
SELECT coalesce(known, CASE WHEN path LIKE '%\\_1.c' ESCAPE '\\' THEN 1 ELSE 0 END) AS label, count(*) AS n FROM k GROUP BY 1""",
    "q_dup_groups": f"SELECT sha256({_NORM('code')}) AS code_hash, count(*) AS n_rows, count(DISTINCT dataset) AS n_datasets, count(DISTINCT label) AS n_labels FROM function_records WHERE code IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "q_split_summary": f"SELECT {_NAME} AS split_name, count(*) AS n_rows, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative, count(DISTINCT code_hash) AS n_hashes FROM function_records GROUP BY 1",
    "q_split_assign": f"SELECT CASE {_TENTH} WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split_name, dataset, count(*) AS n_rows, count(DISTINCT code_hash) AS n_groups FROM function_records WHERE code_hash IS NOT NULL GROUP BY ALL",
    "q_split_strategy": f"SELECT dataset, count(*) AS n_rows, count(*) FILTER (({_NAME}) IS NULL) AS n_without, CASE WHEN count(*) FILTER (({_NAME}) IS NULL) = 0 THEN 'official' ELSE 'groups' END AS strategy FROM function_records GROUP BY dataset",
    "q_split_join": f"""WITH sp AS (SELECT record_id, nullif(arg_min(coalesce({_NAME}, ''), row_id), '') AS split_name FROM function_records WHERE record_id IS NOT NULL GROUP BY record_id)
SELECT split_name, count(*) AS n_rows, count(*) FILTER (label = 1) AS positive FROM feature_store JOIN sp USING (record_id) WHERE split_name IS NOT NULL GROUP BY split_name""",
    "q_reservoir_sample": "SELECT record_id, label FROM (SELECT record_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256(concat('42', record_id)), record_id) AS nth FROM demo_bank WHERE label IS NOT NULL) WHERE nth <= 40",
    "q_answer_labels": _LATEST + f", a AS (SELECT dataset, llm_label AS said, CASE WHEN CAST(llm_confidence AS VARCHAR) <> 'nan' THEN llm_confidence END AS told FROM l WHERE llm_label IS NOT NULL) SELECT dataset, count(*) AS n, count({_READ}) AS n_read, count(*) FILTER (({_READ}) = 1) AS n_positive, round(avg(greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(told, 0)))), 6) AS mean_confidence FROM a GROUP BY dataset",
    "q_cache_join": _LATEST + ", g AS (SELECT record_id FROM predictions GROUP BY record_id HAVING count(*) > 1) SELECT dataset, count(g.record_id) AS hits, count(*) - count(g.record_id) AS misses FROM l LEFT JOIN g USING (record_id) GROUP BY dataset",
    "q_json_props": "SELECT event_type, count(*) AS n, count(*) FILTER (json_valid(props)) AS n_objects, coalesce(sum(len(json_keys(props))), 0)::BIGINT AS n_fields FROM events GROUP BY event_type",
}
