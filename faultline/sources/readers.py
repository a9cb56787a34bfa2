"""Readers of raw function records in many formats, brought to one form.

Every reader gives ``source_path, stem, parent, index, split_hint, row``: the
file, its name and folder, the place of the record in the file (counted over
all, also those dropped later), what the file tells of the split, and the
fields as a map from names to texts.  :func:`canonical` makes records of them.
Files are read in parallel; numbering needs the counts of a file's blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from faultline.functions import text as X

# Names of fields and of labels, in the order in which they are tried.
PROJECT_FIELDS = ("project", "project_before", "repo", "repository")
CWE_FIELDS = ("cwe_id", "cwe", "CWE ID", "cweID")
CODE_FIELDS = ("code", "func", "functionSource", "source", "raw_code", "func_before", "before")
LABEL_FIELDS = ("target", "label", "vul", "is_vul", "is_vulnerable")
TRUE, FALSE = ("1", "true", "yes", "vulnerable", "positive"), ("0", "false", "no", "non-vulnerable", "benign", "negative")
PATH_TRUE, PATH_FALSE = ("1", "vulnerable", "positive", "bad"), ("0", "non-vulnerable", "benign", "negative", "good")
SOURCE_SUFFIXES = ("c", "cc", "cpp", "cxx", "h", "hpp")
WRAPPERS = ("data", "records", "items")
_ROW = "map<string,string>"
_STRICT = {"allowSingleQuotes": "false"}


def label_of(value: Column) -> Column:
    """1 or 0 of a text in one of the known notations, else null."""
    text = F.lower(X.strip(value.cast("string")))
    return F.when(text.isin(*TRUE), 1).when(text.isin(*FALSE), 0)


def first_of(row: Column, names: tuple[str, ...], default: Column | None = None) -> Column:
    """The first field of ``names`` that isn't blank, stripped; else ``default`` ('' if none is given)."""
    tried = (F.nullif(X.strip(F.try_element_at(row, F.lit(n))), F.lit("")) for n in names)
    return F.coalesce(*tried, default if default is not None else F.lit(""))


def code_of(row: Column) -> Column:
    """The first field of code that isn't empty once it is normalised; '' if none."""
    return F.coalesce(*(F.nullif(X.normalize_code(F.try_element_at(row, F.lit(n))), F.lit("")) for n in CODE_FIELDS), F.lit(""))


def label_of_path(path: Column) -> Column:
    """The label that the deepest telling folder (or the file's name) says, else the name's ending _1, -1, _0 or -0, else null."""
    parts = F.reverse(F.split(F.lower(path), "/"))
    known = F.filter(F.transform(parts, lambda p: F.when(p.isin(*PATH_TRUE), 1).when(p.isin(*PATH_FALSE), 0)), lambda x: x.isNotNull())
    ending = F.regexp_extract(F.lower(path), r"[_-]([01])(?:\.[^./]*)?$", 1)
    return F.coalesce(F.get(known, 0), F.when(ending != "", ending.cast("int")))


def _place(df: DataFrame) -> DataFrame:
    path = F.regexp_replace(F.col("source_path"), r"^[a-z]+:/*(?=/)", "")
    name = F.element_at(F.split(path, "/"), -1)
    return df.withColumns({"source_path": path, "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "parent": F.coalesce(F.get(F.reverse(F.split(path, "/")), 1), F.lit(""))})


def _numbered(rows: DataFrame) -> DataFrame:
    """``index``: a line's place in its file, from its place in its block and the lines of the blocks before."""
    rows = rows.withColumn("_m", F.monotonically_increasing_id())
    blocks = rows.groupBy("source_path", "_block").agg(F.min("_m").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("source_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(blocks, ["source_path", "_block"]).withColumn("index", F.col("_before") + F.col("_m") - F.col("_first")).drop("_m", "_first", "_n", "_before", "_block")


def json_lines(spark: SparkSession, path: str | list[str], split_hint: str | None = None) -> DataFrame:
    """One object a line; blank and malformed lines are no records but count as lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_block"))
    rows = _numbered(lines).withColumn("row", F.from_json(X.strip(F.col("value")), _ROW, _STRICT)).where("row is not null").drop("value")
    return _place(rows).withColumn("split_hint", F.lit(split_hint) if split_hint else F.coalesce(F.try_element_at("row", F.lit("split")), F.lit("")))


def json_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A file that is one list of objects, or an object that holds one as data, records or items; other files give none."""
    files = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("source_path"))
    wrapped = [F.from_json(F.get_json_object("value", f"$.{w}"), "array<string>", _STRICT) for w in WRAPPERS]
    items = F.when(X.strip(F.col("value")).startswith("["), F.from_json("value", "array<string>", _STRICT)).otherwise(F.coalesce(*wrapped))
    rows = files.select("source_path", F.posexplode(items).alias("index", "item"))
    rows = rows.select("source_path", F.col("index").cast("long").alias("index"), F.from_json("item", _ROW, _STRICT).alias("row")).where("row is not null")
    return _place(rows).withColumn("split_hint", F.coalesce(F.try_element_at("row", F.lit("split")), F.lit("")))


def _as_map(df: DataFrame, names: list[str]) -> Column:
    return F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"`{n}`").cast("string"))))


def delimited(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """A table with a header; quoted fields may hold line ends and doubled quotes, of any length."""
    table = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep).option("maxCharsPerColumn", -1).csv(path)
    rows = table.select(_as_map(table, table.columns).alias("row"), F.col("_metadata.file_path").alias("source_path"), F.lit(0).alias("_block"))
    return _place(_numbered(rows)).withColumn("split_hint", F.coalesce(F.try_element_at("row", F.lit("split")), F.lit("")))


def parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Parquet files; the split is what their names tell (train, validation: val, test)."""
    table = spark.read.parquet(path) if isinstance(path, str) else spark.read.parquet(*path)
    rows = table.select(_as_map(table, table.columns).alias("row"), F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.row_index").alias("index"))
    stem = F.col("stem")
    return _place(rows).withColumn("split_hint", F.when(stem.contains("train"), "train").when(stem.contains("validation"), "val").when(stem.contains("test"), "test").otherwise(""))


def split_parquet(spark: SparkSession, paths: dict[str, str], dataset: str) -> DataFrame:
    """Records of one file for each split, numbered on from file to file in the order given."""
    offset, parts = 0, []
    for split, path in paths.items():
        rows = parquet(spark, path)
        parts.append(rows.withColumns({"index": F.col("index") + offset, "split_hint": F.lit(split), "record_id": F.concat(F.lit(f"{dataset}-"), F.col("index") + offset)}))
        offset += spark.read.parquet(path).count()  # from the file's footer
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Source files under a folder, labelled by their path; bytes that are no UTF-8 are dropped."""
    glob = "*.{" + ",".join((*SOURCE_SUFFIXES, *(s.upper() for s in SOURCE_SUFFIXES))) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    rows = _place(files.select(F.col("path").alias("source_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("_text"), F.lit(0).cast("long").alias("index"), F.lit("").alias("split_hint")))
    base = F.regexp_replace(F.lit(root), "/*$", "/")
    inside = F.when(F.col("source_path").startswith(base), F.expr("substring(source_path, length(_base) + 1)")).otherwise(F.col("source_path"))
    rows = rows.withColumn("_base", base).withColumn("record_key", F.sha2(inside, 256)).drop("_base")
    label = label_of_path(F.col("source_path")).cast("string")
    clean = F.replace("_text", F.lit("\ufffd"), F.lit(""))
    return rows.withColumn("row", F.create_map(F.lit("code"), clean, F.lit("label"), label)).drop("_text")


def canonical(rows: DataFrame, dataset: str) -> DataFrame:
    """``record_id, dataset, project, label, code, commit_id, cwe_id, source_path, code_hash, split, source_row, hash, size, source_format`` of what a reader gives.

    Records with empty code or without a label are dropped.  The id is that of
    the reader, else the record's own, else made of file and place.  A project
    that isn't told is the file's folder.
    """
    row = F.col("row")
    made = F.concat(F.lit(f"{dataset}-"), F.col("stem"), F.lit("-"), F.col("index"))
    given = [F.col("record_id")] if "record_id" in rows.columns else [F.concat(F.lit(f"{dataset}-"), F.col("record_key"))] if "record_key" in rows.columns else [F.nullif(F.try_element_at(row, F.lit("record_id")), F.lit(""))]
    field = lambda n: F.coalesce(F.try_element_at(row, F.lit(n)), F.lit(""))
    out = rows.select(
        F.coalesce(*given, made).alias("record_id"),
        F.lit(dataset).alias("dataset"),
        first_of(row, PROJECT_FIELDS, F.col("parent")).alias("project"),
        label_of(first_of(row, LABEL_FIELDS)).alias("label"),
        code_of(row).alias("code"),
        field("commit_id").alias("commit_id"),
        first_of(row, CWE_FIELDS).alias("cwe_id"),
        "source_path",
        F.nullif("split_hint", F.lit("")).alias("split"),
        F.col("index").alias("source_row"),
        F.try_element_at(row, F.lit("hash")).try_cast("long").alias("hash"),
        F.try_element_at(row, F.lit("size")).try_cast("long").alias("size"),
        F.try_element_at(row, F.lit("source_format")).alias("source_format"),
    )
    out = out.where("code <> '' and label is not null")
    return out.withColumn("code_hash", F.sha2("code", 256))


def mixed_tree(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Records of all files under a folder, each read by its suffix; of records with one id the first by path and place is kept."""
    names = _files(spark, root)
    kinds = {".json": json_list, ".jsonl": json_lines, ".csv": delimited, ".tsv": lambda s, p: delimited(s, p, "\t"), ".parquet": parquet}
    parts = []
    for suffix, read in kinds.items():
        for path in (n for n in names if n.lower().endswith(suffix)):  # tables may differ in their columns
            parts.append(canonical(read(spark, path), dataset).withColumn("_order", F.lit(0)))
    if any(n.lower().rsplit(".", 1)[-1] in SOURCE_SUFFIXES for n in names):
        parts.append(canonical(source_tree(spark, root), dataset).withColumn("_order", F.lit(1)))
    if not parts:
        raise ValueError(f"no file to read under {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    columns = [c for c in out.columns if c not in ("record_id", "_order")]
    return out.groupBy("record_id").agg(F.min_by(F.struct(*columns), F.struct("_order", "source_path", "source_row")).alias("r")).select("record_id", "r.*")


def _files(spark: SparkSession, root: str) -> list[str]:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def preferred(spark: SparkSession, paths: dict[str, str], table: str, dataset: str) -> DataFrame:
    """Records of the Parquet files of all splits if all are there, else of the table."""
    if all(exists(spark, p) for p in paths.values()):
        return canonical(split_parquet(spark, paths, dataset), dataset)
    return canonical(delimited(spark, table), dataset)


def required(df: DataFrame, names: list[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError("missing columns: " + ", ".join(missing))
    return df


READERS = {"json_list": json_list, "json_lines": json_lines, "csv": delimited, "parquet": parquet, "source_tree": source_tree}


def read(spark: SparkSession, kind: str, path: str, dataset: str) -> DataFrame:
    """Records read by a reader's name; an unknown one is an error."""
    if kind not in READERS:
        raise ValueError(f"unknown kind of source: {kind}; known are {', '.join(READERS)}")
    return canonical(READERS[kind](spark, path), dataset)
