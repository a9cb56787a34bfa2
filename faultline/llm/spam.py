"""Pages of repeated keywords, lists of links or product tags instead of writing.

Content and link features of each page, computed inside the JVM; weak labels of
pages that are clearly made of runs or clearly not, told by counting the words
in runs; bagged decision trees trained on them, which see none of these counts;
and smoothing of each page's prediction by the rate of spam on the hosts it
links to.  The smoothed score alone decides.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.workspace import materialize, spread

#: Labelled pages of each class that the trees are trained on, at most.
TRAIN_ROWS = 100_000
#: Pages of a host that weigh as much as the rate of all pages.
HOST_PRIOR = 5.0
#: How far the hosts' rate may move a page, at most.
HOST_WEIGHT = 0.3

_WORD = r"[\p{L}\p{M}\p{N}_]++"
_HOST = r"(?:[\p{L}\p{M}\p{N}-]++\.)++\p{L}[\p{L}\p{M}]++"
_URL = rf"(?:https?://\S++|{_HOST}/\S*+)"
#: A link with its text: in markup, or up to five words before a bare address.
_LINK = (
    r"(?iu)<a\s[^>]*+>[^<]*+</a>|\[url=[^\]]*+\][^\[]*+\[/url\]|\[[^\]\n]*+\]\([^)\s]*+\)"
    rf"|(?<![\p{{L}}\p{{M}}\p{{N}}_.-])(?:[\p{{L}}\p{{M}}\p{{N}}_.-]++[ \t]++){{0,5}}(?:(?:->|=>|@|:)[ \t]*+)?{_URL}"
)
#: A product tag: a kind, a number and what follows up to the next separator; a kind and a value; or a hash tag.
_TAG = r"(?<![\p{L}\p{N}_.])(?:\p{L}{2,8}:\p{L}?\d{4,}+(?:[ \t]++[^\s;|,]++){1,9}|\p{L}{2,8}[:=][\p{L}\p{M}\p{N}_-]++(?=[\s;,|]|$)|#\p{L}[\p{L}\p{M}\p{N}_]*+)"
#: A product's property and value; counts as a tag where the property is given again and again.
_PAIR = r"(?<![\p{L}\p{N}_.])\p{L}{2,8}[ \t]++=[ \t]++[\p{L}\p{M}\p{N}_-]++(?=[\s;,|]|$)"
_TABLE = r"(?m)^[ \t]*+\|.*$"
_LINE = r"[\n\r\u0085\u2028\u2029]+"
_BREAK = r"[|;,•·>]++|\s[-*/]++(?:\s|$)|\. |。"
_PLAIN = r"^[\p{L}\p{M}\p{N} \t._'’-]*[\p{L}\p{M}\p{N}]$"
_LONG_HAN = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{6}"
#: Words that make a short piece of text part of a sentence rather than a keyword.
FUNCTION_WORDS = "the a an of in on at to is are was be if when not before after without der die das ein eine im dem den le la les un une dans el los una en".split()
#: More words of sentences, in more languages, that a piece of more words than a keyword is told by.
SENTENCE_WORDS = (
    "and or but that this these it its i we you they has have had were been can could should would will may must do does did by from as than then so which who "
    "und oder aber nicht ist sind war wird mit von für auf bei zu zum zur des ich wir sie es er dass wenn als et ou mais que qui est sont du de à au aux pour par sur avec pas il elle nous ce cette "
    "y o pero son del al por para con se no lo su e em não um uma do da dos das os as ao и в во на не но что как с со к по из за от о об у а при если или так хотя потому когда после он она они мы это "
    "gli di che è per non w z się nie że jest het een van niet och att som är ve bir bu và của là không"
).split()
_FUNCTION = rf"(?iu)(?<![\p{{L}}])(?:{'|'.join(FUNCTION_WORDS)})(?![\p{{L}}])"
_SENTENCE = rf"(?iu)(?<![\p{{L}}])(?:{'|'.join(SENTENCE_WORDS)})(?![\p{{L}}])"
#: Words of C.
CODE_WORDS = "int char void return struct if for while null const static".split()
#: A line that holds the end of a sentence.
_ENDED = r"[.!?。！？…](?:[\s\"'»”)]|$)"
#: A piece that stands so often on a page, in whatever order of its words, is repeated.
REPEATS = 3
#: Signs that stand for the bytes 0x80 to 0x9f in Windows-1252, and what they are in Latin-1; a byte lost to the replacement sign reads as 0x9d.
_SIGNS = {sign: chr(b) for b in range(0x80, 0xA0) if (sign := bytes([b]).decode("cp1252", "ignore"))} | {"\ufffd": "\x9d"}
_LOW = "".join(_SIGNS) + r"\x{80}-\x{9f}"
_TAIL = rf"[{_LOW}\x{{a0}}-\x{{bf}}]"
#: UTF-8 bytes read as single characters: whole sequences of two, three and four, with the first bytes of Latin, Greek, Cyrillic, Hebrew and Arabic letters, of all three-byte letters and of emoji; behind A-Z, a letter and a closing quote are taken as such.
_DAMAGED = (
    rf"(?:[Â-Å]{_TAIL}|(?<![A-Z])[Î-ÓÖ-Û]{_TAIL}|à[\x{{a0}}-\x{{bf}}]{_TAIL}|[á-ìîï]{_TAIL}{_TAIL}|í[{_LOW}]{_TAIL}"
    rf"|ð[‘’“”•–—˜™š›œžŸ\x{{90}}-\x{{9f}}\ufffd\x{{a0}}-\x{{bf}}]{_TAIL}{_TAIL})++"
)
#: Signs that pages may hold escaped.
_ENTITIES = (("&gt;", ">"), ("&lt;", "<"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Words of a keyword, at most.
SHORT = 5
#: Plain words in a row, without any sign between them, that are no sentence any more.
SOUP = 40
#: So many words of a paragraph's vocabulary make up most of it if it repeats keywords.
TOP = 12

#: What the trees see: none of it counts runs.
FEATURES = (
    "function_share urls commas colons hashes distinct_share capitals ended_lines word_length code_words anchors separators sentences code_signs digit_share table_share han_share log_words words_a_line"
).split()


def _top_share(words: Column) -> Column:
    """The share of an array's entries that its :data:`TOP` most frequent values make up."""
    ordered = F.array_sort(words)

    def of(w: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: ~F.coalesce(F.get(w, i) == F.get(w, i + 1), F.lit(False)))
        runs = F.zip_with(ends, F.concat(F.array(F.lit(-1)), ends), lambda b, a: F.coalesce(b - a, F.lit(0)))
        return F.aggregate(F.slice(F.sort_array(runs, asc=False), 1, TOP), F.lit(0), lambda a, b: a + b) / F.size(w)

    return F.get(F.transform(F.array(ordered), of), 0)


def repaired(text: Column) -> Column:
    """``text`` with UTF-8 that was read as Windows-1252 or Latin-1, once or twice, turned back where its bytes decode; all else stays."""
    bytes_ = lambda s: F.encode(F.translate(s, "".join(_SIGNS), "".join(_SIGNS.values())), "ISO-8859-1")

    def once(t: Column) -> Column:
        letters = F.transform(F.regexp_extract_all(t, F.lit(_DAMAGED), F.lit(0)), lambda s: F.decode(bytes_(s), "UTF-8"))
        return F.array_join(F.zip_with(F.split(t, _DAMAGED), letters, lambda kept, s: F.concat(kept, F.coalesce(s, F.lit("")))), "")

    # a quick look first, as hardly any text is damaged
    return F.when(text.rlike(rf"[Â-ÅÎ-ÓÖ-Ûà-ð]{_TAIL}"), F.get(F.transform(F.array(once(text)), once), 0)).otherwise(text)


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_WORD))


def _line(line: Column) -> Column:
    """A line's words ``k``, whether it repeats its own words (``again``) and its plain pieces ``units``.

    A piece has its words ``k`` and the ``kind`` of run it is: ``short``, ``soup``, ``mid`` (words without a
    sentence's structure) or none; if none, its ``key`` is its words in order, where the line is no sentence.
    """
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit(_WORD), F.lit(0))
    repeats = lambda w: (F.size(w) >= 15) & (F.size(F.array_distinct(w)) * 2 <= F.size(w)) & (_top_share(w) >= 0.8)

    def piece(u: Column, ended: Column) -> Column:
        k = _words(u)
        keyword = ~u.rlike(_LONG_HAN) & ~u.rlike(_FUNCTION)
        # short pieces of a line without a sentence's end need no look at more words
        kind = F.when(k >= SOUP, "soup").when((k <= SHORT) & keyword & ~(ended & u.rlike(_SENTENCE)), "short").when((k > SHORT) & ~ended & keyword & ~u.rlike(_SENTENCE), "mid").otherwise("")
        made = F.transform(F.array(F.struct(k.alias("k"), kind.alias("kind"))), lambda s: s.withField("key", F.when((s["kind"] == "") & (s["k"] >= 2) & ~ended, F.array_join(F.array_sort(words(u)), " "))))
        return F.get(made, 0)

    plain = F.filter(F.transform(F.split(line, _BREAK), lambda u: F.trim(u)), lambda u: u.rlike(_PLAIN))
    again = F.get(F.transform(F.array(words(line)), lambda w: F.struct(F.size(w).alias("k"), repeats(w).alias("again"))), 0)
    units = F.get(F.transform(F.array(line.rlike(_ENDED)), lambda ended: F.transform(plain, lambda u: piece(u, ended))), 0)
    return F.get(F.transform(F.array(again), lambda s: F.struct(s["k"].alias("k"), s["again"].alias("again"), units.alias("units"))), 0)


def page_features(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``n_words``, ``_hosts`` (hosts linked to) and the columns :data:`FEATURES`; null texts are left out, of others without a word all shares are 0."""
    clean = F.translate(F.col("_t"), "\u00a0\u200b\ufeff\u00ad", " ")
    for name, sign in _ENTITIES:
        clean = F.replace(clean, F.lit(name), F.lit(sign))
    # a filter on the number of words would count them twice, as Spark moves it to the scan
    rows = spread(df.where(F.col(text).isNotNull())).withColumn("_t", repaired(F.col(text))).withColumn("_t", clean)
    rows = rows.withColumn("_all", F.regexp_extract_all(F.lower("_t"), F.lit(_WORD), F.lit(0))).withColumn("n_words", F.size("_all"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    links = F.regexp_extract_all("_t", F.lit(_LINK), F.lit(0))
    rows = rows.withColumn("_links", links).withColumn("_rest", F.regexp_replace("_t", _LINK, "\n"))
    rows = rows.withColumn("_tags", F.regexp_extract_all("_rest", F.lit(_TAG), F.lit(0))).withColumn("_rest", F.regexp_replace("_rest", _TAG, "\n"))
    key = lambda pair: F.lower(F.regexp_extract(pair, r"^\p{L}+", 0))
    pairs = F.transform(F.regexp_extract_all("_rest", F.lit(_PAIR), F.lit(0)), lambda pair: F.struct(key(pair).alias("key"), pair.alias("pair")))
    often = lambda found: F.transform(F.filter(found, lambda x: F.size(F.filter(found, lambda y: y["key"] == x["key"])) >= REPEATS), lambda x: x["pair"])
    rows = rows.withColumn("_pairs", F.get(F.transform(F.array(pairs), often), 0))
    rows = rows.withColumn("_table", F.regexp_extract_all("_rest", F.lit(_TABLE), F.lit(0))).withColumn("_rest", F.regexp_replace("_rest", _TABLE, ""))
    rows = rows.withColumn("_lines", F.transform(F.filter(F.split("_rest", _LINE), lambda p: p.rlike(_WORD)), _line))
    # pieces that are no run by themselves are if they are repeated
    keys = F.array_sort(F.filter(F.flatten(F.transform("_lines", lambda p: p["units"]["key"])), lambda key: key.isNotNull()))
    rows = rows.withColumn("_keys", keys).withColumn("_often", F.array_distinct(F.filter("_keys", lambda key, i: F.coalesce(key == F.get("_keys", i + REPEATS - 1), F.lit(False)))))
    marked = lambda u: (u["kind"] != "") | F.coalesce(F.array_contains("_often", u["key"]), F.lit(False))
    rows = rows.withColumn("_units", F.flatten(F.transform("_lines", lambda p: F.filter(p["units"], marked))))
    # words of repeated lines count as such, all others by their piece, so each counts once
    rows = rows.withColumn("_others", F.flatten(F.transform(F.filter("_lines", lambda p: ~p["again"]), lambda p: F.filter(p["units"], marked))))
    again = F.filter("_lines", lambda p: p["again"])
    rows = rows.withColumn("_again", F.aggregate(again, F.lit(0), lambda a, p: a + p["k"]))
    total = lambda units: F.aggregate(units, F.lit(0), lambda a, u: a + u["k"])
    # one piece, link or tag or two don't make a list, but where they make up most of the page
    link, tag, others = _words(F.array_join("_links", " ")), _words(F.array_join(F.concat("_tags", "_pairs"), " ")), total(F.col("_others"))
    rows = rows.withColumns({"_link_words": link, "_tag_words": tag, "_other_words": others, "_pieces": F.size("_links") + F.size("_tags") + F.size("_pairs") + F.size("_others")})
    most = (F.col("_link_words") + F.col("_tag_words") + F.col("_other_words") + F.col("_again")) * 2 > n
    rows = rows.withColumn("_most", most & (F.col("_pieces") + F.when(F.col("_again") > 0, 2).otherwise(0) >= 2))
    share = lambda part: part / n
    rows = rows.withColumns(
        {
            "link_share": F.when(F.col("_most") | (F.size("_links") >= 4), share(F.col("_link_words"))).otherwise(0.0),
            "tag_share": F.when(F.col("_most") | (F.size("_tags") + F.size("_pairs") >= 4), share(F.col("_tag_words"))).otherwise(0.0),
            "keyword_share": share(F.col("_again") + F.when(F.col("_most") | (F.size("_units") >= 8), F.col("_other_words")).otherwise(total(F.filter("_others", lambda u: u["kind"] == "soup")))),
        }
    )
    rows = rows.withColumns(content_features(F.col("_t"), F.col("_all"), n)).withColumn("table_share", share(_words(F.array_join("_table", " "))))
    host = F.regexp_extract_all(F.lower("_t"), F.lit(rf"(?<![\p{{L}}\p{{M}}\p{{N}}.-]){_HOST}(?=/|:\d|\s|$)"), F.lit(0))
    # an address's host by its last two labels, so that its subdomains count together
    hosts = F.array_distinct(F.transform(F.when(F.size("_links") > 0, host).otherwise(F.array().cast("array<string>")), lambda h: F.call_function("substring_index", h, F.lit("."), F.lit(-2))))
    return rows.withColumn("_hosts", hosts).drop("_t", "_all", "_links", "_rest", "_tags", "_pairs", "_table", "_lines", "_keys", "_often", "_units", "_others", "_again", "_link_words", "_tag_words", "_other_words", "_pieces", "_most").withColumn("run_share", F.round(run_share(), 6))


def content_features(text: Column, words: Column, n: Column) -> dict[str, Column]:
    """What a text of ``n`` words (``words``: in lower case) looks like, without a look at runs."""
    rate = lambda pattern: F.regexp_count(text, F.lit(pattern)) / n
    among = lambda known: F.size(F.filter(words, lambda w: w.isin(*known))) / n
    lines = F.regexp_count(text, F.lit(r"(?m)^."))
    return {
        "function_share": among({*FUNCTION_WORDS, *SENTENCE_WORDS}),
        "urls": rate(r"https?://|www\."),
        "commas": rate(r"[,;·•]"),
        "colons": rate(r"[:=][ \t]?[\p{L}\p{N}]"),
        "hashes": rate(r"#\p{L}"),
        "distinct_share": F.size(F.array_distinct(words)) / n,
        "capitals": rate(r"\p{Lu}"),
        "ended_lines": F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"(?m)[.!?:;{})][ \t]*+$")), lines), F.lit(0.0)),
        "word_length": F.aggregate(words, F.lit(0), lambda a, w: a + F.char_length(w)) / n,
        "code_words": among(CODE_WORDS),
        "anchors": rate(r"</a>|\]\(|\[/url\]"),
        "separators": rate(r"[|;,•·]|\s[-*/>→]+\s"),
        "sentences": rate(r"[.!?](?:\s|$)|。"),
        "code_signs": rate(r"[{}()\[\]=<>&*;]"),
        "digit_share": rate(r"\p{N}++"),
        "han_share": F.regexp_count(text, F.lit(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]")) / F.greatest(F.char_length(text), F.lit(1)),
        "log_words": F.log1p(n),
        "words_a_line": F.log1p(F.coalesce(F.try_divide(n, lines), n)),
    }


def run_share() -> Column:
    """The share of words in lists of links, product tags and runs of keywords, each word once."""
    return F.col("link_share") + F.col("tag_share") + F.col("keyword_share")


def weak_label() -> Column:
    """1 for pages that are clearly made of such runs, 0 for pages that clearly aren't, else null."""
    return F.when((F.col("run_share") > 0.75) & (F.col("n_words") >= 8), 1.0).when(F.col("run_share") < 0.35, 0.0)


def spam_pages(df: DataFrame, doc_id: str, text: str, trees: int = 40, depth: int = 10, seed: int = 7) -> DataFrame:
    """``doc_id, n_words, run_share, page_score, score`` of every page that has a word.

    ``page_score`` is the trees' probability, ``score`` is the same after
    smoothing by hosts: a page is spam if it is at least 0.5.  ``run_share``,
    the share of words in runs of keywords, links or tags, is what the weak
    labels come from; it is given for reports.
    The trees are trained on at most :data:`TRAIN_ROWS` labelled pages of each
    class, chosen by a hash; all pages are scored and all count for the rates of
    hosts.  A page of one word has page score 0.  If the weak labels know one class only, ``page_score`` is 1 for pages
    of ``run_share > 0.5`` and else ``run_share``.  Every row gives one row, also if repeated; null,
    empty and blank texts give none.
    """
    rows = df.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    pages = materialize(page_features(rows, "_text").withColumns({"_page": F.xxhash64("_id", "_text"), "label": weak_label()}).drop("_text")).where("n_words > 0")
    sizes = {r.label: r.n for r in pages.groupBy("label").agg(F.count("*").alias("n")).collect() if r.label is not None}
    if len(sizes) == 2:
        draw = F.pmod(F.xxhash64(F.lit(seed), "_page"), F.lit(1 << 30))
        some = pages.where("label is not null").where(draw < F.when(F.col("label") == 1, int(min(1.0, TRAIN_ROWS / sizes[1.0]) * (1 << 30))).otherwise(int(min(1.0, TRAIN_ROWS / sizes[0.0]) * (1 << 30))))
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        # classes weigh the same; the few spam pages would else hardly count
        some = some.withColumn("_weight", F.when(F.col("label") == 1, min(sizes[0.0], TRAIN_ROWS) / min(sizes[1.0], TRAIN_ROWS)).otherwise(1.0))
        forest = RandomForestClassifier(featuresCol="_features", labelCol="label", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="sqrt")
        model = forest.fit(assemble.transform(some.select(*FEATURES, "label", "_weight")))
        pages = materialize(model.transform(assemble.transform(pages)).withColumn("page_score", vector_to_array("probability")[1]).select("_id", "_page", "n_words", "run_share", "page_score", "_hosts"))
    else:
        pages = pages.withColumn("page_score", F.when(F.col("run_share") > 0.5, 1.0).otherwise(F.col("run_share")))
    pages = pages.withColumn("page_score", F.when(F.col("n_words") > 1, F.col("page_score")).otherwise(0.0))  # one word, however long, repeats and lists nothing
    overall = pages.agg(F.coalesce(F.avg("page_score"), F.lit(0.0)).alias("overall"))  # one row
    on = pages.select("_page", "page_score", F.explode("_hosts").alias("host"))
    rates = on.groupBy("host").agg(F.sum("page_score").alias("sum"), F.count("*").alias("n")).crossJoin(F.broadcast(overall))
    rates = rates.select("host", ((F.col("sum") + HOST_PRIOR * F.col("overall")) / (F.col("n") + HOST_PRIOR)).alias("rate"), (F.col("n") / (F.col("n") + HOST_PRIOR)).alias("sure"))
    around = on.join(rates, "host").groupBy("_page").agg((F.sum(F.col("rate") * F.col("sure")) / F.sum("sure")).alias("rate"), F.avg("sure").alias("sure"))
    weight = HOST_WEIGHT * F.coalesce("sure", F.lit(0.0))
    score = (1 - weight) * F.col("page_score") + weight * F.coalesce("rate", F.lit(0.0))
    return pages.join(around, "_page", "left").select(F.col("_id").alias(doc_id), "n_words", "run_share", F.round("page_score", 6).alias("page_score"), F.round(score, 6).alias("score"))
