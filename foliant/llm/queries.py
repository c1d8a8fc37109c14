"""The pN_ queries of the training-data operators, and their SQL where DuckDB can run it on whole tables."""

from __future__ import annotations

from collections.abc import Callable
import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm import bpe, distinct, frequency, leak, lookalike, spans, together
from foliant.plans.skew import spread
from foliant.plans.stage import at_once, stage
from foliant.sources.tables import array_values, current_items, live_items, table

Query = Callable[[SparkSession, str], DataFrame]


def p1_frequency(spark: SparkSession, at: str) -> DataFrame:
    """Every posting term and every tag of live items: occurrences, records, and the mark of useless ones."""
    postings = table(spark, at, "postings")
    live = stage(live_items(table(spark, at, "metadata"), "tags"), "live")
    terms = postings.select(F.lit("terms").alias("field"), "term", F.col("idx").alias("record"), F.col("tf").alias("n"))
    tags = live.select("id", F.explode(F.filter(F.coalesce("tags", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))).alias("term"))
    tags = tags.groupBy("id", "term").agg(F.count("*").alias("n")).select(F.lit("tags").alias("field"), "term", F.col("id").alias("record"), "n")
    (found, records), tagged = at_once(lambda: frequency.frequencies_and_records(terms), lambda: frequency.term_frequencies(tags, unique=True))
    counts = found.unionByName(tagged)
    sizes = records.select(F.lit("terms").alias("field"), "size").unionByName(live.agg(F.count("*").alias("size")).select(F.lit("tags").alias("field"), "size"))
    return frequency.mark_useless(counts, sizes)


def p1_found(spark: SparkSession, at: str) -> DataFrame:
    return p1_frequency(spark, at).filter(F.col("mark").isNotNull()).select("field", "term")


def _occurrences(live: DataFrame) -> DataFrame:
    """(field, term, record, tf): tags of live items, and words of their names and annotations."""
    tags = live.select(F.lit("tags").alias("field"), F.explode(array_values("tags")).alias("term"), F.col("id").alias("record")).withColumn("tf", F.lit(1).cast("long"))
    text = F.concat_ws("\n", "name", "annotation")
    words = live.select("id", F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("word"))
    words = words.groupBy(F.lower("word").alias("term"), "id").agg(F.count("*").alias("tf"))
    return tags.unionByName(words.select(F.lit("text").alias("field"), "term", F.col("id").alias("record"), "tf"))


def _scored(spark: SparkSession, at: str, cases: bool = False) -> DataFrame:
    live = stage(live_items(table(spark, at, "metadata"), "name", "annotation", "tags"), "live")
    rows = stage(_occurrences(live), "occurrences")
    n = live.agg(F.count("*").alias("n")).scalar()
    least = F.when(F.col("field") == "text", distinct.least_ridf(n, LEAST_TIMES, MOST_RECORDS)) if cases else None
    return distinct.residual_idf(rows, n, least)


def p2_scores(spark: SparkSession, at: str) -> DataFrame:
    """Every tag and word of every live item with its residual inverse document frequency and score."""
    return _scored(spark, at).select(F.col("record").alias("id"), "field", "term", "tf", "df", "cf", F.round("ridf", 6).alias("ridf"), F.round("score", 6).alias("score"))


#: a word is a case if it occurs so often in an item, and in no more items than these
LEAST_TIMES, MOST_RECORDS = 3, 12


def p2_found(spark: SparkSession, at: str) -> DataFrame:
    """The best-scored tag of an item that stands out tenfold, and the best-scored words, which pile up in few items.

    Words are candidates by their residual inverse document frequency, above a bound that
    no case falls below; how often and in how many items they occur is checked last.
    """
    scored = _scored(spark, at, cases=True)
    best = Window.partitionBy("record").orderBy(F.desc("score"), "df")
    tags = scored.filter(F.col("field") == "tags").withColumn("rank", F.row_number().over(best)).withColumn("next", F.lead("df").over(best)).withColumn("last", F.lead("df", 2).over(best))
    tags = tags.filter((F.col("rank") == 1) & F.col("last").isNotNull() & (F.col("df") >= 2) & (F.col("next") >= 10 * F.col("df")))
    words = scored.filter((F.col("field") == "text") & (F.col("tf") >= LEAST_TIMES) & F.col("df").between(2, MOST_RECORDS))
    return tags.select(F.col("record").alias("id"), "field", "term").unionByName(words.select(F.col("record").alias("id"), "field", "term"))


def _together(spark: SparkSession, at: str, least: int) -> DataFrame:
    live = stage(live_items(table(spark, at, "metadata"), "tags", "folders"), "live")
    held = [live.select(F.lit(c).alias("field"), F.col("id").alias("record"), F.explode(array_values(c)).alias("value")) for c in ("tags", "folders")]
    return together.pairs_together(held[0].unionByName(held[1]), live.agg(F.count("*").alias("n")).scalar(), least)


def p5_pairs(spark: SparkSession, at: str) -> DataFrame:
    """Every pair of tags or folders that some live item holds, with lift and odds ratio."""
    return _together(spark, at, 1).select("field", "a", "b", "n", "n_a", "n_b", F.round("lift", 6).alias("lift"), F.round("log_odds", 6).alias("log_odds"))


def p5_found(spark: SparkSession, at: str) -> DataFrame:
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    often = _together(spark, at, 5).filter(wide("n") * wide("n_all") >= wide("n_a") * wide("n_b") * 4)
    return often.select("field", "a", "b")


def p6_found(spark: SparkSession, at: str) -> DataFrame:
    items = stage(current_items(table(spark, at, "metadata"), "name", "annotation", "tags"), "items")
    texts = [items.select(F.lit(c).alias("field"), "id", F.col(c).alias("text")) for c in ("name", "annotation")]
    tags = items.select("id", F.explode(array_values("tags")).alias("text"))
    known = table(spark, at, "tag_groups").select(F.col("tag").alias("value"))
    pairs, near = at_once(lambda: lookalike.same_look_pairs(texts[0].unionByName(texts[1])), lambda: lookalike.same_look_values(tags, known))
    return pairs.unionByName(near.select(F.lit("tags").alias("field"), F.col("id").alias("a"), F.col("value").alias("b")))


def p6_classes(spark: SparkSession, at: str) -> DataFrame:
    """Every current item's name and annotation with its class of texts that look the same, and its number of links."""
    items = current_items(table(spark, at, "metadata"), "name", "annotation")
    texts = [items.select(F.lit(c).alias("field"), "id", F.col(c).alias("text")) for c in ("name", "annotation")]
    return lookalike.same_look_classes(texts[0].unionByName(texts[1]))


def p6_forms(spark: SparkSession, at: str) -> DataFrame:
    """Name, annotation and tags of every current item in the consistent writing."""
    items = current_items(table(spark, at, "metadata"), "name", "annotation", "tags")
    forms = items.select("id", lookalike.visual_form("name").alias("name"), lookalike.visual_form("annotation").alias("annotation"))
    tags = items.select("id", F.explode(array_values("tags")).alias("tag")).withColumn("form", lookalike.visual_form("tag"))
    tags = tags.filter(F.col("form") != "").groupBy("id").agg(F.array_sort(F.collect_set("form")).alias("tags"))
    return forms.join(tags, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def _texts(spark: SparkSession, at: str) -> DataFrame:
    return spread(table(spark, at, "documents").select("doc_id", "text"))


def p7_ids(spark: SparkSession, at: str) -> DataFrame:
    return bpe.encode_corpus(_texts(spark, at), "doc_id", "text")


def _leaks(spark: SparkSession, at: str) -> DataFrame:
    return leak.find_leaks(_texts(spark, at), "doc_id", "text", table(spark, at, "eval_items"), "item_id", "text")


def p8_leaks(spark: SparkSession, at: str) -> DataFrame:
    """Every document that holds twenty or more consecutive letters and digits of an eval item, with how many of the item's it holds."""
    return _leaks(spark, at).filter(F.col("covered") > 0).select("doc_id", "item_id", "covered", "item_chars")


def p8_whole(spark: SparkSession, at: str) -> DataFrame:
    """Every document that holds an eval item nearly whole, and within how many edits."""
    return _leaks(spark, at).filter(F.col("edits").isNotNull()).select("doc_id", "item_id", "edits", "item_chars")


def p8_found(spark: SparkSession, at: str) -> DataFrame:
    return leak.leaked(_leaks(spark, at)).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, at: str) -> DataFrame:
    return spans.span_pairs(spans.shared_spans(_texts(spark, at), "doc_id", "text"))


def p9_shared(spark: SparkSession, at: str) -> DataFrame:
    """Of every document, how much lies in spans of 320 characters or more that another document holds."""
    documents = _texts(spark, at)
    return spans.shared_amount(documents, "doc_id", "text", spans.shared_spans(documents, "doc_id", "text"))


def queries() -> dict[str, Query]:
    found = [p1_found, p1_frequency, p2_found, p2_scores, p5_found, p5_pairs, p6_found, p6_classes, p6_forms, p7_ids, p8_found, p8_leaks, p8_whole, p9_found, p9_shared]
    return {f.__name__: f for f in found}


_LIVE = """
current_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY modificationTime DESC) AS rn FROM metadata WHERE id IS NOT NULL) WHERE rn = 1),
live AS (SELECT * FROM current_rows WHERE NOT coalesce(isDeleted, false)),
tag_rows AS (SELECT id, tag FROM (SELECT id, unnest(tags) AS tag FROM live) WHERE tag <> ''),
tags AS (SELECT DISTINCT id, tag FROM tag_rows)"""

_FREQUENCY = f"""
WITH {_LIVE},
one AS (SELECT term, idx, max(coalesce(tf, 1)) AS n FROM postings WHERE term <> '' AND idx IS NOT NULL GROUP BY ALL),
counted AS (
  SELECT 'terms' AS field, term, sum(n)::BIGINT AS n_occurrences, count(*) AS n_records, (SELECT count(DISTINCT idx) FROM postings) AS size FROM one GROUP BY term
  UNION ALL
  SELECT 'tags', tag, count(*), count(DISTINCT id), (SELECT count(*) FROM live) FROM tag_rows GROUP BY tag),
marked AS (SELECT field, term, n_occurrences, n_records, CASE WHEN n_records * 5 > size THEN 'common' WHEN n_records < 2 THEN 'rare' END AS mark FROM counted)"""

_SCORES = f"""
WITH {_LIVE},
words AS (SELECT id, lower(unnest(regexp_extract_all(concat_ws(chr(10), name, annotation), '[A-Za-z]{{4,}}'))) AS word FROM live),
held AS (SELECT 'tags' AS field, tag AS term, id, 1::BIGINT AS tf FROM tags UNION ALL SELECT 'text', word, id, count(*) FROM words GROUP BY word, id),
stats AS (SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS cf FROM held GROUP BY field, term),
scored AS (SELECT id, field, term, tf, df, cf, log2((1 - exp(-cf::DOUBLE / (SELECT count(*) FROM live))) / (df::DOUBLE / (SELECT count(*) FROM live))) AS ridf FROM held JOIN stats USING (field, term))"""

_PAIRS = f"""
WITH {_LIVE},
held AS (SELECT 'tags' AS field, id, tag AS v FROM tags UNION ALL SELECT DISTINCT 'folders', id, f FROM (SELECT id, unnest(folders) AS f FROM live) WHERE f <> ''),
single AS (SELECT field, v, count(*) AS n FROM held GROUP BY field, v),
pairs AS (SELECT x.field, x.v AS a, y.v AS b, count(*) AS n FROM held x JOIN held y ON x.field = y.field AND x.id = y.id AND x.v < y.v GROUP BY ALL),
full_pairs AS (SELECT p.field, p.a, p.b, p.n, sa.n AS n_a, sb.n AS n_b, (SELECT count(*) FROM live) AS n_all
  FROM pairs p JOIN single sa ON sa.field = p.field AND sa.v = p.a JOIN single sb ON sb.field = p.field AND sb.v = p.b)"""


#: letters and digits of other width, each with its common form
_WIDTHS = [(c, how) for c in map(chr, range(0xFF00, 0xFFE0)) if (how := unicodedata.normalize("NFKC", c)) and len(how) == 1 and how.isalnum()]

_LEAKS = f"""
WITH folded_items AS (SELECT DISTINCT item_id, regexp_replace(lower(translate(text, '{"".join(c for c, _ in _WIDTHS)}', '{"".join(how for _, how in _WIDTHS)}')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t FROM eval_items WHERE text <> ''),
folded_docs AS (SELECT DISTINCT doc_id, regexp_replace(lower(translate(text, '{"".join(c for c, _ in _WIDTHS)}', '{"".join(how for _, how in _WIDTHS)}')), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS t FROM documents WHERE text <> ''),
item_grams AS (SELECT item_id, t, o, substring(t, o + 1, 20) AS g FROM (SELECT item_id, t, unnest(range(length(t) - 19)) AS o FROM folded_items WHERE length(t) >= 20)),
doc_grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, substring(t, o + 1, 20) AS g FROM (SELECT doc_id, t, unnest(range(length(t) - 19)) AS o FROM folded_docs WHERE length(t) >= 20)) WHERE g IN (SELECT g FROM item_grams)),
held AS (SELECT DISTINCT doc_id, item_id, t, o FROM doc_grams JOIN item_grams USING (g)),
covered AS (SELECT doc_id, item_id, t, sum(step) AS covered FROM (SELECT doc_id, item_id, t, least(20, coalesce(o - lag(o) OVER (PARTITION BY doc_id, item_id, t ORDER BY o), 20)) AS step FROM held) GROUP BY ALL)"""

_SPANS = """
WITH texts AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 320),
wins AS (SELECT doc_id, pos, md5(substring(text, pos + 1, 320)) AS h FROM (SELECT doc_id, text, unnest(range(length(text) - 319)) AS pos FROM texts)),
several AS (SELECT h FROM wins GROUP BY h HAVING min(doc_id) <> max(doc_id)),
shared AS (SELECT wins.* FROM wins JOIN several USING (h))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p8_found": f"{_LEAKS} SELECT DISTINCT doc_id, item_id FROM covered WHERE covered * 2 >= length(t)",
        "p8_leaks": f"{_LEAKS} SELECT doc_id, item_id, covered::BIGINT AS covered, length(t) AS item_chars FROM covered",
        "p9_found": f"""{_SPANS}, holders AS (SELECT DISTINCT h, doc_id FROM shared)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM holders a JOIN holders b ON a.h = b.h AND a.doc_id < b.doc_id""",
        "p9_shared": f"""{_SPANS}, parts AS (SELECT doc_id, sum(step) AS n FROM (SELECT doc_id, least(320, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), 320)) AS step FROM shared) GROUP BY doc_id),
copies AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS copy_of, count(*) OVER (PARTITION BY text) AS n FROM texts)
SELECT d.doc_id, coalesce(length(d.text), 0) AS n_chars, coalesce(p.n, 0)::BIGINT AS shared_chars, CASE WHEN c.n > 1 THEN c.copy_of END AS copy_of
FROM documents d LEFT JOIN parts p ON d.doc_id = p.doc_id LEFT JOIN copies c ON d.doc_id = c.doc_id""",
        "p1_frequency": f"{_FREQUENCY} SELECT field, term, n_occurrences, n_records, mark FROM marked",
        "p1_found": f"{_FREQUENCY} SELECT field, term FROM marked WHERE mark IS NOT NULL",
        "p2_scores": f"{_SCORES} SELECT id, field, term, tf, df, cf, round(ridf, 6) AS ridf, round(tf * ridf, 6) AS score FROM scored",
        "p2_found": f"""{_SCORES},
others AS (SELECT x.id, x.term, x.df, count(*) AS n, min(y.df) AS least FROM scored x JOIN scored y ON x.field = 'tags' AND y.field = 'tags' AND x.id = y.id AND x.term <> y.term GROUP BY ALL)
SELECT id, 'tags' AS field, term FROM others WHERE n >= 2 AND df >= 2 AND least >= 10 * df
UNION ALL SELECT id, field, term FROM scored WHERE field = 'text' AND tf >= 3 AND df BETWEEN 2 AND 12""",
        "p5_pairs": f"""{_PAIRS} SELECT field, a, b, n, n_a, n_b, round(n::DOUBLE * n_all / n_a / n_b, 6) AS lift,
  round(ln(((n + 0.5::DOUBLE) * (n_all - n_a - n_b + n + 0.5::DOUBLE)) / ((n_a - n + 0.5::DOUBLE) * (n_b - n + 0.5::DOUBLE))), 6) AS log_odds FROM full_pairs""",
        "p5_found": f"{_PAIRS} SELECT field, a, b FROM full_pairs WHERE n >= 5 AND n * n_all >= 4 * n_a * n_b",
    }
