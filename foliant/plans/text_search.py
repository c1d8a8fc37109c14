"""Queries of the full-text engine over the library's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import EXT_GROUPS, MASK, WEIGHTS
from foliant.functions import text as fn
from foliant.functions.termcount import term_counts
from foliant.functions.tokenizer import CJK_RANGES, JOINERS, STOP_WORDS, WORD_RANGES, term_array
from foliant.operators import facets
from foliant.operators.index import IndexStore, build_postings, diff, name_folders
from foliant.operators.query import Filters
from foliant.operators.search import Index, field_labels, idf, search
from foliant.operators.snippet import ranges_of, snippet_of
from foliant.plans.commit import listing
from foliant.plans.skew import spread
from foliant.plans.stage import new_folder, stage
from foliant.sources.tables import current_items, live_items, table

Query = Callable[[SparkSession, str], DataFrame]
NOW = 1_790_746_332_000
STRINGS = "array<string>"


def items(spark: SparkSession, at: str, *columns: str, live: bool = False) -> DataFrame:
    """Current rows of items with named folders and without nulls."""
    pick = live_items if live else current_items
    names = [c for c in dict.fromkeys([*columns, "name", "annotation", "url", "tags", "folders", "star"]) if c != "isDeleted"]
    rows = pick(table(spark, at, "metadata"), *names)
    none = F.array().cast(STRINGS)
    rows = rows.withColumns({c: F.filter(F.coalesce(c, none), lambda x: x.isNotNull() & (x != "")) for c in ("tags", "folders")})
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("name", "annotation", "url")}).withColumn("star", F.coalesce("star", F.lit(0)))
    return name_folders(rows, table(spark, at, "folders"))


def _derived(spark: SparkSession, at: str) -> Index:
    """Docs with their items' attributes, postings without repeats, the newest text of each item."""
    about = items(spark, at).select("id", "tags", F.col("folder_names").alias("folders"), "star", "url", "annotation")
    none = F.array().cast(STRINGS)
    docs = table(spark, at, "docs").filter(F.col("idx").isNotNull()).distinct().join(about, "id", "left")
    docs = docs.withColumns({"tags": F.coalesce("tags", none), "folders": F.coalesce("folders", none), "star": F.coalesce("star", F.lit(0)), "url": F.coalesce("url", F.lit("")), "annotation": F.coalesce("annotation", F.lit(""))})
    docs = docs.withColumn("folded_name", fn.folded("name"))
    postings = table(spark, at, "postings").groupBy("term", "idx").agg(F.bit_or("mask").alias("mask"), F.max("tf").alias("tf"))
    newest = table(spark, at, "documents").filter(F.col("item_id").isNotNull()).groupBy(F.col("item_id").alias("id")).agg(F.max_by("text", F.struct("added_at", "doc_id")).alias("content"))
    texts = table(spark, at, "docs").select("idx", "id").distinct().join(newest, "id").select("idx", F.coalesce("content", F.lit("")).alias("content"))
    return Index(docs, postings, texts)


_stored: dict[tuple, Index] = {}


def library_index(spark: SparkSession, at: str) -> Index:
    """The library's index as stored tables, written once a session and again only when the library's tables change.

    Postings lie in the order of (term, idx), so a search reads the row groups of its terms.
    """
    version = tuple(tuple(listing(spark, f"{at}/{name}.parquet")) for name in ("docs", "metadata", "folders", "postings", "documents"))
    key = (spark.sparkContext.applicationId, at, version)
    if key not in _stored:
        new = _derived(spark, at)
        docs = stage(new.docs, "docs")
        postings = stage(new.postings.repartitionByRange("term", "idx").sortWithinPartitions("term", "idx"), "postings")
        _stored[key] = Index(docs, postings, stage(new.texts, "texts"), docs.count())
    return _stored[key]


def content_rows(spark: SparkSession, at: str, *columns: str) -> DataFrame:
    """Live items as the index takes them in, each with the text of its newest document."""
    newest = table(spark, at, "documents").filter(F.col("item_id").isNotNull()).groupBy(F.col("item_id").alias("id")).agg(F.max_by("text", F.struct("added_at", "doc_id")).alias("content"))
    return items(spark, at, *columns, live=True).join(newest, "id", "left").withColumn("content", F.coalesce("content", F.lit("")))


# ---------------------------------------------------------------- terms and postings


def tokenize_documents_tf(spark, at):
    rows = spread(table(spark, at, "documents").select("doc_id", "text"))
    return term_counts(rows, "doc_id", {"text": (1, F.col("text"))}).select("doc_id", "term", "tf")


def tokenize_documents_lower_tf(spark, at):
    rows = spread(table(spark, at, "documents").select("doc_id", "text"))
    return term_counts(rows, "doc_id", {"text": (1, F.col("text"))}, normalise=False).select("doc_id", "term", "tf")


SAMPLES = ["scrna-seq il-1β 3.5 a/b", "a--b -c- d. x", "深度学习方法 的 我", "鼠", "ab中c文de", "it's o'clock 7 z", "１２ ｆｕｌｌ", "", "한국어 かな カナ", "c++ +x x+y/z_1"]


def tokenize_values(spark, at):
    """The column expression, on values that show each rule."""
    rows = spark.createDataFrame(list(enumerate(SAMPLES)), "k int, s string")
    return rows.select("k", F.explode(term_array("s", normalise=False)).alias("term")).groupBy("k", "term").agg(F.count("*").alias("tf"))


def postings_multifield(spark, at):
    return build_postings(content_rows(spark, at), "id", normalise=False)


def postings_full_text(spark, at):
    return build_postings(content_rows(spark, at), "id")


def doc_frequency(spark, at):
    return library_index(spark, at).postings.groupBy("term").agg(F.count("*").alias("df"))


def idf_table(spark, at):
    index = library_index(spark, at)
    n = index.docs.agg(F.count("*").alias("n")).scalar()
    return index.postings.groupBy("term").agg(F.count("*").alias("df")).select("term", F.round(idf(F.col("df"), n), 6).alias("idf"))


def corpus_size(spark, at):
    return library_index(spark, at).docs.agg(F.count("*").alias("n_docs"))


# ---------------------------------------------------------------- searches: query, filters beside it, order, limit

SEARCHES: dict[str, tuple[str, Filters | None, str, int]] = {
    "search_single_term": ("reference", None, "relevance", 60),
    "search_and_two_terms": ("reference 2d", None, "relevance", 60),
    "search_and_three_terms": ("reference 2d 23316", None, "relevance", 60),
    "search_or_fallback_unknown_term": ("reference nosuchterm 2d", None, "relevance", 60),
    "search_or_fallback_empty_intersection": ("tezilel fopipa neperux mino gusitoth bemogi", None, "relevance", 60),
    "search_exclude_term": ("2d -reference", None, "relevance", 60),
    "search_exclude_multi_token": ("reference -mino/2d -23316.2d -lime", None, "relevance", 60),
    "search_filter_ext": ("reference ext:.PDF ext:docx", None, "relevance", 60),
    "search_filter_type_group": ("reference type:word", None, "relevance", 60),
    "search_filter_type_unknown": ("reference type:epub", None, "relevance", 60),
    "search_filter_tag_substring": ("reference tag:2 tag:批次", None, "relevance", 60),
    "search_filter_folder": ("2d folder:归档", None, "relevance", 60),
    "search_filter_star": ("reference star:>=4", None, "relevance", 60),
    "search_filter_star_upper": ("reference star:5 star:<3", None, "relevance", 60),
    "search_filters_emptied_no_fallback": ("reference 2d ext:xyz", None, "relevance", 60),
    "search_minus_filter_is_positive": ("reference -ext:pdf size:3", None, "relevance", 60),
    "search_extra_filters": ("2d star:3", Filters(groups=["pdf", "text"], tags=["资料"], star_min=4), "relevance", 60),
    "search_phrase_verified": ('"the"  reference "index card"', None, "relevance", 60),
    "search_phrase_absent": ('reference "no such phrase anywhere"', None, "relevance", 60),
    "search_han_word": ("索引", None, "relevance", 60),
    "search_han_negative": ("索引 2d -扫描", None, "relevance", 60),
    "search_title_boost": ("2d", None, "relevance", 200),
    "search_sort_mtime": ("reference 2d", None, "mtime", 60),
    "search_sort_name": ("reference", None, "name_binary", 60),
    "search_sort_name_zh": ("reference", None, "name", 60),
    "search_decorated": ('reference "index card"', None, "relevance", 20),
    "browse_mtime": ("", None, "relevance", 60),
    "browse_name_filtered": ("type:pdf star:3", None, "name_binary", 60),
    "browse_only_negatives": ("-reference the", None, "mtime", 60),
    "browse_tag_two_words_quirk": ('tag:"reference"', None, "relevance", 60),
}


def _search(name: str) -> Query:
    query, extra, sort, limit = SEARCHES[name]

    def run(spark: SparkSession, at: str) -> DataFrame:
        hits = search(library_index(spark, at), query, extra, sort, limit, snippets=False).hits
        return hits.select("rank", "idx", "id", "name", F.round("score", 6).alias("score"), F.col("mask").cast("int").alias("mask"), F.col("matched").cast("long").alias("matched"), "partial")

    return run


def _summary(name: str) -> Query:
    query, extra, sort, limit = SEARCHES[name]
    return lambda spark, at: search(library_index(spark, at), query, extra, sort, limit, snippets=False).summary


SUMMARIES = {"result_metadata_and": "search_and_two_terms", "result_metadata_or": "search_or_fallback_empty_intersection", "result_metadata_phrase": "search_phrase_verified", "result_metadata_browse": "browse_name_filtered"}


def search_decorated(spark, at):
    """Labels, match ranges and snippets of the hits that are shown."""
    hits = search(library_index(spark, at), *SEARCHES["search_decorated"]).hits
    shown = hits.select("rank", "idx", F.concat_ws(",", "fields").alias("fields"), "group", F.size("name_ranges").alias("n_name_ranges"), "snip.text", F.size("snip.ranges").alias("n_ranges"), F.round("score", 6).alias("score"))
    return shown.withColumn("n_ranges", F.when(F.col("text").isNotNull(), F.col("n_ranges")))


def hit_field_labels(spark, at):
    rows = library_index(spark, at).postings
    return rows.filter(F.col("term") == "reference").select("idx", F.concat_ws(",", field_labels(F.col("mask"))).alias("fields"))


def snippet_documents(spark, at):
    rows = table(spark, at, "documents").select("doc_id", snippet_of(F.col("text"), ["index card", "索引卡"]).alias("snip"))
    return rows.select("doc_id", F.col("snip.text").alias("text"), F.size("snip.ranges").alias("n_ranges"), "snip.truncated_head", "snip.truncated_tail")


def highlight_names(spark, at):
    rows = table(spark, at, "docs").select("idx", "name").distinct().withColumn("ranges", ranges_of(F.col("name"), ["re", "版"]))
    return rows.select("idx", fn.highlight_html("name", "ranges", "hit").alias("html"))


# ---------------------------------------------------------------- markup and formatting


def _pages(spark, at) -> DataFrame:
    """Documents' texts written as HTML pages."""
    rows = table(spark, at, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    page = F.concat(F.lit("<html><head><title>"), "source", F.lit("</title><style>p { x }</style></head><BODY><!-- note --><p>"), fn.escape_html("text"), F.lit("</p><ul><li class='a'>one<br/>two &copy; &middot;&nbsp;&hellip;</li></ul><script>let a = '<p>';</script></BODY></html>"))
    return rows.select("doc_id", page.alias("html"))


def markup_stripped(spark, at):
    return _pages(spark, at).select("doc_id", fn.strip_markup("html").alias("text"))


def markup_clean_text(spark, at):
    return _pages(spark, at).select("doc_id", fn.clean_text(fn.strip_markup("html")).alias("text"))


def escape_html(spark, at):
    return table(spark, at, "documents").select("doc_id", fn.escape_html("text").alias("html"))


def format_bytes(spark, at):
    return table(spark, at, "docs").select("size").distinct().select("size", fn.format_bytes("size").alias("shown"))


def format_time(spark, at):
    return table(spark, at, "docs").select("mtime").distinct().select("mtime", fn.format_time("mtime", NOW).alias("shown"))


def group_of_ext(spark, at):
    return table(spark, at, "metadata").select("ext").distinct().select("ext", fn.group_of_ext("ext").alias("group"))


# ---------------------------------------------------------------- statistics


def index_stats(spark, at):
    index = library_index(spark, at)
    terms = index.postings.agg(F.countDistinct("term").alias("n")).scalar()
    return facets.totals(index.docs).withColumn("terms", terms)


def stats_by_group(spark, at):
    return facets.by_group(library_index(spark, at).docs)


def stats_by_method(spark, at):
    return facets.by_method(library_index(spark, at).docs)


def facet_tags_top18(spark, at):
    return facets.top_values(library_index(spark, at).docs, "tags", facets.TAGS)


def facet_folders_top14(spark, at):
    return facets.top_values(library_index(spark, at).docs, "folders", facets.FOLDERS)


def coverage_overview(spark, at):
    index = library_index(spark, at)
    return facets.overview(index.docs, index.postings)


def warnings_grouped(spark, at):
    return facets.grouped_warnings(library_index(spark, at).docs)


# ---------------------------------------------------------------- upkeep


def _listed(spark, at) -> DataFrame:
    rows = current_items(table(spark, at, "metadata"), "mtime", "ext", "size").filter(~F.col("isDeleted"))
    return rows.select("id", "mtime", F.lower("ext").alias("ext"), "size")


def incr_changed(spark, at):
    return diff(_listed(spark, at), table(spark, at, "docs").distinct()).changed


def incr_deleted(spark, at):
    return diff(_listed(spark, at), table(spark, at, "docs").distinct()).removed


def incr_postings_survivors(spark, at):
    """The postings that stay when changed and removed documents are taken out."""
    docs = table(spark, at, "docs").distinct()
    d = diff(_listed(spark, at), docs)
    gone = docs.join(d.changed.unionByName(d.removed).distinct(), "id").select("idx")
    return library_index(spark, at).postings.join(gone, "idx", "left_anti").select("term", "idx", "mask", "tf")


def incr_equals_full(spark, at):
    """Every live item as an index holds it that took the library in twice: half of it, partly in an older state, then all.

    ``n_differing`` counts the postings in which it differs from an index built at once.
    """
    now = stage(content_rows(spark, at, "ext", "mtime", "size").select("id", "name", "annotation", "tags", "folders", "folder_names", "star", "url", "content", "ext", "mtime", "size"), "now")
    half = F.pmod(F.xxhash64("id"), F.lit(4))
    # of four parts one is missing at first, one is as it was before an edit, and items that have gone since are there
    before = now.filter(half > 0).withColumns({"mtime": F.when(half == 1, F.col("mtime") - 1).otherwise(F.col("mtime")), "content": F.when(half == 1, "old words").otherwise(F.col("content"))})
    gone = now.filter(half == 2).limit(50).withColumns({"id": F.concat(F.lit("gone "), "id")})
    store, full = IndexStore(spark, new_folder(spark, "incremental")), IndexStore(spark, new_folder(spark, "full"))
    store.build(before.unionByName(gone))
    store.build(now)
    full.build(now)
    dumps = [index.postings.join(index.docs.select("idx", "id"), "idx").select("id", "term", "mask", "tf") for index in (store.load()[0], full.load()[0])]
    sides = dumps[0].withColumn("side", F.lit(1)).unionByName(dumps[1].withColumn("side", F.lit(2)))
    differing = sides.groupBy("id", "term", "mask", "tf").agg(F.sum("side").alias("sides")).filter(F.col("sides") != 3).groupBy("id").agg(F.count("*").alias("n"))
    docs = store.load()[0].docs
    return docs.join(differing, "id", "left").select("id", "name", "ext", "mtime", "size", F.col("cLen").alias("c_len"), F.size("tags").alias("n_tags"), F.coalesce("n", F.lit(0)).alias("n_differing"))


def queries() -> dict[str, Query]:
    plain = [
        tokenize_documents_tf, tokenize_documents_lower_tf, tokenize_values, postings_multifield, postings_full_text, doc_frequency, idf_table, corpus_size,
        search_decorated, hit_field_labels, snippet_documents, highlight_names, markup_stripped, markup_clean_text, escape_html,
        format_bytes, format_time, group_of_ext, index_stats, stats_by_group, stats_by_method, facet_tags_top18, facet_folders_top14, coverage_overview,
        warnings_grouped, incr_changed, incr_deleted, incr_postings_survivors, incr_equals_full,
    ]
    return {f.__name__: f for f in plain} | {name: _search(name) for name in SEARCHES if name != "search_decorated"} | {name: _summary(of) for name, of in SUMMARIES.items()}


# ---------------------------------------------------------------- SQL


def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _re2(ranges: str) -> str:
    return "".join("-".join(rf"\x{{{x}}}" for x in r.split("-")) for r in ranges.split())


_ITEMS = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY modificationTime DESC) AS rn FROM metadata WHERE id IS NOT NULL) WHERE rn = 1),
fname AS (SELECT id AS fid, name AS label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at DESC, name DESC NULLS LAST) AS rn FROM folders) WHERE rn = 1),
fold AS (SELECT id, list(coalesce(label, f) ORDER BY pos) AS names FROM (SELECT id, unnest(folders) AS f, generate_subscripts(folders, 1) AS pos FROM cur) LEFT JOIN fname ON f = fid WHERE f <> '' GROUP BY id),
item AS (SELECT cur.id, coalesce(name, '') AS name, coalesce(annotation, '') AS annotation, coalesce(url, '') AS url, coalesce(star, 0) AS star, coalesce(isDeleted, false) AS gone,
  coalesce(list_filter(tags, lambda t: t <> ''), []) AS tags, coalesce(names, []) AS folders FROM cur LEFT JOIN fold ON cur.id = fold.id)"""

_LIBRARY = f"""{_ITEMS},
lib_docs AS (SELECT d.*, coalesce(i.tags, []) AS tags, coalesce(i.folders, []) AS folders, coalesce(i.star, 0) AS star, coalesce(i.url, '') AS url, coalesce(i.annotation, '') AS annotation
  FROM (SELECT DISTINCT * FROM docs WHERE idx IS NOT NULL) d LEFT JOIN item i ON d.id = i.id),
lib_postings AS (SELECT term, idx, bit_or(mask) AS mask, max(tf) AS tf FROM postings GROUP BY term, idx),
newest AS (SELECT item_id, text FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY added_at DESC NULLS LAST, doc_id DESC) AS rn FROM documents WHERE item_id IS NOT NULL) WHERE rn = 1),
lib_texts AS (SELECT DISTINCT idx, coalesce(text, '') AS content FROM docs JOIN newest ON docs.id = newest.item_id)"""

_GROUP = "CASE " + " ".join(f"WHEN lower(coalesce(ext, '')) IN ({_quoted(members)}) THEN '{g}'" for g, members in EXT_GROUPS.items()) + " ELSE 'other' END"


def _has(column: str, part: str) -> str:
    return f"len(list_filter({column}, lambda t: contains(lower(t), '{part}'))) > 0"


class Asked(NamedTuple):
    """What a search asks for, stated by hand: terms, literals, excluded terms and literals, restriction of docs, the query in lower case."""

    terms: tuple[str, ...] = ()
    literals: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    without_literals: tuple[str, ...] = ()
    where: str = "true"
    flat: str = ""


_WORD = "ext IN ('docx', 'doc', 'rtf', 'odt', 'wps')"
_PDF_OR_TEXT = "ext IN ('pdf', 'txt', 'md', 'markdown', 'log', 'tex', 'bib', 'srt', 'vtt', 'json', 'xml', 'yaml', 'yml', 'py', 'js', 'ts', 'r', 'sh', 'sql', 'java', 'c', 'cpp', 'html', 'htm')"
_SIX = ("tezilel", "fopipa", "neperux", "mino", "gusitoth", "bemogi")
ASKED = {
    "search_single_term": Asked(("reference",), flat="reference"),
    "search_and_two_terms": Asked(("reference", "2d"), flat="reference 2d"),
    "search_and_three_terms": Asked(("reference", "2d", "23316"), flat="reference 2d 23316"),
    "search_or_fallback_unknown_term": Asked(("reference", "nosuchterm", "2d"), flat="reference nosuchterm 2d"),
    "search_or_fallback_empty_intersection": Asked(_SIX, flat="tezilel fopipa neperux mino gusitoth bemogi"),
    "search_exclude_term": Asked(("2d",), without=("reference",), flat="2d -reference"),
    "search_exclude_multi_token": Asked(("reference",), without=("mino/2d", "23316.2d", "lime"), flat="reference -mino/2d -23316.2d -lime"),
    "search_filter_ext": Asked(("reference",), where="ext IN ('pdf', 'docx')", flat="reference ext:.pdf ext:docx"),
    "search_filter_type_group": Asked(("reference",), where=_WORD, flat="reference type:word"),
    "search_filter_type_unknown": Asked(("reference",), where="ext = 'epub'", flat="reference type:epub"),
    "search_filter_tag_substring": Asked(("reference",), where=f"{_has('tags', '2')} AND {_has('tags', '批次')}", flat="reference tag:2 tag:批次"),
    "search_filter_folder": Asked(("2d",), where=_has("folders", "归档"), flat="2d folder:归档"),
    "search_filter_star": Asked(("reference",), where="star >= 4", flat="reference star:>=4"),
    "search_filter_star_upper": Asked(("reference",), flat="reference star:5 star:<3"),
    "search_filters_emptied_no_fallback": Asked(("reference", "2d"), where="ext = 'xyz'", flat="reference 2d ext:xyz"),
    "search_minus_filter_is_positive": Asked(("reference",), where="ext = 'pdf'", flat="reference -ext:pdf size:3"),
    "search_extra_filters": Asked(("2d",), where=f"{_PDF_OR_TEXT} AND {_has('tags', '资料')} AND star >= 4", flat="2d star:3"),
    "search_phrase_verified": Asked(("index", "card", "reference"), ("the", "index card"), flat='"the"  reference "index card"'),
    "search_phrase_absent": Asked(("such", "phrase", "anywhere", "reference"), ("no such phrase anywhere",), flat='reference "no such phrase anywhere"'),
    "search_han_word": Asked(("索", "引", "索引"), ("索引",), flat="索引"),
    "search_han_negative": Asked(("索", "引", "索引", "2d"), ("索引",), ("扫", "描", "扫描"), ("扫描",), flat="索引 2d -扫描"),
    "search_title_boost": Asked(("2d",), flat="2d"),
    "search_sort_mtime": Asked(("reference", "2d"), flat="reference 2d"),
    "search_sort_name": Asked(("reference",), flat="reference"),
    "search_sort_name_zh": Asked(("reference",), flat="reference"),
    "search_decorated": Asked(("index", "card", "reference"), ("index card",), flat='reference "index card"'),
    "browse_mtime": Asked(),
    "browse_name_filtered": Asked(where="ext = 'pdf' AND star >= 3"),
    "browse_only_negatives": Asked(without=("reference",)),
    "browse_tag_two_words_quirk": Asked(("reference", "tag"), ("reference",), flat='tag:"reference"'),
}


_ORDERS = {"relevance": "score DESC, base DESC, mtime DESC, idx", "mtime": "mtime DESC, idx", "name_binary": "name, idx", "name": "name COLLATE zh, idx"}


def _search_ctes(name: str) -> str:
    _, _, sort, limit = SEARCHES[name]
    p = ASKED[name]
    where = p.where
    if not p.terms:
        order = _ORDERS["mtime" if sort == "relevance" else sort]
        return f"""WITH {_LIBRARY}, cands AS (SELECT *, 0.0::DOUBLE AS score, 0.0::DOUBLE AS base, 0 AS mask, 0::BIGINT AS matched, false AS partial FROM lib_docs WHERE {where}),
final AS (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM cands QUALIFY rank <= {limit})"""
    order = _ORDERS[sort]
    weight = " + ".join(f"CASE WHEN mask & {MASK[f]} <> 0 THEN {w}::DOUBLE ELSE 0 END" for f, w in WEIGHTS.items())
    boost = f"CASE WHEN contains(lower(name), {_quoted([p.flat])}) THEN 1.8::DOUBLE ELSE 1 END" if sort == "relevance" else "1"
    negative = f"AND idx NOT IN (SELECT idx FROM lib_postings WHERE term IN ({_quoted(p.without)}))" if p.without else ""
    checks = ["true"] + [f"(contains(lower(coalesce(content, '')), {q}) OR contains(lower(annotation), {q}) OR contains(lower(name), {q}))" for q in (_quoted([x]) for x in p.literals)]
    checks += [f"NOT contains(lower(coalesce(content, '')), {_quoted([x])})" for x in p.without_literals]
    return f"""WITH {_LIBRARY},
hit AS (SELECT * FROM lib_postings WHERE term IN ({_quoted(p.terms)})),
df AS (SELECT term, count(*)::DOUBLE AS df FROM hit GROUP BY term),
weighted AS (SELECT idx, mask, df, {weight} + CASE WHEN mask & 16 <> 0 THEN 1.2::DOUBLE * tf / (tf + 1) ELSE 0 END AS w FROM hit JOIN df USING (term)),
summed AS (SELECT idx, round(sum(ln(1 + ((SELECT count(*) FROM lib_docs) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (w / (w + 1.2::DOUBLE))), 10) AS s, bit_or(mask) AS mask, count(*) AS matched FROM weighted GROUP BY idx),
chosen AS (SELECT CASE WHEN coalesce(max(matched), 0) = {len(p.terms)} THEN 'and' ELSE 'or' END AS mode FROM summed),
picked AS (SELECT idx, mask, matched, CASE WHEN mode = 'and' THEN s ELSE round(s * (0.35::DOUBLE + 0.65::DOUBLE * matched / known), 10) END AS base, mode = 'or' AND matched < known AS partial
  FROM summed, chosen, (SELECT count(*) AS known FROM df) WHERE mode = 'or' OR matched = {len(p.terms)}),
cands AS (SELECT picked.*, lib_docs.* EXCLUDE (idx), base * {boost} AS score FROM picked JOIN lib_docs USING (idx) WHERE {where} {negative}),
pool AS (SELECT * FROM cands ORDER BY {order} LIMIT {max(2 * limit, 120)}),
verified AS (SELECT pool.* FROM pool LEFT JOIN lib_texts USING (idx) WHERE {" AND ".join(checks)}),
final AS (SELECT * REPLACE (score * {1.25 if p.literals else 1}::DOUBLE AS score), row_number() OVER (ORDER BY {order}) AS rank FROM verified QUALIFY rank <= {limit})"""


def _summary_sql(name: str) -> str:
    p = ASKED[name]
    total = "final" if p.literals or p.without_literals else "cands"
    if not p.terms:
        return f"{_search_ctes(name)} SELECT 'browse' AS mode, count(*) AS total, 0::BIGINT AS candidates, 0::BIGINT AS partials FROM cands"
    return f"{_search_ctes(name)} SELECT mode, (SELECT count(*) FROM {total}) AS total, (SELECT count(*) FROM cands) AS candidates, (SELECT count(*) FROM final WHERE partial) AS partials FROM chosen"


def _terms_sql(source: str, key: str, field: str) -> str:
    """(key, term) rows of a text column, lower-cased."""
    cjk, word, join = _re2(CJK_RANGES), _re2(WORD_RANGES), JOINERS.replace("-", r"\-").replace("'", "''")
    return f"""
runs AS (SELECT {key}, unnest(regexp_extract_all(lower({field}), '[{cjk}]+|[{word}]+(?:[{join}][{word}]+)*')) AS run FROM {source}),
grams AS (SELECT {key}, unnest(CASE WHEN regexp_matches(run, '^[{cjk}]') THEN list_concat(string_split(run, ''), list_transform(range(1, length(run)), lambda i: substring(run, i, 2))) ELSE [run] END) AS term FROM runs),
terms AS (SELECT * FROM grams WHERE term NOT IN ({_quoted(STOP_WORDS)}) AND (length(term) > 1 OR regexp_matches(term, '[0-9{cjk}]')))"""


_STRIP = [
    ("<script.*?</script>", " ", "gis"), ("<style.*?</style>", " ", "gis"), ("<!--.*?-->", " ", "gs"), (r"<\?.*?\?>", " ", "gs"), (r"<br\s*/?>", "\n", "gi"),
    (f"</(?:{'|'.join(fn.BLOCKS)})>", "\n", "gi"), ("</t[dh]>", "\t", "gi"), ("<li[^>]*>", "\n· ", "gi"), ("<[^>]+>", "", "g"), *[(f"&{k};", v, "gi") for k, v in fn.ENTITIES.items()],
]
_CLEAN = [(r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}]", " ", "g"), (r"[\x{E000}-\x{F8FF}\x{FFFD}]", "", "g"), (r"[ \t\x{A0}]+", " ", "g"), (" ?\n ?", "\n", "g"), ("\n{3,}", "\n\n", "g")]
_SPACE = r"[\s\x{0B}\x{A0}\x{FEFF}\x{3000}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{1680}]+"


def _replaced(expression: str, steps) -> str:
    for pattern, by, flags in steps:
        expression = f"regexp_replace({expression}, {_quoted([pattern])}, {_quoted([by])}, '{flags}')"
    return expression


_ESCAPED = "replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
_PAGES = f"""pages AS (SELECT doc_id, '<html><head><title>' || coalesce(source, '') || '</title><style>p {{ x }}</style></head><BODY><!-- note --><p>' || {_ESCAPED}
 || '</p><ul><li class=''a''>one<br/>two &copy; &middot;&nbsp;&hellip;</li></ul><script>let a = ''<p>'';</script></BODY></html>' AS html FROM documents)"""


def _strip_sql() -> str:
    out = _replaced("html", _STRIP[:9])
    out = f"replace({out}, '&#39;', '''')"
    return _replaced(out, _STRIP[9:])


#: the letters of the highlighted words in every width and case that folds to them
_HIGHLIGHT = "((?:[rRｒＲ][eEｅＥ]|版)+)"


def _snippet_sql(source: str, key: str, text: str, needles: tuple[str, ...], size: int = 260) -> str:
    """(key, text, n_ranges, truncated_head, truncated_tail): the window with most matches of ASCII or Han needles, the earliest of several."""
    starts = "list_concat(" + ", ".join(
        f"list_transform(range(1, len(parts{k})), lambda i: (list_sum(list_transform(parts{k}[:i], lambda p: length(p))) + (i - 1) * {len(n)})::BIGINT)" for k, n in enumerate(needles)
    ) + ")"
    splits = ", ".join(f"string_split(low, '{n}') AS parts{k}" for k, n in enumerate(needles))
    lengths = "CASE " + " ".join(f"WHEN substring(low, s + 1, {len(n)}) = '{n}' THEN {len(n)}" for n in needles) + " END"
    return f"""
sn_low AS (SELECT {key} AS k, {text} AS t, lower({text}) AS low FROM {source} WHERE {text} <> ''),
sn_split AS (SELECT k, t, low, {splits} FROM sn_low),
sn_hit AS (SELECT DISTINCT k, t, s, s + {lengths} AS e FROM (SELECT k, t, low, unnest({starts}) AS s FROM sn_split)),
sn_gap AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until FROM sn_hit),
sn_isle AS (SELECT *, sum(CASE WHEN until IS NULL OR s > until THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e) AS isle FROM sn_gap),
sn_range AS (SELECT k, t, isle, min(s) AS s, max(e) AS e FROM sn_isle GROUP BY k, t, isle),
sn_window AS (SELECT k, t, least(greatest(0, s - {int(size * 0.35)}), greatest(0, length(t) - {size})) AS w, s FROM sn_range),
sn_score AS (SELECT w.k, w.t, w.w, w.s, count(*) AS n FROM sn_window w JOIN sn_range r ON r.k = w.k AND r.s >= w.w AND r.s < w.w + {size} GROUP BY ALL),
sn_best AS (SELECT * FROM sn_score QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, s) = 1),
snippets AS (
  SELECT l.k, substring(l.t, coalesce(b.w, 0) + 1, {size}) AS text, coalesce(b.n, 0)::INTEGER AS n_ranges, coalesce(b.w, 0) > 0 AS truncated_head, coalesce(b.w, 0) + {size} < length(l.t) AS truncated_tail
  FROM sn_low l LEFT JOIN sn_best b ON l.k = b.k)"""


_BYTES = """CASE WHEN size IS NULL OR size = 0 THEN '0 B' WHEN size < 1024 THEN size || ' B'
 WHEN size < 1048576 THEN {} || ' KB' WHEN size < 1073741824 THEN {} || ' MB' ELSE {} || ' GB' END""".format(*[f"CASE WHEN size / {k}.0 >= 100 THEN printf('%.0f', floor(size / {k}::DOUBLE + 0.5)) ELSE printf('%.1f', floor(size / {k}::DOUBLE * 10 + 0.5) / 10) END" for k in (1024, 1024**2, 1024**3)])

_LISTED = """
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY modificationTime DESC) AS rn FROM metadata WHERE id IS NOT NULL) WHERE rn = 1),
listed AS (SELECT id, mtime, lower(ext) AS ext, size FROM cur WHERE NOT coalesce(isDeleted, false)),
changed AS (SELECT DISTINCT l.id FROM listed l LEFT JOIN docs d ON l.id = d.id WHERE d.id IS NULL OR l.mtime IS DISTINCT FROM d.mtime OR l.ext IS DISTINCT FROM d.ext OR l.size IS DISTINCT FROM d.size),
removed AS (SELECT DISTINCT id FROM docs WHERE id NOT IN (SELECT id FROM listed))"""


def oracle_sql() -> dict[str, str]:
    samples = ", ".join(f"({k}, {_quoted([s])})" for k, s in enumerate(SAMPLES))
    fields = " UNION ALL ".join(f"SELECT id, {MASK[f]} AS mask, {c} AS field FROM item WHERE NOT gone" for f, c in (("name", "name"), ("annotation", "annotation"), ("tags", "array_to_string(tags, ' ')"), ("folders", "array_to_string(folders, ' ')"), ("url", "url")))
    fields += f" UNION ALL SELECT item.id, {MASK['content']}, text FROM item JOIN newest ON item.id = item_id WHERE NOT gone"
    top = lambda column, k: f"WITH {_LIBRARY} SELECT value, count(*) AS n FROM (SELECT unnest({column}) AS value FROM lib_docs) WHERE value IS NOT NULL GROUP BY value ORDER BY n DESC, value LIMIT {k}"
    labels = {1: "标题", 2: "注释", 4: "标签", 8: "文件夹", 32: "链接", 16: "正文"}
    thousands = lambda x: f"format('{{:,}}', ({x})::BIGINT)"
    sql = {
        "snippet_documents": f"WITH {_snippet_sql('documents', 'doc_id', 'text', ('index card', '索引卡'))} SELECT doc_id, s.text, n_ranges, truncated_head, truncated_tail FROM documents LEFT JOIN snippets s ON doc_id = k",
        "highlight_names": f"WITH n AS (SELECT DISTINCT idx, name AS text FROM docs) SELECT idx, regexp_replace({_ESCAPED}, '{_HIGHLIGHT}', '<mark class=\"hit\">\\1</mark>', 'g') AS html FROM n",
        "tokenize_documents_lower_tf": f"WITH {_terms_sql('documents', 'doc_id', 'text')} SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL",
        "tokenize_values": f"WITH v(k, s) AS (VALUES {samples}), {_terms_sql('v', 'k', 's')} SELECT k::INTEGER AS k, term, count(*) AS tf FROM terms GROUP BY ALL",
        "postings_multifield": f"WITH {_LIBRARY}, fields AS ({fields}), {_terms_sql('fields', 'id, mask', 'field')} SELECT term, id, bit_or(mask) AS mask, count(*) AS tf FROM terms GROUP BY term, id",
        "doc_frequency": f"WITH {_LIBRARY} SELECT term, count(*) AS df FROM lib_postings GROUP BY term",
        "idf_table": f"WITH {_LIBRARY} SELECT term, round(ln(1 + ((SELECT count(*) FROM lib_docs) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)), 6) AS idf FROM lib_postings GROUP BY term",
        "corpus_size": f"WITH {_LIBRARY} SELECT count(*) AS n_docs FROM lib_docs",
        "hit_field_labels": f"WITH {_LIBRARY} SELECT idx, concat_ws(',', {', '.join(f'CASE WHEN mask & {b} <> 0 THEN {_quoted([x])} END' for b, x in labels.items())}) AS fields FROM lib_postings WHERE term = 'reference'",
        "markup_stripped": f"WITH {_PAGES} SELECT doc_id, {_strip_sql()} AS text FROM pages",
        "markup_clean_text": f"WITH {_PAGES} SELECT doc_id, {_replaced(_replaced(_strip_sql(), _CLEAN), [(f'^{_SPACE}', '', 'g'), (f'{_SPACE}$', '', 'g')])} AS text FROM pages",
        "escape_html": f"SELECT doc_id, {_ESCAPED} AS html FROM documents",
        "format_bytes": f"SELECT DISTINCT size, {_BYTES} AS shown FROM docs",
        "format_time": f"""SELECT DISTINCT mtime, CASE WHEN mtime IS NULL OR mtime = 0 THEN '' WHEN {NOW} - mtime < 60000 THEN '刚刚' WHEN {NOW} - mtime < 3600000 THEN (({NOW} - mtime) // 60000) || ' 分钟前'
 WHEN {NOW} - mtime < 86400000 THEN (({NOW} - mtime) // 3600000) || ' 小时前' WHEN {NOW} - mtime < 2592000000 THEN (({NOW} - mtime) // 86400000) || ' 天前' ELSE strftime(epoch_ms(mtime), '%Y-%m-%d') END AS shown FROM docs""",
        "group_of_ext": f'SELECT DISTINCT ext, {_GROUP} AS "group" FROM metadata',
        "index_stats": f"WITH {_LIBRARY} SELECT count(*) AS docs, count(*) FILTER (cLen > 0) AS with_text, sum(size)::BIGINT AS bytes, (SELECT count(DISTINCT term) FROM lib_postings) AS terms FROM lib_docs",
        "stats_by_group": f'WITH {_LIBRARY} SELECT {_GROUP} AS "group", count(*) AS n FROM lib_docs GROUP BY ALL',
        "stats_by_method": f"WITH {_LIBRARY} SELECT CASE WHEN coalesce(method, '') = '' THEN 'skip' ELSE method END AS method, count(*) AS n FROM lib_docs GROUP BY ALL",
        "facet_tags_top18": top("tags", facets.TAGS),
        "facet_folders_top14": top("folders", facets.FOLDERS),
        "coverage_overview": f"""WITH {_LIBRARY}, t AS (SELECT count(*) AS docs, count(*) FILTER (cLen > 0) AS w, sum(size)::BIGINT AS size FROM lib_docs)
SELECT {thousands("docs")} AS docs, {thousands("w")} AS with_text, floor(w * 100.0 / docs + 0.5)::BIGINT || '%' AS coverage, {thousands("SELECT count(DISTINCT term) FROM lib_postings")} AS terms, {_BYTES} AS size FROM t""",
        "warnings_grouped": f"""WITH {_LIBRARY}, w AS (SELECT warn, coalesce(name, '') || '.' || coalesce(ext, '') AS example, regexp_replace(warn, '[0-9]+', 'N', 'g') AS kind FROM lib_docs WHERE warn <> ''),
r AS (SELECT *, count(*) OVER (PARTITION BY kind) AS n, row_number() OVER (PARTITION BY kind ORDER BY warn, example) AS rn FROM w)
SELECT kind, n, warn, example FROM r WHERE rn = 1 ORDER BY warn, example LIMIT {facets.WARNINGS}""",
        "incr_equals_full": f"""WITH {_LIBRARY}, live AS (SELECT * FROM cur WHERE NOT coalesce(isDeleted, false))
SELECT item.id, item.name, coalesce(ext, '') AS ext, coalesce(mtime, 0) AS mtime, coalesce(size, 0) AS size, length(coalesce(text, '')) AS c_len, len(item.tags)::INTEGER AS n_tags, 0::BIGINT AS n_differing
  FROM item JOIN live ON item.id = live.id LEFT JOIN newest ON item.id = item_id""",
        "incr_changed": f"WITH {_LISTED} SELECT id FROM changed",
        "incr_deleted": f"WITH {_LISTED} SELECT id FROM removed",
        "incr_postings_survivors": f"""WITH {_LISTED}, gone AS (SELECT idx FROM docs WHERE id IN (SELECT id FROM changed UNION SELECT id FROM removed))
SELECT term, idx, bit_or(mask) AS mask, max(tf) AS tf FROM postings WHERE idx NOT IN (SELECT idx FROM gone) GROUP BY term, idx""",
    }
    shown = "SELECT rank, idx, id, name, round(score, 6) AS score, mask, matched, partial FROM final"
    labelled = ", ".join(f"CASE WHEN mask & {b} <> 0 THEN {_quoted([x])} END" for b, x in labels.items())
    sql["search_decorated"] = f"""{_search_ctes("search_decorated")},
bodies AS (SELECT final.idx, CASE WHEN coalesce(content, '') <> '' THEN content ELSE annotation END AS body FROM final LEFT JOIN lib_texts ON final.idx = lib_texts.idx), {_snippet_sql("bodies", "idx", "body", ("index card", "reference"))}
SELECT rank, idx, concat_ws(',', {labelled}) AS fields, {_GROUP} AS "group", len(regexp_extract_all(name, '(?i)(?:index card|reference)+'))::INTEGER AS n_name_ranges, s.text, n_ranges, round(score, 6) AS score FROM final LEFT JOIN snippets s ON idx = k"""
    return sql | {name: f"{_search_ctes(name)} {shown}" for name in SEARCHES if name != "search_decorated"} | {name: _summary_sql(of) for name, of in SUMMARIES.items()}
