"""Ranked retrieval over the index tables as one lazy plan.

``postings`` (term, idx, mask, tf) is filtered by the query's terms, which reaches the
scan; one aggregation by document gives score, fields and the number of matched terms, from
which both the all-terms and the any-term answer follow. Texts are joined only to the
bounded pool of best candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.config import EXT_GROUPS, FIELD_LABELS, K1, MASK, PARTIAL_FLOOR, PHRASE_BOOST, TITLE_BOOST, WEIGHTS
from foliant.functions.text import fold, folded, folded_units, group_of_ext
from foliant.operators.query import Filters, ParsedQuery, parse_query
from foliant.operators.snippet import ranges_of, snippet_of


@dataclass
class Index:
    """The tables of an index: docs by idx, postings unique by (term, idx), texts (idx, content); ``n_docs`` where it is known."""

    docs: DataFrame
    postings: DataFrame
    texts: DataFrame
    n_docs: int | None = None


@dataclass
class Result:
    """``hits`` in rank order (column ``rank``), ``summary`` of one row, and what was asked."""

    hits: DataFrame
    summary: DataFrame
    parsed: ParsedQuery
    filters: Filters


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def has(mask: Column, name: str) -> Column:
    return mask.bitwiseAND(F.lit(MASK[name])) != 0


def term_weight(mask: Column, tf: Column) -> Column:
    """Weights of the fields that hold the term, and a saturating share for its frequency where the content does."""
    weight = sum((F.when(has(mask, name), F.lit(w)).otherwise(0.0) for name, w in WEIGHTS.items()), F.lit(0.0))
    return weight + F.when(has(mask, "content"), K1 * tf / (tf + 1)).otherwise(0.0)


def field_labels(mask: Column) -> Column:
    """The names of the fields in a mask, in fixed order."""
    return F.filter(F.array(*[F.when(has(mask, name), F.lit(label)) for name, label in FIELD_LABELS.items()]), lambda x: x.isNotNull())


def _any_contains(column: str, part: str) -> Column:
    return F.exists(column, lambda t: F.contains(F.lower(t), F.lit(part)))


def matches(filters: Filters) -> Column:
    """The filters as one predicate on docs."""
    ok = F.lit(True)
    if filters.exts:
        ok &= F.col("ext").isin(*filters.exts)
    if filters.groups:
        ok &= F.col("ext").isin(*[e for g in filters.groups for e in EXT_GROUPS.get(g, [])])
    if filters.star_min > 0:
        ok &= F.coalesce(F.col("star"), F.lit(0)) >= filters.star_min
    for name, wanted in (("tags", filters.tags), ("folders", filters.folders)):
        for w in wanted:
            ok &= F.coalesce(_any_contains(name, w.lower()), F.lit(False))
    return F.coalesce(ok, F.lit(False))


def term_frequencies(postings: DataFrame, terms: list[str]) -> dict[str, int]:
    """The number of documents of each term that the index has; at most a row for each query term comes to the driver."""
    return {r.term: r["count"] for r in postings.filter(F.col("term").isin(*terms)).groupBy("term").count().collect()}


def score_terms(postings: DataFrame, known: dict[str, int], n_docs: int) -> DataFrame:
    """(idx, score, mask, matched) of every document with one of the ``known`` terms, given their document frequencies.

    Sums are rounded to ten decimals, so that equal scores tie whatever the order of summing.
    """
    if not known:
        return postings.limit(0).select("idx", F.lit(0.0).alias("score"), "mask", F.lit(0).cast("long").alias("matched"))
    hit = postings.filter(F.col("term").isin(*known))
    rarity = F.create_map(*[F.lit(x) for term, df in known.items() for x in (term, math.log(1 + (n_docs - df + 0.5) / (df + 0.5)))])
    weight = term_weight(F.col("mask"), F.col("tf"))
    part = F.element_at(rarity, F.col("term")) * (weight / (weight + K1))
    return hit.groupBy("idx").agg(F.round(F.sum(part), 10).alias("score"), F.bit_or("mask").alias("mask"), F.count("*").alias("matched"))


def choose_mode(scored: DataFrame, need: int, known: int) -> tuple[str, DataFrame]:
    """All-terms matches if there are any, else any-term matches with their score lowered by coverage.

    Decided on the index alone, before any filter or exclusion; what the known terms don't decide, one look for a full match does.
    """
    if known == need and (need == 1 or not scored.filter(F.col("matched") == need).isEmpty()):
        return "and", scored.filter(F.col("matched") == need).withColumn("partial", F.lit(False))
    share = PARTIAL_FLOOR + (1 - PARTIAL_FLOOR) * F.col("matched") / F.lit(known or 1)
    return "or", scored.withColumn("score", F.round(F.col("score") * share, 10)).withColumn("partial", F.col("matched") < known)


def _order(sort: str) -> list[Column]:
    return {
        "relevance": [F.desc("score"), F.desc("base"), F.desc("mtime"), F.asc("idx")],
        "mtime": [F.desc("mtime"), F.asc("idx")],
        "name": [F.collate(F.col("name"), "zh").asc(), F.asc("idx")],
        "name_binary": [F.asc("name"), F.asc("idx")],
    }[sort]


def _ranked(frame: DataFrame, sort: str, limit: int) -> DataFrame:
    return frame.orderBy(*_order(sort)).limit(limit)


def _with_rank(top: DataFrame, sort: str) -> DataFrame:
    """Number the returned rows, which are at most the limit."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*_order(sort))))


def _decorate(top: DataFrame, index: Index, parsed: ParsedQuery, read: bool) -> DataFrame:
    """Labels, match ranges and snippets of the hits that are returned."""
    if read:
        top = top.join(index.texts.select("idx", F.col("content").alias("_text")), "idx", "left")
    else:
        top = top.withColumn("_text", F.lit(None).cast("string"))
    body = F.when(F.coalesce(F.col("_text"), F.lit("")) != "", F.col("_text")).otherwise(F.col("annotation"))
    return (
        top.withColumn("fields", field_labels(F.col("mask")))
        .withColumn("group", group_of_ext("ext"))
        .withColumn("name_ranges", ranges_of(F.col("name"), parsed.surfaces))
        .withColumn("snip", snippet_of(body, parsed.surfaces))
        .drop("_text")
    )


def search(index: Index, query: str | None, extra: Filters | None = None, sort: str = "relevance", limit: int = 60, snippets: bool = True) -> Result:
    """Answer a query over an index.

    All terms must occur; if no document has them all, any may (``partial`` marks documents
    that lack some of the known ones, and their score falls with coverage). Literals must
    occur verbatim in text, annotation or name, and excluded ones must not in the text; both
    are checked on the best ``max(2 * limit, 120)`` candidates. A query without terms lists
    documents by time or name and ignores exclusions. ``sort`` is relevance, mtime or name
    (``name_binary`` for code-point order). Ties end with the smaller idx.
    """
    parsed = parse_query(query)
    filters = parsed.filters.merged(extra)
    docs = index.docs
    allowed = docs.filter(matches(filters)) if filters else docs
    if not parsed.terms:
        hits = _ranked(allowed, "mtime" if sort == "relevance" else sort, limit)
        hits = hits.withColumns({"score": F.lit(0.0), "base": F.lit(0.0), "mask": F.lit(0), "matched": F.lit(0).cast("long"), "partial": F.lit(False)})
        hits = _with_rank(hits, "mtime" if sort == "relevance" else sort)
        summary = allowed.agg(F.lit("browse").alias("mode"), F.count("*").alias("total"), F.lit(0).cast("long").alias("candidates"), F.lit(0).cast("long").alias("partials"))
        return Result(_decorate(hits, index, parsed, False) if snippets else hits, summary, parsed, filters)

    n_docs = docs.count() if index.n_docs is None else index.n_docs
    known = term_frequencies(index.postings, parsed.terms)
    mode, picked = choose_mode(score_terms(index.postings, known, n_docs), len(parsed.terms), len(known))
    if parsed.neg_terms:
        picked = picked.join(index.postings.filter(F.col("term").isin(*parsed.neg_terms)).select("idx").distinct(), "idx", "left_anti")
    cands = picked.join(allowed, "idx").withColumn("base", F.col("score"))
    flat = fold(parsed.raw).strip()
    if sort == "relevance" and flat:
        cands = cands.withColumn("score", F.when(F.contains(_folded_name(docs), F.lit(flat)), F.col("base") * TITLE_BOOST).otherwise(F.col("base")))
    best = _ranked(cands, sort, max(2 * limit, 120))
    verify = bool(parsed.literals or parsed.neg_literals)
    if verify:
        best = best.join(index.texts.select("idx", "content"), "idx", "left")
        best = best.withColumns({"_body": folded_units("content"), "_note": folded("annotation"), "_name": _folded_name(docs)})
        for literal in map(fold, parsed.literals):
            best = best.filter(F.contains("_body", F.lit(literal)) | F.contains("_note", F.lit(literal)) | F.contains("_name", F.lit(literal)))
        for literal in map(fold, parsed.neg_literals):
            best = best.filter(~F.contains("_body", F.lit(literal)))
        best = best.drop("content", "_body", "_note", "_name")
    final = _with_rank(_ranked(best, sort, limit), sort)
    shown = final.withColumn("score", F.col("score") * PHRASE_BOOST) if parsed.literals else final
    counts = final.agg(F.count("*").alias("found"), F.count_if("partial").alias("partials"))
    summary = counts.select(
        F.lit(mode).alias("mode"),
        (F.col("found") if verify else cands.agg(F.count("*").alias("n")).scalar()).alias("total"),
        cands.agg(F.count("*").alias("n")).scalar().alias("candidates"),
        "partials",
    )
    return Result(_decorate(shown, index, parsed, True) if snippets else shown, summary, parsed, filters)


def _folded_name(docs: DataFrame) -> Column:
    """The folded name as stored with the index, computed here only for docs that lack it."""
    return F.col("folded_name") if "folded_name" in docs.columns else folded("name")


def explain_empty(found: int, verified: bool, candidates: int, filters: Filters) -> str:
    """Why a query has no hits: ``phrase`` if candidates lack the exact wording, ``filter`` if types are restricted, else empty; empty too if there are hits."""
    if found:
        return ""
    if verified and candidates:
        return "phrase"
    return "filter" if filters.exts or filters.groups else ""
