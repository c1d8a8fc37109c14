"""Queries on the upkeep of a library: changed files per build, and references that lead nowhere."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.operators.orphans import PendingOrphans, library_batches
from foliant.plans.stage import new_folder
from foliant.sources.tables import table
from foliant.streaming.incremental import replay_builds


def p3_changes(spark: SparkSession, at: str) -> DataFrame:
    """Per successful build after the first: files that are new, changed or gone."""
    return replay_builds(table(spark, at, "scans"), table(spark, at, "builds"), new_folder(spark, "builds"))


def p3_found(spark: SparkSession, at: str) -> DataFrame:
    return p3_changes(spark, at).select("run_no", "id")


def _tracked(spark: SparkSession, at: str) -> PendingOrphans:
    """The state after the library's batches: references and parents arrive, change and go in the order of their times."""
    state = PendingOrphans(spark, new_folder(spark, "orphans"), buckets=8)
    for batch in library_batches(*(table(spark, at, name) for name in ("metadata", "docs", "documents", "folders"))):
        state.apply(*batch)
    return state


def p4_found(spark: SparkSession, at: str) -> DataFrame:
    return _tracked(spark, at).state().pending.select("src", "src_key", "ref").distinct()


def p4_report(spark: SparkSession, at: str) -> DataFrame:
    """References and orphans per table and month."""
    return _tracked(spark, at).snapshot()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p3_found, p3_changes, p4_found, p4_report)}


_CHANGES = """
WITH ok AS (SELECT run_no, row_number() OVER (ORDER BY run_no) AS seq FROM (SELECT DISTINCT run_no FROM builds WHERE status = 'ok')),
latest AS (SELECT * FROM (SELECT s.*, ok.seq, row_number() OVER (PARTITION BY s.run_no, id ORDER BY seen_at DESC) AS rn FROM scans s JOIN ok USING (run_no)) WHERE rn = 1),
present AS (SELECT seq, id, mtime, size, lower(ext) AS ext FROM latest WHERE NOT coalesce(isDeleted, false)),
moved AS (SELECT seq + 1 AS seq, id, mtime, size, ext FROM present),
both_sides AS (
  SELECT coalesce(n.seq, o.seq) AS seq, coalesce(n.id, o.id) AS id,
    CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'gone'
      WHEN n.mtime IS DISTINCT FROM o.mtime OR n.size IS DISTINCT FROM o.size OR n.ext IS DISTINCT FROM o.ext THEN 'changed' END AS change
  FROM present n FULL JOIN moved o ON n.seq = o.seq AND n.id = o.id)"""

_ORPHANS = """
WITH current_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY modificationTime DESC) AS rn FROM metadata WHERE id IS NOT NULL) WHERE rn = 1),
live AS (SELECT id FROM current_rows WHERE NOT coalesce(isDeleted, false)),
refs AS (
  SELECT DISTINCT 'metadata' AS src, id AS src_key, ref, epoch_ms(modificationTime) AS t, strftime(epoch_ms(modificationTime), '%Y-%m') AS period FROM (SELECT id, modificationTime, unnest(folders) AS ref FROM current_rows) WHERE ref <> ''
  UNION ALL SELECT DISTINCT 'docs', idx::VARCHAR, id, NULL, strftime(epoch_ms(addedAt), '%Y-%m') FROM docs WHERE id IS NOT NULL
  UNION ALL SELECT DISTINCT 'documents', doc_id::VARCHAR, item_id, NULL, strftime(added_at, '%Y-%m') FROM documents WHERE item_id IS NOT NULL),
orphans AS (
  SELECT * FROM refs WHERE src = 'metadata' AND NOT EXISTS (SELECT 1 FROM folders f WHERE f.id = refs.ref AND f.created_at <= refs.t AND (f.removed_at IS NULL OR f.removed_at > refs.t))
  UNION ALL SELECT * FROM refs WHERE src <> 'metadata' AND ref NOT IN (SELECT id FROM live))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_changes": f"{_CHANGES} SELECT ok.run_no, id, change FROM both_sides JOIN ok USING (seq) WHERE seq > 1 AND change IS NOT NULL",
        "p3_found": f"{_CHANGES} SELECT ok.run_no, id FROM both_sides JOIN ok USING (seq) WHERE seq > 1 AND change IS NOT NULL",
        "p4_found": f"{_ORPHANS} SELECT DISTINCT src, src_key, ref FROM orphans",
        "p4_report": f"""{_ORPHANS},
each AS (SELECT src, src_key, ref, period, max(orphan) AS orphan FROM (SELECT src, src_key, ref, period, 0 AS orphan FROM refs UNION ALL SELECT src, src_key, ref, period, 1 FROM orphans) GROUP BY ALL)
SELECT src, period, count(*) AS n_references, sum(orphan)::BIGINT AS n_orphans FROM each GROUP BY src, period""",
    }
