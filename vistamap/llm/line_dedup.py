"""Removal of boilerplate lines that are spread over many sites.

A HyperLogLog sketch of the sites of each line merges by aggregation, so a line on a third of all pages costs each
task one sketch. Lines whose estimate is within `margin` standard errors of the threshold get an exact distinct count.
A line on `sites` sites or more goes everywhere but at its first place (smallest doc_id, then text hash, then position),
so no sentence leaves the corpus altogether.

Lines are separated by \\n and compared after trimming spaces and lower-casing; blank lines always stay.
Built-in functions only.

Nulls: a null text stays null and has no lines; a null site counts as no site; a null doc_id sorts first. Rows alike
in doc_id and text are treated alike. An empty table gives an empty result. Other columns are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import saved, work_dir

SITES = 10
LG_K = 10
#: Rows of the boilerplate table up to which it is broadcast; a row takes about 50 bytes.
BROADCAST_ROWS = 50_000


def normal(line: Column) -> Column:
    return F.lower(F.trim(line))


def exploded(docs: DataFrame, text: str, site: str, key: str) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("of"), F.col(site).alias("site"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    return rows.withColumn("line", normal(F.col("line"))).where(F.col("line") != "").select("doc", "of", "site", "pos", F.xxhash64("line").alias("h"), F.length("line").alias("n"))


def boilerplate(lines: DataFrame, sites: int = SITES, lg_k: int = LG_K, margin: float = 3.0) -> DataFrame:
    """h, n, first of each line on `sites` distinct sites or more."""
    error = margin * 1.04 / 2 ** (lg_k / 2)
    named = F.concat(F.lit("s"), F.col("site"))  # sketches ignore empty strings; null stays null
    merged = lines.groupBy("h", "n").agg(F.hll_sketch_agg(named, F.lit(lg_k)).alias("sketch"), F.min(F.struct("doc", "of", "pos")).alias("first"))
    spread = saved(
        merged.withColumn("estimate", F.hll_sketch_estimate("sketch")).where(F.col("estimate") >= sites * (1 - error)).select("h", "n", "first", "estimate"),
        work_dir(lines.sparkSession, "spread"),
    )
    near = spread.where(F.col("estimate") <= sites * (1 + error)).select("h", "n")
    exact = lines.join(small(near), ["h", "n"], "left_semi").groupBy("h", "n").agg(F.count_distinct("site").alias("exact"))
    return spread.join(exact, ["h", "n"], "left").where(F.coalesce("exact", "estimate") >= sites).select("h", "n", "first")


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint where a count shows that the table is small; a shuffle join otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def line_dedup(docs: DataFrame, text: str = "text", site: str = "source", key: str = "doc_id", sites: int = SITES) -> DataFrame:
    """docs with the text that is left, and n_lines, n_removed (long; 0 for a null text)."""
    lines = exploded(docs, text, site, key)
    found = saved(boilerplate(lines, sites), work_dir(docs.sparkSession, "boilerplate"))
    again = lines.join(small(found), ["h", "n"]).where(~F.struct("doc", "of", "pos").eqNullSafe(F.col("first")))
    gone = again.groupBy("doc", "of").agg(F.collect_set("pos").alias("__gone")).withColumnsRenamed({"doc": "__doc", "of": "__of"})
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    base = docs.select(*kept).withColumn("__key", F.xxhash64(text))
    all_ = F.split(text, "\n")
    joined = base.join(gone, base[key].eqNullSafe(gone["__doc"]) & (base["__key"] == gone["__of"]), "left")
    left = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col("__gone"))
    return joined.select(
        *(c for c in kept if c != text),
        F.when(F.col("__gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(all_, i)), "\n")).alias(text),
        F.when(F.col(text).isNull(), 0).otherwise(F.size(all_)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    ).select(*kept, "n_lines", "n_removed")


#: The same over DuckDB's `documents`; it counts every line exactly. xxhash64 decides ties only between rows that
#: share a doc_id, which this table has none of.
SQL = f"""
with lines as (
  select doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos, unnest(string_split(text, chr(10))) raw from documents),
keyed as (select *, lower(trim(raw, ' ')) line from lines),
spread as (select line, min((doc_id, pos)) first from keyed where line <> '' group by line having count(distinct source) >= {SITES}),
marked as (select k.*, s.line is not null and (k.doc_id, k.pos) <> s.first gone from keyed k left join spread s using (line)),
kept as (select doc_id, count(*) n_lines, count(*) filter (gone) n_removed, string_agg(raw, chr(10) order by pos) filter (not gone) text from marked group by doc_id)
select d.doc_id, coalesce(n_lines, 0)::bigint n_lines, coalesce(n_removed, 0)::bigint n_removed,
  case when d.text is not null then length(coalesce(k.text, '')) end::bigint n_chars_kept,
  case when d.text is not null then sha256(coalesce(k.text, '')) end text_sha256
from documents d left join kept k using (doc_id)
"""
