"""Removal of lines that spread over many sites.

A HyperLogLog sketch of the sites of every line is merged by aggregation. Estimates far from the
threshold decide; lines near it get an exact distinct count. Of a line that reaches the threshold
only the first occurrence in the corpus (smallest doc_id, then place) stays.

Lines are compared trimmed and in lower case, by 128 bits of hash. A null site counts as one
unnamed site; blank lines never count as boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import stored, whole_text

MIN_SITES = 8
#: log2 of the sketch's registers: a standard error of 1.6 per cent.
LOG_REGISTERS = 12
#: Estimates within this share of the threshold (one site at least) are counted exactly.
NEAR_SHARE = 0.1
#: Tables of at most so many lines of 50 bytes are broadcast.
BROADCAST_ROWS = 100_000

_KEY = ["k1", "k2"]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _text_id(text: Column) -> Column:
    return F.xxhash64(text)


def _line_table(docs: DataFrame, text: str, site: str) -> DataFrame:
    """doc_id, dh (hash of the text), place, site and key of every line; no key where it is blank."""
    whole = whole_text(text)
    rows = docs.select(
        "doc_id", _text_id(whole).alias("dh"),
        F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(_lines(whole)).alias("pos", "line"))
    line = F.lower(F.trim("line"))
    counts = F.trim("line") != ""
    return rows.select("doc_id", "dh", "pos", "site",
                       F.when(counts, F.xxhash64(line)).alias("k1"),
                       F.when(counts, F.xxhash64(F.lit("second"), line)).alias("k2"))


def boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Key and first occurrence of every line on ``min_sites`` sites or more."""
    near = max(1.0, NEAR_SHARE * min_sites)
    spread = stored(
        lines.where("k1 is not null").groupBy(*_KEY)
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites"),
             F.min(F.struct("doc_id", "pos")).alias("first"))
        .where(F.col("sites") >= min_sites - near), "spread")
    sure = spread.where(F.col("sites") > min_sites + near)
    close = spread.where(F.col("sites") <= min_sites + near)
    # one row per line and site before the join, so a frequent line is no hot key
    exact = (lines.where("k1 is not null").select(*_KEY, "site").distinct()
             .join(close.select(*_KEY), _KEY, "left_semi")
             .groupBy(*_KEY).agg(F.count(F.lit(1)).alias("exact")).where(F.col("exact") >= min_sites))
    return stored(sure.unionByName(close.join(exact.select(*_KEY), _KEY, "left_semi"))
                  .select(*_KEY, "first"), "boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, text: str = "text",
                site: str = "source") -> DataFrame:
    """``docs`` with boilerplate lines cut from the text, plus n_lines and n_removed.

    Null text counts as one empty line and becomes empty. Repeated rows count as one document and
    are all kept, as are rows without doc_id. An empty table gives an empty result. Columns of
    ``docs`` named n_lines or n_removed are replaced; all others stay.
    """
    lines = stored(_line_table(docs, text, site), "lines")
    spread = boilerplate(lines, min_sites)
    if spread.count() <= BROADCAST_ROWS:
        spread = F.broadcast(spread)
    found = lines.where("k1 is not null").join(spread, _KEY)
    extra = (found.where(~F.struct("doc_id", "pos").eqNullSafe(F.col("first")))
             .select("doc_id", "dh", "pos"))
    cut = extra.groupBy("doc_id", "dh").agg(F.sort_array(F.collect_set("pos")).alias("_cut"))
    cut = cut.select(F.col("doc_id").alias("_id"), F.col("dh").alias("_dh"), "_cut")
    whole = whole_text(text)
    joined = docs.drop("n_lines", "n_removed").join(
        cut, docs["doc_id"].eqNullSafe(F.col("_id")) & (_text_id(whole) == F.col("_dh")), "left")
    # one flag per line, so that the filter looks each line up by its place
    parts = _lines(whole)
    flags = F.when(F.col("_cut").isNotNull(), _flags(F.col("_cut"), F.size(parts)))
    kept = F.array_join(F.filter(parts, lambda _, i: ~F.get(F.col("_flags"), i)), "\n")
    return (joined.withColumn("_flags", flags)
            .withColumn("n_lines", F.size(parts))
            .withColumn("n_removed", F.coalesce(F.size("_cut"), F.lit(0)))
            .withColumn(text, F.when(F.col("_cut").isNull(), whole).otherwise(kept))
            .drop("_id", "_dh", "_cut", "_flags"))


def _flags(places: Column, n: Column) -> Column:
    """Array of ``n`` flags, true at the sorted ``places``: a run of false before each, and after the last."""
    last = F.size(places) - 1
    runs = F.transform(F.sequence(F.lit(0), last), lambda j: F.concat(
        F.array_repeat(F.lit(False), F.get(places, j) - F.when(j == 0, F.lit(0)).otherwise(F.get(places, j - 1) + 1)),
        F.array(F.lit(True))))
    return F.concat(F.flatten(runs), F.array_repeat(F.lit(False), n - 1 - F.get(places, last)))


def clean_lines(docs: DataFrame) -> DataFrame:
    """Pipeline form: the columns of ``docs``; documents of which nothing is left go."""
    out = dedup_lines(docs)
    gone = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return (out.where(~gone).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
            .select(*docs.columns))


def line_dedup_query(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_removed")


SQL = f"""
WITH lines AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (SELECT *, CASE WHEN trim(line) <> '' THEN lower(trim(line)) END AS k FROM lines),
spread AS (SELECT k FROM keyed WHERE k IS NOT NULL GROUP BY k HAVING count(DISTINCT site) >= {MIN_SITES}),
marked AS (
  SELECT doc_id, pos, line,
         k IN (SELECT k FROM spread) AND row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS cut
  FROM keyed)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(cut, false)), '') AS text,
       count(*)::INT AS n_lines, count(*) FILTER (WHERE cut)::INT AS n_removed
FROM marked GROUP BY doc_id
"""
