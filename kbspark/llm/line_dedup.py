"""Line dedup by distinct-site spread (DataFrame functions only).

A line's spread is the number of distinct sites whose documents hold it. HyperLogLog sketches
of the sites are built per line hash and merge by aggregation, so a line of any frequency costs
one small sketch per task. Lines whose estimate is clearly over the limit are boilerplate, those
clearly under it are not, and the band between gets exact distinct counts. Short lines recur by
chance, so they need `min_sites`; lines of `long_chars` or more do not, so `min_sites_long` is enough.
Of a boilerplate line the first occurrence (smallest document id, then position) stays; all others go.

Lines meet the list of boilerplate by broadcast where its counted size is small; beyond that by a
shuffle in which each boilerplate line is spread over SALTS keys, so a frequent line is not one task.

Defined results: a null text has no lines and stays null; a null site counts as the site ''; a
line is compared without blanks at its ends; lines under `min_chars` characters always stay;
repeated rows are alike, so all of them keep a line if one does; extra columns, of any names, are
carried along, but for own n_lines and n_removed, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import maybe_broadcast, row_key, stored

#: log2 of the sketches' registers; the relative standard error is 1.04 / sqrt(2**12) = 1.6 %.
LG_K = 12
#: Estimates within this share of the limit are counted exactly: over 15 standard errors.
BAND = 0.25
MIN_SITES, MIN_SITES_LONG, LONG_CHARS = 10, 4, 100
SALTS = 64


def _lines(docs: DataFrame, text: str, site: str, doc_id: str, min_chars: int = 4, min_sites: int = MIN_SITES, min_sites_long: int = MIN_SITES_LONG, long_chars: int = LONG_CHARS) -> DataFrame:
    """(k1, k2) of the row, id, site, position, the two hashes and the limit of every line long enough."""
    k1, k2 = row_key(doc_id, site, text)
    base = docs.select(
        k1.alias("k1"), k2.alias("k2"), F.col(doc_id).alias("doc"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"),
    )
    trimmed = base.withColumn("line", F.trim("line")).where(F.char_length("line") >= min_chars)
    return trimmed.select(
        "k1", "k2", "doc", "site", "pos", F.xxhash64(F.lit(1), "line").alias("h1"), F.xxhash64(F.lit(2), "line").alias("h2"),
        F.when(F.char_length("line") >= long_chars, min_sites_long).otherwise(min_sites).alias("limit"),
    )


def line_spread(lines: DataFrame) -> DataFrame:
    """Per line hash: estimated number of sites, the limit and the first occurrence."""
    return lines.groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"), F.first("limit").alias("limit"), F.min(F.struct("doc", "pos")).alias("first"),
    )


def at_lines(lines: DataFrame, listed: DataFrame, limit_bytes: int = 64 << 20) -> DataFrame:
    """The lines that are in a stored list (h1, h2, ...), with its columns."""
    n = listed.count()
    if n * 48 <= limit_bytes:
        return lines.join(maybe_broadcast(listed, n, 48, limit_bytes), ["h1", "h2"])
    spread = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("k1", "pos"), F.lit(SALTS)).cast("int")).join(spread, ["h1", "h2", "salt"]).drop("salt")


def boilerplate_lines(lines: DataFrame, band: float = BAND, limit_bytes: int = 64 << 20) -> DataFrame:
    """(h1, h2, first) of the lines in at least as many distinct sites as their limit."""
    spread = stored(line_spread(lines).where(F.col("sites") >= F.col("limit") * (1 - band)), "spread")
    sure = F.col("sites") > F.col("limit") * (1 + band)
    near = spread.where(~sure)
    exact = (
        at_lines(lines.drop("limit"), near.select("h1", "h2", "limit"), limit_bytes)
        .select("h1", "h2", "limit", "site").distinct()
        .groupBy("h1", "h2", "limit").count().where(F.col("count") >= F.col("limit"))
    )
    return stored(spread.where(sure).unionByName(near.join(exact.select("h1", "h2"), ["h1", "h2"], "left_semi")).select("h1", "h2", "first"), "boilerplate")


def dedup_lines(
    docs: DataFrame, text: str = "text", site: str = "source", doc_id: str = "doc_id", min_sites: int = MIN_SITES, min_chars: int = 4,
    min_sites_long: int | None = None, long_chars: int = LONG_CHARS, limit_bytes: int = 64 << 20,
) -> DataFrame:
    """`docs` with boilerplate lines cut from the text, plus n_lines and n_removed; min_sites_long: MIN_SITES_LONG, or min_sites if that is less."""
    lines = _lines(docs, text, site, doc_id, min_chars, min_sites, min(MIN_SITES_LONG, min_sites) if min_sites_long is None else min_sites_long, long_chars)
    goes = at_lines(lines.drop("limit"), boilerplate_lines(lines, limit_bytes=limit_bytes), limit_bytes).where(~F.struct("doc", "pos").eqNullSafe(F.col("first")))
    gone = goes.groupBy("k1", "k2").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    k1, k2 = row_key(doc_id, site, text)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.split(F.col(text), "\n", -1).alias("parts"), k1.alias("k1"), k2.alias("k2"))
    marked = own.join(gone, ["k1", "k2"], "left")
    # the runs of lines between those that go
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat("gone", F.array(F.size("parts")))
    kept = F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice("parts", a + 1, b - a))), "\n")
    return marked.select(
        *[F.when(F.col("gone").isNull(), F.col(f"row.`{c}`")).otherwise(kept).alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")],
        F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


#: DuckDB SQL of dedup_lines with its defaults over documents; `removed` texts may be all gone (text '').
SQL = """
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(range(len(parts))) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM {documents})
), b AS (
  SELECT trim(line) AS line, min(struct_pack(d := doc_id, p := pos)) AS first
  FROM l WHERE length(trim(line)) >= 4 GROUP BY 1 HAVING count(DISTINCT site) >= CASE WHEN length(trim(line)) >= 100 THEN 4 ELSE 10 END
), f AS (
  SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AND struct_pack(d := doc_id, p := pos) <> b.first AS goes
  FROM l LEFT JOIN b ON trim(l.line) = b.line
), t AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '') AS text,
    count(*) AS n_lines, count(*) FILTER (goes) AS n_removed
  FROM f GROUP BY doc_id
)
"""
