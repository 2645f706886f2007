"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected ``target / source size`` times. The expected
copies are prefix-summed within the source, one random offset is added, and a document
is taken once per integer that its interval crosses. Documents stand in order of size,
so what a source gives differs from its target by about one document.

Nulls: a null text has size 0, a null source is a source of its own and comes last, a
null ``doc_id`` is a value like any other. A source of size 0 has target 0 and gives
nothing. Repeated rows are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.store import RANK, ranked, written

WEIGHTS = (3, 1, 2)
SEED = 20
#: Groups that a size class of one source is split into, by a hash of the document.
SALTS = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], percent: int, cap: int) -> DataFrame:
    """Targets of sources (``_source``, ``source_size``): shares by weight, stopped at ``cap`` times the size.

    One row per source; each round stops the sources that are above and shares the rest
    among the others. Only four sums leave the cluster, whatever the number of sources.
    """
    table = ranked(sizes, [F.col("_source").asc_nulls_last()])
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col(RANK) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = written(table.withColumn("_weight", cycle.cast("long")).drop(RANK), "sources")

    limit = F.col("source_size") * cap
    total = table.agg(F.sum("source_size")).first()[0] or 0
    stopped, rest, open_weight = F.lit(False), percent * total, None
    while True:
        # rest is in hundredths of a word, so it stays an integer.
        sums = table.where(~stopped).agg(F.sum("_weight")).first()[0] or 0
        kept = table.where(stopped).agg(F.sum(limit)).first()[0] or 0
        rest, grown = percent * total - 100 * kept, open_weight != sums
        open_weight = sums
        if not grown or not sums:
            break
        wide = lambda column: column.cast("decimal(38,0)")
        above = wide(F.col("_weight")) * F.lit(rest).cast("decimal(19,0)") > wide(limit).cast("decimal(19,0)") * F.lit(100 * sums).cast("decimal(19,0)")
        stopped = stopped | above
    share = (F.col("_weight") * F.lit(rest)).cast("double") / F.lit(float(100 * (open_weight or 1)))
    return table.select("_source", "source_size", F.when(stopped, limit.cast("double")).otherwise(share).alias("target"))


def size_class(size: str) -> Column:
    """Size class as text: number of binary digits, then the first four of them."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(F.rpad(digits, 4, "0"), 1, 4))


def digest(*parts: Column) -> Column:
    """32 bits of a hash as a long; null counts as empty."""
    text = F.concat(*[F.coalesce(part.cast("string"), F.lit("")) for part in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    percent: int = 150,
    cap: int = 2,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    The place of a document in its source is a row number inside its (source, size
    class, salt) group plus the rows of the groups before, so a hot source is never
    one task; only counts of groups, at most a few thousand, meet per source.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("_source"), word_count(text).alias("size"))
    rows = written(
        rows.withColumn("_class", size_class("size")).withColumn("_salt", F.pmod(digest(F.col("doc_id")), F.lit(SALTS))), "sizes"
    )
    targets = source_targets(rows.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, percent, cap)

    group = ["_source", "_class", "_salt"]
    before = F.sum("_n").over(Window.partitionBy("_source").orderBy("_class", "_salt").rowsBetween(Window.unboundedPreceding, -1))
    groups = rows.groupBy(*group).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    groups = groups.join(targets.withColumnRenamed("_source", "_own"), F.col("_source").eqNullSafe(F.col("_own"))).drop("_own", "_n")
    groups = groups.select(*[F.col(name).alias(f"{name}_of") for name in group], "_before", "source_size", "target")

    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*group).orderBy("size", "doc_id")))
    same = [F.col(name).eqNullSafe(F.col(f"{name}_of")) if name == "_source" else F.col(name) == F.col(f"{name}_of") for name in group]
    joined = placed.join(groups, same[0] & same[1] & same[2])

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = digest(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit("n"))) / F.lit(4294967296.0)
    place = F.col("_place") + F.col("_before")
    crossed = (F.floor(place * rate + offset) - F.floor((place - 1) * rate + offset)).cast("long")
    return joined.withColumn("copies", crossed).select(
        "doc_id", F.col("_source").alias("source"), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def emitted(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The mix itself: every row of ``docs`` (of unique ids) once per copy, with its columns as they are."""
    taken = mixed.where("copies > 0").select(F.col("doc_id").alias("_taken_id"), F.sequence(F.lit(1), F.col("copies")).alias("_copies"))
    joined = docs.join(taken, docs[doc_id].eqNullSafe(taken["_taken_id"]))
    return joined.select(*[docs[name] for name in docs.columns], F.explode("_copies").alias("_copy")).drop("_copy")


def checking_sql(table: str, weights: Sequence[int] = WEIGHTS, percent: int = 150, cap: int = 2, seed: int = SEED) -> str:
    """The same rows in DuckDB SQL; the stopped sources are a prefix in order of limit per weight."""
    cycle = "[" + ", ".join(map(str, weights)) + "]"
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM {table})
, per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)
, weighted AS (SELECT *, CAST({cycle}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}] AS HUGEINT) AS w,
    {cap} * CAST(source_size AS HUGEINT) AS lim, sum(source_size) OVER () AS total FROM per_source)
, summed AS (SELECT *, sum(w) OVER () AS all_w,
    coalesce(sum(w) OVER before, 0) AS w_before, coalesce(sum(lim) OVER before, 0) AS lim_before
  FROM weighted WINDOW before AS (ORDER BY CAST(lim AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, judged AS (SELECT *, w * ({percent} * total - 100 * lim_before) > lim * 100 * (all_w - w_before) AS stopped FROM summed)
, rests AS (SELECT CAST({percent} * coalesce(max(total), 0) - 100 * coalesce(sum(lim) FILTER (WHERE stopped), 0) AS HUGEINT) AS rest,
    CAST(100 * coalesce(sum(w) FILTER (WHERE NOT stopped), 1) AS DOUBLE) AS open_w FROM judged)
, targets AS (SELECT source, source_size,
    CASE WHEN stopped THEN CAST(lim AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / open_w END AS target FROM judged, rests)
, placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY
    lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(rpad(bin(size), 4, '0'), 1, 4),
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) % {SALTS}, size, doc_id NULLS FIRST) AS place FROM sized)
, rated AS (SELECT p.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST('0x' || substr(md5('{seed}:' || coalesce('s' || p.source, 'n')), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS off
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
, crossed AS (SELECT *, CAST(floor(place * rate + off) - floor((place - 1) * rate + off) AS BIGINT) AS copies FROM rated)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM crossed"""
