"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text keeps the least hash of every ``SPAN`` consecutive grams of ``GRAM`` words. Texts
that share ``WINDOW`` words or more share one of those fingerprints, for
``GRAM + SPAN - 1 = WINDOW``, so the join of the fingerprints misses no shared window. Hits
are then extended: the windows around a hit are compared word by word. Items of fewer
words are one window each and are looked up by the hash of that many words.

Nulls: a null text has no words; null ids are values like any other and a null item id
is not listed. Documents that are repeated, or that share an id, are judged row by row. An item
without words has no window. Either table may be empty. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.store import written

WINDOW = 13
GRAM = 6
SPAN = WINDOW - GRAM + 1
#: A document is contaminated if so many of its words in a hundred are hit.
SHARE = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words before A-Z is lower-cased: runs of ASCII letters, digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _from(values: Column, start: int) -> Column:
    """The array from the 1-based place on."""
    return F.slice(values, start, F.greatest(F.size(values) - (start - 1), F.lit(0)))


def _paired(df: DataFrame, name: str, left: str, right: str, shift: int, how) -> DataFrame:
    """Column ``name``: each element of ``left`` joined with the one of ``right`` that is ``shift`` further."""
    later = _from(F.col(right), shift + 1)
    size = F.least(F.size(left), F.size(later))
    return df.withColumn(name, F.zip_with(F.slice(left, 1, size), F.slice(later, 1, size), how))


def hashed_words(df: DataFrame, text: str) -> DataFrame:
    """``_h``: a hash of each word that does not tell the cases apart."""
    return df.withColumn("_h", F.transform(words(F.col(text)), lambda word: F.xxhash64(F.lower(word))))


def grams(df: DataFrame) -> DataFrame:
    """``_gram``: a hash of the ``GRAM`` words from each word on, doubled up from pairs."""
    both = lambda a, b: F.xxhash64(a, b)
    df = _paired(df, "_two", "_h", "_h", 1, both)
    df = _paired(df, "_four", "_two", "_two", 2, both)
    return _paired(df, "_gram", "_four", "_two", 4, both).drop("_two", "_four")


def winnowed(df: DataFrame) -> DataFrame:
    """``_fps``: the distinct least grams of all spans."""
    for name, left, shift in (("_m2", "_gram", 1), ("_m4", "_m2", 2), ("_m8", "_m4", 4)):
        df = _paired(df, name, left, left, shift, lambda a, b: F.least(a, b))
    return df.withColumn("_fps", F.array_distinct("_m8")).drop("_m2", "_m4", "_m8")


def short_grams(length: int) -> Column:
    """Hashes of the ``length`` words from each word on."""
    starts = F.sequence(F.lit(1), F.size("_h") - (length - 1))
    found = F.transform(starts, lambda at: F.xxhash64(F.slice("_h", at, length)))
    return F.when(F.size("_h") >= length, found).otherwise(F.array().cast("array<bigint>"))


# Where arrays are exploded below, the outer form keeps Spark from pushing a filter on the
# array's size, and with it a copy of all its expressions, down to the scan.


def _marks(df: DataFrame, lengths: list[int]) -> Column:
    """All fingerprints of a row as ``(length, fp)``."""
    marks = [F.transform("_fps", lambda fp: F.struct(F.lit(WINDOW).alias("length"), fp.alias("fp")))]
    def short(length: int) -> Column:
        return F.transform(F.array_distinct(short_grams(length)), lambda fp: F.struct(F.lit(length).alias("length"), fp.alias("fp")))

    return F.concat(*marks, *[short(length) for length in lengths])


def item_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """``item_id, length, words``: the windows of every item."""
    lowered = F.translate(F.col(text), UPPER, LOWER)
    rows = items.select(F.col(item_id).cast("string").alias("item_id"), words(lowered).alias("w")).where(F.size("w") > 0)
    length = F.least(F.size("w"), F.lit(WINDOW))
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - length + 1))
    return rows.select("item_id", "w", length.alias("length"), starts.alias("at")).select("item_id", "length", F.slice("w", F.col("at"), F.col("length")).alias("words"))


def contamination(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items (ids), contaminated."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_key"))
    key = ["doc_id", "_key"]
    opened = written(item_windows(items, item_id, item_text), "windows")
    # At most twelve numbers: the lengths of items that are shorter than a window.
    lengths = sorted(row["length"] for row in opened.where(F.col("length") < WINDOW).select("length").distinct().collect())

    tests = winnowed(grams(hashed_words(items.select(F.col(item_text).alias("text")), "text")))
    short = opened.where(F.col("length") < WINDOW).select("length", F.xxhash64(F.transform("words", lambda word: F.xxhash64(F.lower(word)))).alias("fp"))
    tests = tests.select(F.explode_outer("_fps").alias("fp")).select(F.lit(WINDOW).alias("length"), "fp").unionByName(short)
    tests = written(tests.distinct(), "test-fingerprints")

    # Fingerprints of the documents, joined with those of the items: few documents are left.
    prints = winnowed(grams(hashed_words(base, "text")))
    prints = prints.select(*key, F.explode_outer(_marks(prints, lengths)).alias("mark")).select(*key, "mark.length", "mark.fp")
    hits = prints.join(tests, ["length", "fp"], "left_semi")
    found = hits.groupBy(*key).agg(F.collect_set(F.struct("length", "fp")).alias("_hits"))
    found = written(found.withColumnsRenamed({"doc_id": "_id", "_key": "_of"}), "hits")

    # Hits are extended: windows that hold a fingerprint that was hit, word by word.
    rows = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["_key"] == found["_of"])).drop("_id", "_of")
    rows = grams(hashed_words(rows, "text")).withColumn("_words", words(F.translate("text", UPPER, LOWER))).drop("text")
    of = lambda length: F.transform(F.filter("_hits", lambda hit: hit["length"] == length), lambda hit: hit["fp"])
    rows = rows.withColumn("_long", of(WINDOW))
    for length in lengths:
        rows = rows.withColumn(f"_short{length}", of(length)).withColumn(f"_grams{length}", short_grams(length))
    rows = rows.withColumn("_size", F.size("_words"))

    def places(grams_of: str, hits_of: str) -> Column:
        marked = F.transform(grams_of, lambda fp, at: F.when(F.array_contains(hits_of, fp), at + 1))
        return F.filter(marked, lambda at: at.isNotNull())

    last = F.col("_size") - (WINDOW - 1)
    around = F.transform(places("_gram", "_long"), lambda at: F.when(last >= 1, F.sequence(F.greatest(F.least(at, last) - (SPAN - 1), F.lit(1)), F.least(at, last))))
    starts = F.filter(F.array_distinct(F.flatten(F.filter(around, lambda x: x.isNotNull()))), lambda at: at.isNotNull())
    tries = [F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(WINDOW).alias("length")))]

    def short_tries(length: int) -> Column:
        return F.transform(places(f"_grams{length}", f"_short{length}"), lambda at: F.struct(at.alias("at"), F.lit(length).alias("length")))

    tries += [short_tries(length) for length in lengths]
    rows = rows.select(*key, "_words", F.explode_outer(F.concat(*tries)).alias("_try"))
    rows = rows.select(*key, F.col("_try.at").alias("at"), F.col("_try.length").alias("length"), F.slice("_words", F.col("_try.at"), F.col("_try.length")).alias("words"))

    known = opened.select("words").distinct()
    matched = written(rows.join(known, "words", "left_semi"), "matches")
    spans = matched.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", (F.col("at") + F.col("length")).alias("end")))).alias("spans"))
    zero = F.struct(F.lit(1).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        "spans",
        zero,
        lambda got, span: F.struct(
            F.greatest(got["end"], span["end"]).alias("end"),
            (got["n"] + F.greatest(span["end"] - F.greatest(got["end"], span["at"]), F.lit(0))).alias("n"),
        ),
        lambda got: got["n"],
    )
    listed = matched.select(*key, "words").distinct().join(opened.select("item_id", "words"), "words").where("item_id is not null")
    listed = listed.groupBy(*key).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    judged = spans.select(*key, covered.alias("n_hit")).withColumnsRenamed({"doc_id": "_id", "_key": "_of"})
    listed = listed.withColumnsRenamed({"doc_id": "_id2", "_key": "_of2"})
    judged = judged.join(listed, judged["_id"].eqNullSafe(listed["_id2"]) & (judged["_of"] == listed["_of2"]), "left").drop("_id2", "_of2")

    counted = base.select(*key, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    result = counted.join(judged, counted["doc_id"].eqNullSafe(judged["_id"]) & (counted["_key"] == judged["_of"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return result.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"),
        ((n_hit > 0) & (100 * n_hit >= SHARE * F.col("n_words"))).alias("contaminated"),
    )


def digest(judged: DataFrame) -> DataFrame:
    """The judged documents with the item ids as one digest."""
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def checking_sql(table: str, items: str = "benchmark") -> str:
    """The digest in DuckDB SQL: every window of every document against every window of every item."""
    split = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    leads = ", ".join(f"lead(word, {n}) OVER o" for n in range(1, WINDOW))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {split('text')} AS w FROM {table})
, i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {split('text')} AS w FROM {items})
, il AS (SELECT *, least(len(w), {WINDOW}) AS l FROM i WHERE len(w) > 0)
, ia AS (SELECT *, unnest(range(1, len(w) - l + 2)) AS s FROM il)
, iw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS win FROM ia)
, ls AS (SELECT DISTINCT l FROM iw)
, dp AS (SELECT k, CAST(len(w) AS BIGINT) AS n, generate_subscripts(w, 1) AS s, unnest(w) AS word FROM d)
, da AS (SELECT k, n, s, [word, {leads}] AS ws FROM dp WINDOW o AS (PARTITION BY k ORDER BY s))
, dw AS (SELECT k, s, l, array_to_string(ws[1:l], ' ') AS win FROM da, ls WHERE s + l - 1 <= n)
, m AS (SELECT dw.* FROM dw WHERE (l, win) IN (SELECT l, win FROM iw))
, p AS (SELECT DISTINCT k, unnest(range(s, s + l)) AS pos FROM m)
, hit AS (SELECT k, CAST(count(*) AS BIGINT) AS n_hit FROM p GROUP BY k)
, its AS (SELECT k, list_sort(list(DISTINCT item_id)) AS ids FROM m JOIN iw USING (l, win) WHERE item_id IS NOT NULL GROUP BY k)
, judged AS (SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(ids, []) AS ids
  FROM d LEFT JOIN hit USING (k) LEFT JOIN its USING (k))
SELECT doc_id, n_words, n_hit, CAST(len(ids) AS BIGINT) AS n_items, sha256(array_to_string(ids, ',')) AS items_sha256,
  n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM judged"""
