"""Document fingerprints that tell versions apart: invertible Bloom lookup sketches, in DataFrame operations only.

A text is the set of its paragraphs' digests: its lines, long ones cut every ``PIECE``
characters at the end of a word. A sketch has three rows of cells; a digest is added to one
cell of each row, which keeps a count, the exclusive-or of digests and that of their
checks. Sketches of two versions are subtracted cell by cell, what is in both cancels out.
Peeling then takes digests from cells that hold one alone, out of their other cells too,
until nothing is left: the digests in which the versions differ. Where something is
left, the pair is tried again with larger sketches, twice as large each time.

The fingerprint of a text is its smallest sketch. Pairs whose smallest sketches cancel out
do not differ; for the others the first size follows from the sizes of the sets. Likeness is the share of common digests
among all; two empty texts are alike.

Nulls: a null text is empty, a null id comes last. Rows that repeat an id, or a
whole row, are documents of their own and follow each other. A single document is its own
next one. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from math import ceil
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.store import RANK, new_folder, ranked, written

PIECE = 96
ROWS = 3
#: Cells a row of the smallest sketch.
SMALLEST = 4
#: Cells a row, at first, for each digest of the largest version.
ROOM = 2
#: Passes over the rows of cells until a pair counts as failed.
CYCLES = 2
CHECK = 99
#: Documents in a bucket of the digest table, about.
BUCKET_ROWS = 2_000
EDITED, NEXT = 0, 1
#: A cell's number holds its pair, row and slot.
ROW_BITS, PAIR_BITS = 40, 44


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    pieces = F.regexp_extract_all(text, F.lit(rf"[^\n]{{{PIECE}}}\S*|[^\n]+"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(pieces, lambda piece: F.when(F.trim(piece) != "", F.xxhash64(F.trim(piece)))), lambda x: x.isNotNull()))


def slot(digest: Column, attempt: int, row: int, width: Column) -> Column:
    """Cell of a digest in one row of a sketch."""
    return F.pmod(F.xxhash64(digest, F.lit(attempt * ROWS + row)), width).cast("int")


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(CHECK))


def fingerprint(keys: str) -> Column:
    """The smallest sketch as text: of each cell the count, the digests and the checks, in hexadecimal."""
    def cell(row: int, place: int) -> Column:
        inside = F.filter(keys, lambda x: slot(x, 0, row, F.lit(SMALLEST)) == place)
        return F.aggregate(
            inside, F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c")),
            lambda got, x: F.struct((got["n"] + 1).alias("n"), got["x"].bitwiseXOR(x).alias("x"), got["c"].bitwiseXOR(check(x)).alias("c")),
            lambda got: F.concat(F.hex(got["n"]), F.lit("-"), F.hex(got["x"]), F.lit("-"), F.hex(got["c"])),
        )

    return F.lower(F.concat_ws(".", *[cell(row, place) for row in range(ROWS) for place in range(SMALLEST)]))


def versions(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Each document with its edited text and the digests of its three versions.

    Texts are shuffled once, by a hash of the whole row; of the next document only the
    third that is taken over and the digests travel to its predecessor.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    base = base.withColumn("_row", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")).withColumn("n_chars", F.length("text").cast("long"))
    order = ranked(base.select("doc_id", "_row", "n_chars"), [F.col("doc_id").desc_nulls_last(), F.col("_row").asc()])
    order = written(order.select("_row", "n_chars", RANK), "order")
    total = order.count()
    before = order.select(F.pmod(F.col(RANK), F.lit(max(total, 1))).alias("_at"), F.col("_row").alias("_prior_row"), F.col(RANK).alias("_prior"), F.col("n_chars").alias("_prior_chars"))
    places = order.join(before, F.pmod(F.col(RANK) - 1, F.lit(max(total, 1))) == F.col("_at"))
    # Rows that are equal throughout share their places, one each.
    places = places.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(RANK, "_prior", "_prior_row", "_prior_chars"))).alias("_places"))

    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / BUCKET_ROWS), 1)
    spread = base.repartition(parts, "_row")
    numbered = spread.withColumn("_copy", F.row_number().over(Window.partitionBy("_row").orderBy("_row")))
    placed = numbered.join(places, "_row").withColumn("_place", F.element_at("_places", F.col("_copy"))).drop("_places", "_copy")
    taken = F.floor(F.col("_place._prior_chars") / 3).cast("int")
    following = placed.select(
        F.col("_place._prior_row").alias("_for_row"), F.col("_place._prior").alias("_for"),
        F.substring("text", F.lit(1), taken).alias("_start"), digests(F.col("text")).alias("next"),
        # Both sides need all columns of the texts, so Spark shuffles them once for both.
        F.col("doc_id").alias("next_id"), F.col("n_chars").alias("next_chars"),
    ).repartition(parts, "_for_row")
    # Only the row's hash is a join key, as the texts are dealt by it; equal rows are few and told apart after.
    joined = placed.join(following, (F.col("_row") == F.col("_for_row")) & (F.col(f"_place.{RANK}") - F.col("_for") == 0))
    left = F.col("n_chars") - F.floor(F.col("n_chars") / 3)
    edited = F.concat(F.substring("text", F.lit(1), left.cast("int")), "_start")
    return joined.select(
        "_row", F.col(f"_place.{RANK}").alias("_number"), "doc_id", "n_chars", "next_id", "next_chars", edited.alias("edited_text"),
        digests(F.col("text")).alias("own"), "next",
    ).withColumn("edited", digests(F.col("edited_text")))


def sketches(rows: DataFrame, attempt: int) -> DataFrame:
    """Subtracted sketches of the pairs of ``rows`` (``_row, _number, _tries`` and the digest arrays): the cells that are not empty.

    Each version is added to cells once; its share in either pair is a sign.
    """
    def version(keys: str, edited: int, following: int) -> Column:
        return F.transform(keys, lambda x: F.struct(F.lit(edited).alias("e"), F.lit(following).alias("f"), x.alias("x")))

    entries = F.concat(version("own", 1, 1), version("edited", -1, 0), version("next", 0, -1))
    largest = F.greatest(F.size("own"), F.size("edited"), F.size("next"))
    width = (largest * ROOM + 2 * SMALLEST) * F.lit(1 << attempt)
    rows = rows.select("_row", "_number", width.cast("int").alias("width"), "_tries", F.explode_outer(entries).alias("v")).where("v is not null")
    rows = rows.select("_row", "_number", "width", "_tries", "v.e", "v.f", "v.x", check(F.col("v.x")).alias("c"))
    places = F.array(*[place(row, slot(F.col("x"), attempt, row, F.col("width"))) for row in range(ROWS)])
    cells = rows.select("*", F.explode_outer(places).alias("cell"))
    none = F.lit(0).cast("long")
    sums = []
    for pair, sign in ((EDITED, "e"), (NEXT, "f")):
        own = F.col(sign) != 0
        sums += [F.sum(sign).cast("int").alias(f"n{pair}"), F.bit_xor(F.when(own, F.col("x")).otherwise(none)).alias(f"x{pair}"), F.bit_xor(F.when(own, F.col("c")).otherwise(none)).alias(f"c{pair}")]
    added = cells.groupBy("_row", "_number", "width", "_tries", "cell").agg(*sums)
    pairs = F.array(*[F.struct(F.lit(pair).alias("pair"), F.col(f"n{pair}").alias("n"), F.col(f"x{pair}").alias("x"), F.col(f"c{pair}").alias("c")) for pair in (EDITED, NEXT)])
    opened = added.select("_row", "_number", "width", "_tries", "cell", F.explode_outer(pairs).alias("p"))
    opened = opened.where("(p.n <> 0 or p.x <> 0 or p.c <> 0) and (_tries = 2 or _tries = p.pair)")
    numbered = F.col("cell") + F.shiftleft(F.col("p.pair").cast("long"), PAIR_BITS)
    return opened.select("_row", "_number", "width", numbered.alias("cell"), F.lit(None).cast("long").alias("found"), "p.n", "p.x", "p.c")


def place(row: int, slot_of: Column) -> Column:
    return slot_of.cast("long") + F.lit(row << ROW_BITS)


def peeled(cells: DataFrame, attempt: int, cycles: int = CYCLES) -> DataFrame:
    """Cells after peeling: what is left, and rows with ``found``, the recovered digests (``n`` is their side).

    A step peels one row of cells; a digest stands in one cell of it only, so none is
    taken out twice. All rows of a document stay in its partition.
    """
    columns = ["cell", "found", "n", "x", "c"]
    part = lambda *values: F.struct(*[value.alias(name) for name, value in zip(columns, values)])
    none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
    pair = F.shiftright("cell", PAIR_BITS)
    base = F.shiftleft(pair, PAIR_BITS)
    for step in range(cycles * ROWS):
        row = step % ROWS
        alone = F.col("found").isNull() & (F.abs("n") == 1) & (F.col("cell") - base == place(row, slot(F.col("x"), attempt, row, F.col("width"))))
        pure = alone & (F.col("c") == check(F.col("x")))
        # A recovered digest is a row of its own, beyond all cells.
        out = [part(base + F.lit(ROWS << ROW_BITS), F.col("x"), F.col("n"), zero, zero)]
        for other in range(ROWS):
            if other != row:
                out.append(part(base + place(other, slot(F.col("x"), attempt, other, F.col("width"))), none, -F.col("n"), F.col("x"), F.col("c")))
        same = part(*[F.col(name) for name in columns])
        moved = cells.select("_row", "_number", "width", F.explode_outer(F.when(pure, F.array(*out)).otherwise(F.array(same))).alias("e"))
        moved = moved.select("_row", "_number", "width", *[F.col(f"e.{name}").alias(name) for name in columns])
        cells = moved.groupBy("_row", "_number", "width", "cell", "found").agg(
            F.sum("n").cast("int").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("c").alias("c")
        ).where("n <> 0 or x <> 0 or c <> 0")
    return cells.withColumn("pair", pair.cast("int"))


def differences(rows: DataFrame, attempt: int, with_digests: bool = False) -> DataFrame:
    """``_row, _number, pair, failed, differing`` of pairs that differ at all (and the digests on either side)."""
    done = peeled(sketches(rows, attempt), attempt)
    sides = [F.collect_list(F.when(F.col("n") == sign, F.col("found"))).alias(name) for name, sign in (("gone", 1), ("new", -1))]
    return done.groupBy("_row", "_number", "pair").agg(
        (F.count("*") > F.count("found")).alias("failed"), F.count("found").alias("differing"), *(sides if with_digests else [])
    )


def compared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with their fingerprints, and of each pair of versions that differ the number of differing digests."""
    spark = docs.sparkSession
    rows = versions(docs, doc_id, text)
    rows = rows.withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")
    for keys, name in (("own", "fingerprint"), ("edited", "edited_fingerprint"), ("next", "next_fingerprint")):
        rows = rows.withColumn(name, fingerprint(keys))
    # Bucketed by row, so that attempts find the digests of a document in one partition without a shuffle.
    name = f"versions_{uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(docs.count() / BUCKET_ROWS), 1)
    # Spark bounds the number of buckets; beyond that a bucket holds more documents.
    buckets = min(buckets, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    rows.write.option("compression", "zstd").option("path", new_folder(spark, "versions")).bucketBy(buckets, "_row").saveAsTable(name)
    stored = spark.table(name)

    # Versions with the same smallest sketch cancel out at once; 2 stands for both pairs.
    arrays = stored.select("_row", "_number", "own", "edited", "next", "fingerprint", "edited_fingerprint", "next_fingerprint")
    differ = [F.col("fingerprint") != F.col(other) for other in ("edited_fingerprint", "next_fingerprint")]
    tries = F.when(differ[0] & differ[1], 2).when(differ[0], EDITED).when(differ[1], NEXT)
    arrays = arrays.withColumn("_tries", tries).drop("fingerprint", "edited_fingerprint", "next_fingerprint")
    open_pairs = arrays.where("_tries is not null")
    arrays = arrays.drop("_tries")
    attempt, results = 0, None
    while True:
        found = written(differences(open_pairs, attempt, with_digests), "differences")
        good = found.where("not failed").drop("failed")
        results = good if results is None else results.unionByName(good)
        failed = found.where("failed")
        if not failed.take(1):
            return stored, results
        tries = failed.groupBy("_row", "_number").agg(F.when(F.count("*") == 2, 2).otherwise(F.max("pair")).alias("_tries"))
        open_pairs = arrays.join(tries, ["_row", "_number"])
        attempt += 1


def version_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, and the likeness to the edited and to the next text."""
    stored, results = compared(docs, doc_id, text)
    differing = results.groupBy("_row", "_number").agg(
        *[F.max(F.when(F.col("pair") == pair, F.col("differing"))).alias(f"d{pair}") for pair in (EDITED, NEXT)]
    )
    joined = stored.join(differing, ["_row", "_number"], "left")

    def likeness(other: str, pair: int) -> Column:
        both, apart = F.size("own") + F.size(other), F.coalesce(F.col(f"d{pair}"), F.lit(0))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - apart) / (both + apart)).cast("double")

    return joined.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("edited", EDITED).alias("near_edited"), likeness("next", NEXT).alias("near_next"),
    )
