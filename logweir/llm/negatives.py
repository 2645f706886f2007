"""Hard negatives by inner product, found by pruning on single coordinates.

Components become whole numbers, so scores are exact. Rows are dealt evenly into shards.
A task sorts its shard by length and cuts it into buckets of similar length; a bucket has
for each coordinate the sorted list of its values over the row's length. An anchor needs
rows of a score of at least its current bound. Over both lengths that is a least cosine t
for all rows of a bucket: beyond one the bucket is skipped, else a row whose angle to the
anchor is within arccos(t) differs by no more in its angle to any axis. So each focus
coordinate of the anchor, those with its largest values, allows an interval of values, a slice
of the sorted list. Only rows in the slices of all focus coordinates are scored. What has been
found raises the bound. The same search finds the positives (best rows of the anchor's label)
and the negatives (best rows of other labels within a band of scores for each positive).

Rows take no part if the label or the vector is null or a component is null or not finite. Rows
with the anchor's id count as the anchor's own. Rows without an id can be found, after
all others of the same score, and are no anchors. Repeated rows each count, and repeated anchor
rows are answered each. Shorter vectors are filled up with zeros. Components and scores
beyond the range of a long are set to its end. An empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from logweir.llm import vectors
from logweir.llm.neighbours import first_rows
from logweir.llm.store import written
from logweir.llm.vectors import ROW

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: Percent of the positive's score that a negative has at least and at most.
LOW, HIGH = 30, 90
#: A bucket ends where a row is shorter than this share of its longest, or at so many rows.
SHRINK, BUCKET = 0.9, 4096
#: Coordinates of an anchor whose sorted lists are intersected.
FOCUS = 3
#: Far above the rounding errors of an angle or a cosine.
SLACK = 1e-7
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Whole numbers below this are exact as doubles.
EXACT = 2**53


def exact(*tables: np.ndarray) -> list[np.ndarray]:
    """Tables of longs in the narrowest kind of number in which their inner products are exact."""
    most = max(int(np.abs(table.astype(np.float64)).max(initial=0)) + 1 for table in tables)
    most *= most * max(table.shape[1] for table in tables)
    kind = np.float64 if most < EXACT else np.int64 if most < MOST else object
    return [table.astype(kind) for table in tables]


def scores(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Inner products, all with all, within the range of a long."""
    found = some @ others.T
    return np.clip(found, LEAST, MOST).astype(np.int64) if found.dtype == object and found.size else found.astype(np.int64)


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1))


@dataclass
class Bucket:
    """Rows of similar length; ``values`` and ``places`` are the sorted list of each coordinate."""

    rows: np.ndarray
    longest: float
    values: np.ndarray
    places: np.ndarray

    def near(self, axis: int, low: float, high: float) -> np.ndarray:
        """Rows whose share of their length on an axis is within an interval."""
        start, end = np.searchsorted(self.values[axis], [low, high], side="left")
        return self.places[axis, start:end]


def buckets(rows: np.ndarray) -> list[Bucket]:
    rows, size = rows.astype(np.float64), lengths(rows)
    order, found, at = np.argsort(-size, kind="stable"), [], 0
    falling = -size[order]
    while at < len(order):
        end = int(np.searchsorted(falling, SHRINK * falling[at], side="right"))
        end = max(at + 1, min(end, at + BUCKET))
        mine = order[at:end]
        share = (rows[mine] / np.maximum(size[mine], 1e-300)[:, None]).T
        places = np.argsort(share, axis=1, kind="stable")
        found.append(Bucket(mine, float(size[order[at]]), np.take_along_axis(share, places, axis=1), places))
        at = end
    return found


@dataclass
class Wanted:
    """The best ``most`` rows of an anchor within each of its bands of scores."""

    low: list[int]
    high: list[int]
    most: int
    found: list[np.ndarray] = field(default_factory=list)
    rows: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.found = [np.zeros(0, np.int64) for _ in self.low]
        self.rows = [np.zeros(0, np.int64) for _ in self.low]

    def held(self, band: int) -> int:
        """Rows below this score are no use to the band."""
        return int(self.found[band][-1]) if len(self.found[band]) == self.most else self.low[band]

    def bound(self) -> int:
        """Rows below this score are no use to any band."""
        return min(map(self.held, range(len(self.low))), default=MOST)

    def add(self, score: np.ndarray, number: np.ndarray, rows: np.ndarray) -> None:
        """Take scored rows in; of equal scores the smaller number comes first."""
        for band, high in enumerate(self.high):
            inside = np.flatnonzero((score >= self.held(band)) & (score <= high))
            if len(inside):
                found = np.concatenate([self.found[band], score[inside]])
                known = np.concatenate([self.rows[band], rows[inside]])
                # Not the negative of a score, which the least long has not.
                best = np.lexsort((number[known], ~found))[: self.most]
                self.found[band], self.rows[band] = found[best], known[best]

    def raise_low(self, score: np.ndarray) -> None:
        """What other rows have reached: a band starts no lower than its last place among them."""
        for band, (low, high) in enumerate(zip(self.low, self.high)):
            inside = score[(score >= low) & (score <= high)]
            if len(inside) >= self.most:
                self.low[band] = int(np.partition(inside, len(inside) - self.most)[len(inside) - self.most])


def feasible(bucket: Bucket, anchor: np.ndarray, length: float, bound: int) -> np.ndarray | None:
    """Rows of a bucket that may reach the bound; None where no row can."""
    if bound <= 0 or not length or not bucket.longest:
        return bucket.rows if bound <= 0 else None
    least = bound / (length * bucket.longest)
    if least > 1 + SLACK:
        return None
    turn = np.arccos(min(1.0, least)) + SLACK
    if turn >= np.pi:
        return bucket.rows
    share = anchor.astype(np.float64) / length
    focus = np.argsort(-np.abs(share), kind="stable")[:FOCUS]
    met = np.zeros(len(bucket.rows), np.int8)
    for axis in focus:
        angle = np.arccos(np.clip(share[axis], -1, 1))
        low = np.cos(min(np.pi, angle + turn)) - SLACK
        high = np.cos(max(0.0, angle - turn)) + SLACK
        met[bucket.near(axis, low, high)] += 1
    return bucket.rows[met == len(focus)]


def longs(table: pa.Table, width: int) -> np.ndarray:
    """The vectors of whole numbers of a table, filled up with zeros."""
    found, at = np.zeros((table.num_rows, width), np.int64), 0
    for chunk in table["vector"].chunks:
        sizes = np.diff(np.asarray(chunk.offsets))
        part = found[at : at + len(sizes)]
        part[np.arange(width) < sizes[:, None]] = chunk.flatten().to_numpy(zero_copy_only=False)
        at += len(sizes)
    return found


def shard_search(sample: pa.Table, same_label: bool, most: int) -> vectors.Prepare:
    """What one task does: blocks of anchors with their bands against a shard."""

    def prepare(rows: pa.Table, width: int):
        given, known = longs(rows, width), longs(sample, width)
        shard, label, other = buckets(given), rows["label"].to_numpy(), sample["label"].to_numpy()
        (number, missing), known_id = vectors.ids(rows["vec_id"]), vectors.ids(sample["vec_id"])[0]

        def answer(anchors: pa.Table) -> pa.Table:
            asked, mine, first = exact(longs(anchors, width), given, known)
            own, wants = vectors.ids(anchors["vec_id"])[0], anchors["label"].to_numpy()
            bands, size, first = anchors["bands"].to_pylist(), lengths(asked.astype(np.float64)), scores(asked, first)
            who, band, score, place = [], [], [], []
            for k in range(len(asked)):
                wanted = Wanted([b["low"] for b in bands[k]], [b["high"] for b in bands[k]], most)
                wanted.raise_low(first[k][((other == wants[k]) == same_label) & (known_id != own[k])])
                for bucket in shard:
                    near = feasible(bucket, asked[k], size[k], wanted.bound())
                    if near is None:
                        # All further buckets are shorter.
                        break
                    near = near[((label[near] == wants[k]) == same_label) & (number[near] != own[k])]
                    if len(near):
                        wanted.add(scores(mine[near], asked[k][None, :])[:, 0], number, near)
                for b, rows_of in enumerate(wanted.rows):
                    who.append(np.full(len(rows_of), k))
                    band.append(np.full(len(rows_of), bands[k][b]["band"]))
                    score.append(wanted.found[b])
                    place.append(rows_of)
            join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
            who, place = join(who), join(place)
            return pa.table(
                {
                    ROW: anchors[ROW].to_numpy()[who],
                    "band": pa.array(join(band).astype(np.int32)),
                    "found_id": vectors.restored(number[place], missing[place]),
                    "score": pa.array(join(score)),
                }
            )

        return answer

    return prepare


def best(anchors: DataFrame, rows: DataFrame, sample: pa.Table, same_label: bool, most: int) -> DataFrame:
    """``_row, band, place, found_id, score``: the first ``most`` rows of each band of each anchor."""
    found = vectors.met(anchors, rows, shard_search(sample, same_label, most), f"{ROW} long, band int, found_id long, score long")
    order = Window.partitionBy(ROW, "band").orderBy(F.desc("score"), F.asc_nulls_last("found_id"))
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of the rows that ``anchors`` holds for.

    A negative has ``low`` to ``high`` percent of the score of the positive.
    """
    usable = rows.where(vectors.finite(F.col(vector)) & F.col(label).isNotNull())
    # Spark's floor of a double is a long and stays within its range.
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast(LongType()))
    asks = F.coalesce(anchors & F.col(vec_id).isNotNull(), F.lit(False))
    usable = usable.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), whole.alias("vector"), asks.alias("_asks")
    )
    placed = vectors.numbered(usable, "vectors")
    given, asking = placed.drop("_asks"), placed.where("_asks").drop("_asks")
    sample = vectors.sample(given)

    any_score = F.array(F.struct(F.lit(0).alias("band"), F.lit(int(LEAST)).alias("low"), F.lit(int(MOST)).alias("high")))
    mine = best(asking.withColumn("bands", any_score), given, sample, True, positives)
    mine = written(mine.select(ROW, F.col("place").alias("band"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # Whole scores: at least low percent rounded up, at most high percent rounded down; decimals don't overflow.
    percent = lambda share: F.col("positive_score").cast("decimal(19,0)") * share / 100
    band = F.struct("band", F.ceil(percent(low)).cast("long").alias("low"), F.floor(percent(high)).cast("long").alias("high"))
    bands = mine.groupBy(ROW).agg(F.filter(F.sort_array(F.collect_list(band)), lambda b: b["low"] <= b["high"]).alias("bands"))
    banded = written(asking.join(bands, ROW).where(F.size("bands") > 0), "anchors")
    hard = best(banded, given, sample, False, negatives)
    named = mine.join(asking.select(ROW, F.col("vec_id").alias("anchor_id")), ROW)
    return hard.join(named, [ROW, "band"]).select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def checking_sql(table: str) -> str:
    """:func:`hard_negatives` of given embeddings, as a comparison of each anchor with all rows."""
    return f"""WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS DOUBLE)) AS v,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM {table}
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
, scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS alike, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM usable a JOIN usable r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0)
, positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
QUALIFY rank <= {NEGATIVES}"""
