"""Nearest neighbours by cosine with a vantage-point tree in each shard.

Rows are dealt evenly into shards. A task makes the tree of its shard over unit vectors,
where the straight distance is a metric that falls as the cosine grows: a node has a
vantage point, and its two halves are the nearer and the farther rows with the range of
their distances from it. By the triangle inequality no row of a half is nearer to a query
than the query's distance from that range. A half is left out if that bound exceeds the
distance of the k-th row found so far, divided by ``factor``: one is exact search, larger
factors look at fewer rows. Queries go down the tree in blocks. What the shards find is
merged, and the score is computed from the original vectors.

Vectors that are null, zero, or have null or non-finite components take no part. Rows with
the query's id count as the query's own. Equal vectors of a shard are one entry with its
smallest ids, as many as an answer can need, so copies cost nothing more and none is
lost. Rows without an id can be found, after all others of the same score, and don't ask.
Repeated query rows are answered each. Shorter vectors are filled up with zeros. An empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm import vectors
from logweir.llm.vectors import ROW

NEIGHBOURS = 5
#: How far the pruning is relaxed; one is exact.
FACTOR = 1.0
#: Entries of a leaf.
LEAF = 64
#: Vantage points tried for a node, and entries they are tried on.
TRIED, TRIED_ON = 5, 256
#: Far above the rounding errors of a distance, far below any distance that matters.
SLACK = 1e-7


@dataclass(frozen=True)
class Node:
    """A half of its parent: entries whose distances from the parent's vantage point are in ``near`` to ``far``."""

    near: float
    far: float
    vantage: np.ndarray | None
    halves: tuple[Node, ...]
    entries: np.ndarray


def distances(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Straight distances of unit vectors, all with all."""
    return np.sqrt(np.maximum(2 - 2 * (some @ others.T), 0))


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; cosines stay the same to the bit."""
    _, exponent = np.frexp(np.abs(rows).max(axis=1, initial=0, keepdims=True))
    return np.ldexp(rows, -exponent)


def running_sum(rows: np.ndarray) -> np.ndarray:
    """Sums from left to right, as a fold adds them."""
    return np.cumsum(rows, axis=1)[:, -1] if rows.shape[1] else np.zeros(len(rows))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt(running_sum(rows * rows))[:, None]


def cosines(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Cosine of each row with the same row of ``others``."""
    some, others = scaled(some), scaled(others)
    return running_sum(some * others) / (np.sqrt(running_sum(some * some)) * np.sqrt(running_sum(others * others)))


def tree(points: np.ndarray, entries: np.ndarray, draw: np.random.Generator, near: float = 0.0, far: float = 2.0) -> Node:
    if len(entries) <= LEAF:
        return Node(near, far, None, (), entries)
    tried = points[draw.choice(entries, TRIED, replace=False)]
    some = points[draw.choice(entries, min(TRIED_ON, len(entries)), replace=False)]
    vantage = tried[distances(some, tried).std(axis=0).argmax()]
    away = distances(points[entries], vantage[None, :])[:, 0]
    halves = []
    for part in np.array_split(np.argsort(away, kind="stable"), 2):
        halves.append(tree(points, np.sort(entries[part]), draw, float(away[part[0]]), float(away[part[-1]])))
    return Node(near, far, vantage, tuple(halves), entries[:0])


class Search:
    """The nearest entries of one tree for a block of queries.

    ``bound`` is a distance within which each query is known to have what it needs.
    """

    def __init__(self, points: np.ndarray, root: Node, asked: np.ndarray, bound: np.ndarray, need: int, factor: float):
        self.points, self.root, self.asked, self.need, self.factor, self.bound = points, root, asked, need, factor, bound
        # A few more than needed, as the last digits of a distance are not those of the score.
        self.found = np.full((len(asked), 2 * need), np.inf)
        self.entry = np.full((len(asked), 2 * need), -1)
        self.first = np.full(len(asked), -1)
        self.looked = 0

    def limit(self, some: np.ndarray) -> np.ndarray:
        """Distance of the last entry that an answer needs, as far as it is known."""
        return np.minimum(self.found[some, self.need - 1], self.bound[some])

    def scan(self, leaf: Node, some: np.ndarray) -> None:
        self.looked += len(some) * len(leaf.entries)
        away = distances(self.asked[some], self.points[leaf.entries])
        close = away <= self.limit(some)[:, None] + SLACK
        rows = np.flatnonzero(close.any(axis=1))
        if not len(rows):
            return
        # Only as many of the leaf as one query has within its limit take part in the merge.
        away = np.where(close[rows], away[rows], np.inf)
        best = np.argsort(away, axis=1, kind="stable")[:, : int(close[rows].sum(axis=1).max())]
        some = some[rows]
        found = np.hstack([self.found[some], np.take_along_axis(away, best, axis=1)])
        entry = np.hstack([self.entry[some], leaf.entries[best]])
        order = np.lexsort((entry, found), axis=1)[:, : self.found.shape[1]]
        self.found[some] = np.take_along_axis(found, order, axis=1)
        self.entry[some] = np.take_along_axis(entry, order, axis=1)

    def down(self, node: Node, some: np.ndarray) -> None:
        """To the leaf on the query's own side, for a first limit."""
        if not len(some) or not node.halves and not len(node.entries):
            return
        if node.vantage is None:
            self.first[some] = node.entries[0]
            return self.scan(node, some)
        inner = distances(self.asked[some], node.vantage[None, :])[:, 0] <= (node.halves[0].far + node.halves[1].near) / 2
        self.down(node.halves[0], some[inner])
        self.down(node.halves[1], some[~inner])

    def visit(self, node: Node, some: np.ndarray) -> None:
        if node.vantage is None:
            return self.scan(node, some[self.first[some] != node.entries[0]]) if len(node.entries) else None
        away = distances(self.asked[some], node.vantage[None, :])[:, 0]
        for half in node.halves:
            least = np.maximum(half.near - away, away - half.far)
            left = some[least <= self.limit(some) / self.factor + SLACK]
            if len(left):
                self.visit(half, left)

    def run(self) -> None:
        everyone = np.arange(len(self.asked))
        self.down(self.root, everyone)
        self.visit(self.root, everyone)


def first_rows(group: np.ndarray, order: tuple[np.ndarray, ...], most: int) -> np.ndarray:
    """Places of the first ``most`` rows of each group by ``order``, group by group."""
    place = np.lexsort((*reversed(order), group))
    heads = np.flatnonzero(np.concatenate([[True], np.diff(group[place]) != 0]))[: len(place)]
    rank = np.arange(len(place)) - np.repeat(heads, np.diff(np.append(heads, len(place))))
    return place[rank < most]


def shard_search(sample: pa.Table, neighbours: int, factor: float) -> vectors.Prepare:
    """What one task does: blocks of queries against the tree of a shard."""

    def prepare(rows: pa.Table, width: int):
        given, known = vectors.matrix(rows["vector"], width), vectors.matrix(sample["vector"], width)
        number, missing = vectors.ids(rows["vec_id"])
        # Adding zero makes a negative zero a plain one, so that equal vectors are the same bytes.
        alike = np.unique((given + 0.0).view(f"V{8 * width}").ravel(), return_inverse=True)[1] if given.size else np.zeros(len(given), int)
        # Of equal vectors, those that an answer can need: one more than asked for, as one may be the query.
        members = first_rows(alike, (number,), neighbours + 1)
        entry = alike[members]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(entry) != 0]))[: len(members)]
        sizes = np.diff(np.append(heads, len(members)))
        points, near, known_id = unit(given[members[heads]]), unit(known), vectors.ids(sample["vec_id"])[0]
        root = tree(points, np.arange(len(points)), np.random.default_rng(0))

        def answer(queries: pa.Table) -> pa.Table:
            asked, own = vectors.matrix(queries["vector"], width), vectors.ids(queries["vec_id"])[0]
            asking, bound = unit(asked), np.full(len(asked), np.inf)
            if len(near) >= neighbours:
                away = distances(asking, near)
                away[own[:, None] == known_id[None, :]] = np.inf
                bound = np.partition(away, neighbours - 1, axis=1)[:, neighbours - 1]
            run = Search(points, root, asking, bound, neighbours + 1, factor)
            run.run()
            who, place = np.nonzero(run.entry >= 0)
            hit = run.entry[who, place]
            who = np.repeat(who, sizes[hit])
            inside = np.arange(len(who)) - np.repeat(np.cumsum(sizes[hit]) - sizes[hit], sizes[hit])
            row = members[np.repeat(heads[hit], sizes[hit]) + inside]
            other = number[row] != own[who]
            who, row = who[other], row[other]
            score = cosines(asked[who], given[row])
            kept = first_rows(who, (-score, number[row]), neighbours)
            who, row = who[kept], row[kept]
            return pa.table(
                {
                    ROW: queries[ROW].to_numpy()[who],
                    "query_id": pa.array(own[who]),
                    "vec_id": vectors.restored(number[row], missing[row]),
                    "score": pa.array(score[kept]),
                }
            )

        return answer

    return prepare


def nearest(
    rows: DataFrame,
    queries: Column,
    neighbours: int = NEIGHBOURS,
    factor: float = FACTOR,
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``neighbours`` nearest rows of each row that ``queries`` holds for."""
    usable = rows.where(vectors.finite(F.col(vector)) & F.exists(vector, lambda x: x != 0))
    asks = F.coalesce(queries & F.col(vec_id).isNotNull(), F.lit(False))
    usable = usable.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), asks.alias("_asks"))
    placed = vectors.numbered(usable, "vectors")
    given = placed.drop("_asks")
    search = shard_search(vectors.sample(given), neighbours, factor)
    found = vectors.met(placed.where("_asks").drop("_asks"), given, search, f"{ROW} long, query_id long, vec_id long, score double")
    best = Window.partitionBy(ROW).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", "score")


def checking_sql(table: str) -> str:
    """The exact nearest five of :func:`nearest`, as a comparison of each query with all rows."""
    fold = "list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform({}, lambda p: p[1] * p[2])), lambda a, b: a + b)"
    dot = lambda one, two: fold.format(f"list_zip({one}, {two})")
    return f"""WITH vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM {table}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
, sized AS (SELECT *, sqrt({dot("v", "v")}) AS size FROM vectors)
, pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, {dot("q.v", "c.v")} / (q.size * c.size) AS score
  FROM sized q JOIN sized c ON c.vec_id IS DISTINCT FROM q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5"""
