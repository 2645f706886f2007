"""Near-duplicates by SimHash, found by exact comparison of tiles.

A fingerprint has a bit for each bit of XXH64 (seed 42) that is set in over half the
hashes of the three-word shingles. Distinct fingerprints are dealt into tiles by the
population counts of their eight bytes. Two fingerprints differ in at least as many bits
as their population counts differ in sum, so a tile only meets the tiles within the
radius and all other pairs of tiles are skipped. Inside a task, pairs are compared by
numpy exclusive-or and bit counts; a task passes on a forest of its links, never all pairs.

Nulls, empty texts and texts of white space have fingerprint zero and are linked like
any other. Equal fingerprints are one node, so copies cost nothing more. Repeated rows stay
repeated. Null ids never name a component unless all its ids are null. An empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.links import components
from logweir.llm.store import written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Homes of one tile that one task compares with the whole tile; larger tiles are split.
TILE = 4096
#: Pairs compared at once in a task.
PAIRS = 1 << 20
#: Shingles hashed at once.
BLOCK = 1 << 16


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text, UTF-8."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, sizes = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    span = min(shingle, len(words))
    starts, ends = (ends - sizes)[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    digest, seed, ones = xxhash.xxh64_intdigest, SEED, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK])]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (a signed long) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(hashed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def steps(radius: int, parts: int = 8) -> np.ndarray:
    """Differences of population counts whose sum is within the radius, one of each opposite pair, and zero first."""
    found = [tuple([0] * parts)]
    for used in range(1, radius + 1):
        for places in combinations(range(parts), used):
            for change in product([x for x in range(-radius, radius + 1) if x], repeat=used):
                if sum(map(abs, change)) <= radius and change[0] > 0:
                    step = [0] * parts
                    for place, value in zip(places, change):
                        step[place] = value
                    found.append(tuple(step))
    return np.array(found, dtype=np.int16)


def tile_codes(counts: np.ndarray) -> np.ndarray:
    """Population counts (0 to 8) of the bytes as one long, four bits each."""
    return (counts.astype(np.int64) << np.arange(0, 4 * counts.shape[-1], 4)).sum(axis=-1)


def byte_counts(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint8).reshape(-1, 8)).astype(np.int16)


def visits(nodes: DataFrame, radius: int) -> DataFrame:
    """``tile, fp``: every fingerprint in its own tile and in those it has to be compared with."""
    moves = steps(radius)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                fps = batch.column(0).slice(start, 2048).to_numpy(zero_copy_only=False).astype(np.int64)
                tiles = byte_counts(fps)[:, None, :] + moves[None, :, :]
                inside = ((tiles >= 0) & (tiles <= 8)).all(axis=2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tile_codes(tiles)[inside]), pa.array(np.broadcast_to(fps[:, None], inside.shape)[inside])], names=["tile", "fp"]
                )

    return nodes.select("fp").mapInArrow(dealt, "tile long, fp long")


def absorb(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the trees of ``a`` and ``b`` pairwise; every entry of ``roots`` is a root."""
    while True:
        one, two = roots[a], roots[b]
        apart = one != two
        if not apart.any():
            return roots
        np.minimum.at(roots, np.maximum(one[apart], two[apart]), np.minimum(one[apart], two[apart]))
        while (roots[roots] != roots).any():
            roots = roots[roots]


def forest(group: np.ndarray, fps: np.ndarray, mine: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of sorted groups as a forest: rows flagged ``mine`` against all rows of their group."""
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(heads, len(group)))
    which = np.repeat(np.arange(len(heads)), sizes)
    rows = np.flatnonzero(mine)
    reach, roots = np.cumsum(sizes[which[rows]]), np.arange(len(group))
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + PAIRS, "right")))
        some = rows[at:stop]
        width = sizes[which[some]]
        left = np.repeat(some, width)
        right = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(heads[which[some]], width)
        near = np.bitwise_count(fps[left] ^ fps[right]) <= radius
        left, right = left[near], right[near]
        once = ~home[right] | (fps[left] < fps[right])
        roots = absorb(roots, left[once], right[once])
        at = stop
    linked = np.flatnonzero(roots != np.arange(len(group)))
    return fps[linked], fps[roots[linked]]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that join exactly the fingerprints ``fp`` of ``nodes`` that the radius joins.

    A tile with many homes is split: each task has a share of the homes and meets the
    whole tile, as in a blocked comparison.
    """
    rows = visits(nodes, radius)
    own = nodes.select(F.col("fp"))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tile_codes(byte_counts(fps)))], names=["hot"])

    hot = own.mapInArrow(at_home, "hot long").groupBy("hot").count().where(F.col("count") > TILE)
    hot = hot.select("hot", F.ceil(F.col("count") / TILE).cast("int").alias("shares"))
    rows = rows.join(hot, rows["tile"] == hot["hot"], "left").drop("hot")
    shares = F.coalesce("shares", F.lit(1))
    rows = rows.select("tile", "fp", shares.alias("shares"), F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    rows = rows.select(F.xxhash64("tile", "share").alias("group"), "tile", "fp", (F.pmod(F.xxhash64("fp"), "shares") == F.col("share")).alias("mine"))
    rows = rows.repartition("group").sortWithinPartitions("group", "tile")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(group, tile, fps, share) -> pa.RecordBatch:
            home = tile_codes(byte_counts(fps)) == tile
            a, b = forest(group, fps, share & home, home, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        kept = None
        for batch in batches:
            parts = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            parts = parts if kept is None else [np.concatenate(pair) for pair in zip(kept, parts)]
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(parts[0], parts[0][-1])) if len(parts[0]) else 0
            if cut:
                yield out(*[np.ascontiguousarray(x[:cut]) for x in parts])
            kept = [x[cut:] for x in parts]
        if kept is not None and len(kept[0]):
            yield out(*[np.ascontiguousarray(x) for x in kept])

    return rows.mapInArrow(compared, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row per document with its class."""
    rows = written(fingerprints(docs, doc_id, text), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = components(links(nodes, radius))
    classes = nodes.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    classes = written(classes, "classes")
    least = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
