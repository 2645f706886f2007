"""Removal of byte strings that an earlier document has, by a depth-limited radix sort of suffixes.

Suffixes are ordered most significant digit first and only through ``WIDTH`` bytes. A
suffix enters at an anchor (see :mod:`logweir.llm.windows`); suffixes that are alone in
their group after a pass leave the sort:

1. First digit: the bytes of the anchor. Anchors that one document alone has leave.
2. All bytes that windows of an anchor can reach. Where an earlier document has the same
   bytes, all windows of the anchor are repeated; the first document stays.
3. Where anchors of equal bytes stand in different bytes, their first documents go
   through the rest of the ``WIDTH`` bytes, window by window. Equal groups are the repeated windows.

A digit is dealt to radix buckets by its hash. Blocks of documents send each digit they
have once, with the smallest document that has it, so neither a copied text nor a common
line is ever more than one entry a block and bucket; what comes back is one bit an entry.
Documents are stored once, bucketed by block, and are not shuffled by the passes.

Nulls: a null text is empty, a null id is later than all others. Rows of one id do not
remove from each other. Texts shorter than the width are kept. An empty table gives an empty result.
Further columns are passed on where they are asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from math import ceil
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm import windows
from logweir.llm.store import new_folder, written
from logweir.llm.windows import ODD, Anchors, Texts

#: Bytes of text in a block of documents, and entries in a radix bucket, about.
BLOCK_BYTES = 8 << 20
BUCKET_ENTRIES = 2_000_000
LAST_ID = (1 << 63) - 1

GRAM, CONTEXT, SPREAD, WINDOW = range(4)
ENTRIES = "kind int, bucket long, block long, size int, payload binary"
ANSWERS = "kind int, bucket long, block long, bits binary"


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit values, one byte place after the other."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(payload: bytes, size: int, width: int, offset: int = 0) -> np.ndarray:
    values = np.zeros((size, 8), np.uint8)
    values[:, :width] = np.frombuffer(payload, np.uint8, size * width, offset).reshape(width, size).T
    return values.view(np.uint64).reshape(-1)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a key from bits that its own comparison does not rest on alone."""
    mixed = (keys ^ (keys >> np.uint64(33))) * ODD[30]
    return ((mixed >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def least_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the least value of each, and the place of every row's key."""
    distinct, where = np.unique(keys, return_inverse=True)
    least = np.full(len(distinct), LAST_ID, np.int64)
    np.minimum.at(least, where, values)
    return distinct, least, where


class Block:
    """One block of documents in the passes; everything follows from its set of rows."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None], buckets: int, answers: pa.Table | None):
        self.texts: Texts = windows.side_by_side(texts)
        self.ids = np.array([LAST_ID if x is None else x for x in ids], dtype=np.int64)
        self.buckets = buckets
        self.bits: dict[tuple[int, int], bytes] = {}
        if answers is not None:
            for kind, bucket, bits in zip(*(answers.column(name).to_pylist() for name in ("kind", "bucket", "bits"))):
                self.bits[kind, bucket] = bits

    def entries(self, kind: int, keys: np.ndarray, parts: list[tuple[np.ndarray, int]]):
        """Rows of ``ENTRIES`` without the block; ``keys`` are distinct and in order."""
        buckets = bucket_of(keys, self.buckets)
        order = np.argsort(buckets, kind="stable")
        names, heads = np.unique(buckets[order], return_index=True)
        for name, some in zip(names.tolist(), np.split(order, heads[1:])):
            yield kind, name, len(some), b"".join(planes(values[some], width) for values, width in parts)

    def answers(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The bit that came back for each of the keys that ``entries`` sent."""
        buckets, found = bucket_of(keys, self.buckets), np.zeros(len(keys), bool)
        order = np.argsort(buckets, kind="stable")
        names, heads = np.unique(buckets[order], return_index=True)
        for name, some in zip(names.tolist(), np.split(order, heads[1:])):
            found[some] = np.unpackbits(np.frombuffer(self.bits[kind, name], np.uint8), count=len(some)).astype(bool)
        return found

    def grams(self) -> tuple[Anchors, np.ndarray]:
        found = windows.anchors(self.texts)
        gram = (found.gram ^ (found.gram >> np.uint64(31))) * ODD[29]
        return found, gram ^ (gram >> np.uint64(29))

    def first_pass(self):
        _, gram = self.grams()
        keys = np.unique(gram)
        yield from self.entries(GRAM, keys, [(keys, 6)])

    def live(self) -> tuple[Anchors, np.ndarray, np.ndarray, np.ndarray]:
        """Anchors that two documents or more have, their grams, contexts and documents."""
        found, gram = self.grams()
        keys, where = np.unique(gram, return_inverse=True)
        owner = self.ids[found.text]
        least, most = np.full(len(keys), LAST_ID), np.full(len(keys), -LAST_ID - 1)
        np.minimum.at(least, where, owner)
        np.maximum.at(most, where, owner)
        shared = (least != most) | self.answers(GRAM, keys)
        some = np.flatnonzero(shared[where])
        kept = found[some]
        return kept, gram[some], windows.context_hash(self.texts, kept), owner[some]

    @staticmethod
    def context_keys(gram: np.ndarray, context: np.ndarray) -> np.ndarray:
        keys = gram * ODD[28] + context
        return keys ^ (keys >> np.uint64(32))

    def second_pass(self):
        _, gram, context, owner = self.live()
        keys, least, _ = least_by(self.context_keys(gram, context), owner)
        yield from self.entries(CONTEXT, keys, [(keys, 8), (least, 8)])
        grams, where = np.unique(gram, return_inverse=True)
        low, high = np.full(len(grams), ~np.uint64(0)), np.zeros(len(grams), np.uint64)
        np.minimum.at(low, where, context)
        np.maximum.at(high, where, context)
        yield from self.entries(SPREAD, grams, [(grams, 6), (low, 6), ((low != high).astype(np.uint64), 1)])

    def settled(self) -> tuple[Anchors, np.ndarray, np.ndarray, np.ndarray]:
        """Live anchors, whether all their windows are repeated, which go on window by window, and owners."""
        some, gram, context, owner = self.live()
        keys, least, where = least_by(self.context_keys(gram, context), owner)
        repeated = self.answers(CONTEXT, keys)[where] | (owner > least[where])
        grams, place = np.unique(gram, return_inverse=True)
        spread = self.answers(SPREAD, grams)[place]
        return some, repeated, ~repeated & spread, owner

    def opened(self, some: Anchors, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, hashes and documents of all windows of the anchors."""
        count = some.last - some.first + 1
        starts = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(some.first, count)
        return starts, windows.window_hash(self.texts, starts), np.repeat(owner, count)

    def third_pass(self):
        some, _, going, owner = self.settled()
        _, hashes, owners = self.opened(some[going], owner[going])
        keys, least, _ = least_by(hashes, owners)
        yield from self.entries(WINDOW, keys, [(keys, 8), (least, 8)])

    def removed(self) -> np.ndarray:
        """Which bytes of the buffer go."""
        some, repeated, going, owner = self.settled()
        change = np.zeros(len(self.texts.buffer) + 1, np.int32)
        np.add.at(change, some.first[repeated], 1)
        np.add.at(change, some.last[repeated] + windows.WIDTH, -1)
        starts, hashes, owners = self.opened(some[going], owner[going])
        keys, least, where = least_by(hashes, owners)
        starts = starts[self.answers(WINDOW, keys)[where] | (owners > least[where])]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + windows.WIDTH, -1)
        return np.cumsum(change[:-1]) > 0

    def results(self):
        """n_bytes, n_removed, n_spans and kept bytes of each text."""
        gone, buffer = self.removed(), self.texts.buffer
        for start, end in zip(self.texts.starts.tolist(), self.texts.ends.tolist()):
            off = gone[start:end]
            count = int(off.sum())
            kept = buffer[start:end]
            spans = int(off[:1].sum() + (off[1:] & ~off[:-1]).sum()) if count else 0
            yield end - start, count, spans, (kept[~off] if count else kept).tobytes()


def resolve(kind: int, sizes: list[int], payloads: list[bytes]) -> list[bytes]:
    """The bits of one bucket: for each entry of each block, whether its group goes on or is repeated."""
    def column(width: int, before: int = 0) -> np.ndarray:
        return np.concatenate([from_planes(load, size, width, before * size) for load, size in zip(payloads, sizes)])

    if kind == GRAM:
        keys = column(6)
        _, where, times = np.unique(keys, return_inverse=True, return_counts=True)
        bits = times[where] > 1
    elif kind == SPREAD:
        keys, context, mixed = column(6), column(6, 6), column(1, 12)
        distinct, where = np.unique(keys, return_inverse=True)
        low, high, any_mixed = np.full(len(distinct), ~np.uint64(0)), np.zeros(len(distinct), np.uint64), np.zeros(len(distinct), np.uint64)
        np.minimum.at(low, where, context)
        np.maximum.at(high, where, context)
        np.maximum.at(any_mixed, where, mixed)
        bits = ((low != high) | (any_mixed > 0))[where]
    else:
        owners = column(8, 8).view(np.int64)
        _, least, where = least_by(column(8), owners)
        bits = least[where] < owners
    return [np.packbits(part).tobytes() for part in np.split(bits, np.cumsum(sizes)[:-1])]


def answered(entries: DataFrame) -> DataFrame:
    """``ANSWERS`` of ``ENTRIES``: a group is one radix bucket, whose size does not grow with any key."""

    def solve(table: pa.Table) -> pa.Table:
        kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
        bits = resolve(kind, table.column("size").to_pylist(), table.column("payload").to_pylist())
        return pa.table(
            {
                "kind": pa.array([kind] * len(bits), pa.int32()), "bucket": pa.array([bucket] * len(bits), pa.int64()),
                "block": table.column("block").combine_chunks(), "bits": pa.array(bits, pa.binary()),
            }
        )

    return entries.groupBy("kind", "bucket").applyInArrow(solve, ANSWERS)


def _stored(docs: DataFrame, doc_id: str, text: str, carried: Iterable[str]) -> tuple[str, int]:
    """The documents as a table bucketed by block; its name and the number of blocks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.encode(F.col(text), "UTF-8").alias("_text"), F.struct(F.lit(1).alias("_"), *[F.col(name) for name in carried]).alias("_rest"))
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, ceil(total / BLOCK_BYTES))
    # By id and text, so that rows of one id, or of none, are dealt out like any others.
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)))
    name = f"repeats_{uuid4().hex}"
    # Spark bounds the number of buckets; beyond that a bucket holds several blocks, which tasks take one by one.
    buckets = min(blocks, int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    rows.repartition(buckets, "_block").write.option("compression", "zstd").option("path", new_folder(spark, "repeats")).bucketBy(buckets, "_block").saveAsTable(name)
    return name, max(1, ceil(total / 14 / BUCKET_ENTRIES))


def search(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", carried: Iterable[str] = (), as_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes, or whole characters) and a struct ``rest`` of the carried columns."""
    spark = docs.sparkSession
    name, buckets = _stored(docs, doc_id, text, carried)
    stored = spark.table(name)
    narrow = stored.select("_block", "_id", "_text")

    def block_of(table: pa.Table, answers: pa.Table | None) -> Block:
        return Block(table.column("_id").to_pylist(), table.column("_text").to_pylist(), buckets, answers)

    def sent(table: pa.Table, rows) -> pa.Table:
        kinds, names, sizes, payloads = list(zip(*rows)) or [(), (), (), ()]
        block = table.column("_block")[0].as_py() if table.num_rows else 0
        return pa.table(
            {
                "kind": pa.array(kinds, pa.int32()), "bucket": pa.array(names, pa.int64()), "block": pa.array([block] * len(kinds), pa.int64()),
                "size": pa.array(sizes, pa.int32()), "payload": pa.array(payloads, pa.binary()),
            }
        )

    def first(table: pa.Table) -> pa.Table:
        return sent(table, block_of(table, None).first_pass())

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        return sent(table, block_of(table, answers).second_pass())

    def third(table: pa.Table, answers: pa.Table) -> pa.Table:
        return sent(table, block_of(table, answers).third_pass())

    def last(table: pa.Table, answers: pa.Table) -> pa.Table:
        results = list(block_of(table, answers).results()) if table.num_rows else []
        sizes, removed, spans, kept = zip(*results) if results else ((), (), (), ())
        kept = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
        return pa.table(
            {
                "doc_id": table.column("_id").combine_chunks(), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array(spans, pa.int64()), "kept": kept, "rest": table.column("_rest").combine_chunks(),
            }
        )

    def against(documents: DataFrame, answers: DataFrame):
        return documents.groupBy("_block").cogroup(answers.groupBy("block"))

    answers = written(answered(narrow.groupBy("_block").applyInArrow(first, ENTRIES)), "answers")
    for step in (second, third):
        more = answered(against(narrow, answers).applyInArrow(step, ENTRIES))
        answers = answers.unionByName(written(more, "answers"))
    fields = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"
    schema = T.StructType([*T.StructType.fromDDL(fields).fields, T.StructField("rest", stored.schema["_rest"].dataType)])
    return against(stored, answers).applyInArrow(last, schema)


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What the removal does to each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return search(docs, doc_id, text).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with the remaining text, in the same columns; documents of which nothing is left go.

    A character of which some bytes go is left out as a whole; a null text stays null. ``n_chars`` follows the text.
    """
    found = search(docs, doc_id, text, docs.columns, as_text=True).where("n_removed = 0 or n_removed < n_bytes")
    same = F.col("n_removed") == 0
    new = {text: F.when(~same, F.col("kept")).otherwise(F.col("rest")[text])}
    if n_chars in docs.columns:
        old = F.col("rest")[n_chars]
        new[n_chars] = F.when(~same, F.length("kept").cast(docs.schema[n_chars].dataType)).otherwise(old)
    return found.select(*[new.get(name, F.col("rest")[name]).alias(name) for name in docs.columns])


def naive(ids: list[int], texts: list[bytes], width: int = windows.WIDTH) -> list[tuple[int, int, int, str]]:
    """The contract word by word, for tests: n_bytes, n_removed, n_spans, kept_sha256."""
    first: dict[bytes, int] = {}
    for number, text in zip(ids, texts):
        for at in range(len(text) - width + 1):
            piece = text[at : at + width]
            first[piece] = min(number, first.get(piece, number))
    rows = []
    for number, text in zip(ids, texts):
        gone = np.zeros(len(text), bool)
        for at in range(len(text) - width + 1):
            if first[text[at : at + width]] < number:
                gone[at : at + width] = True
        spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        rows.append((len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return rows
