"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram binds the vectors of its
letters, each permuted by its place, by multiplication; a text bundles its trigrams by
addition; a language is the bundle of its learned texts. A text has the language whose
prototype is nearest by cosine.

Texts are lower-cased; what is no letter becomes one space between words. A null text,
or one without a letter, is ``und`` with score 0. Scores are cosines, 0 where negative.
Ties go to the language first by code point. Rows without a language are not learned
from; if nothing can be learned, every text is ``und``. Any number of repeated rows,
null ids and further columns are passed on as they are; columns named like the two
results are replaced. Texts of any length are read whole, a block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 512
SEED = 7
#: Bound of the learning sample: about so many texts of each language, chosen by hash of the id.
SAMPLE_PER_LANGUAGE = 8_000
UNKNOWN = "und"
#: Doc vectors are bundled as integers of this scale, so sums do not depend on their order.
SCALE = 1 << 20
#: Characters handled at once.
BLOCK = 1 << 20
SPACE = 32
#: Which code points of the basic plane are letters.
LETTER = np.array([chr(code).isalpha() for code in range(1 << 16)])


@dataclass(frozen=True)
class Profiles:
    """Languages in code point order and their unit prototype vectors, one row each."""

    languages: list[str]
    vectors: np.ndarray


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The fixed random vector of each code point, as int8 rows."""
    return np.stack([np.random.default_rng((SEED, int(code))).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1 for code in codes])


def letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased text, every run of other characters as one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = LETTER[np.minimum(codes, len(LETTER) - 1)]
    for place in np.flatnonzero(codes >= len(LETTER)).tolist():
        letter[place] = chr(int(codes[place])).isalpha()
    codes = np.where(letter, codes, SPACE)
    return codes[letter | np.concatenate([[True], letter[:-1]])]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed trigrams of one text and their counts, summed over blocks; empty without a letter."""
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for start in range(0, len(text), BLOCK):
        # Two characters of overlap on the left, so no trigram between blocks is lost.
        piece = text[max(0, start - 2) : start + BLOCK]
        codes = letters_only(" " * (start == 0) + piece + " " * (start + BLOCK >= len(text)))
        if not (codes != SPACE).any() or len(codes) < 3:
            continue
        found, times = np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)
        merged, where = np.unique(np.concatenate([keys, found]), return_inverse=True)
        keys, counts = merged, np.bincount(where, np.concatenate([counts, times]), len(merged)).astype(np.int64)
    return keys, counts


def trigram_vectors(keys: np.ndarray) -> np.ndarray:
    parts = np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF])
    codes, where = np.unique(parts, return_inverse=True)
    letters, where = letter_vectors(codes), where.reshape(parts.shape)
    return np.roll(letters, 2, axis=1)[where[0]] * np.roll(letters, 1, axis=1)[where[1]] * letters[where[2]]


def text_vectors(texts: list[str | None]) -> np.ndarray:
    """Unit vectors of texts, zero for those without a letter."""
    result = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (size == 0 or size < BLOCK):
            size += len(texts[stop] or "")
            stop += 1
        grams = [trigrams(text or "") for text in texts[start:stop]]
        known = np.unique(np.concatenate([keys for keys, _ in grams]))
        if len(known):
            table = trigram_vectors(known)
            for row, (keys, counts) in enumerate(grams, start):
                if len(keys):
                    vector = counts.astype(np.float32) @ table[np.searchsorted(known, keys)].astype(np.float32)
                    result[row] = vector / max(float(np.linalg.norm(vector)), 1e-9)
        start = stop
    return result


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents kept from learning: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Prototypes of the languages of ``docs``.

    Learned from about ``per_language`` texts of each language, a documented bound: ids
    are chosen by hash at a rate that follows from the count of the language. What comes
    to the driver is one count and one vector a language.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 20)).alias("draw")
    )
    counts = {row["lang"]: row["count"] for row in labelled.groupBy("lang").count().collect()}
    if not counts:
        return Profiles([], np.zeros((0, DIMENSIONS)))
    rates = F.create_map(*[F.lit(x) for name, n in counts.items() for x in (name, int((1 << 20) * min(1.0, per_language / n)))])
    sample = labelled.where(F.col("draw") < rates[F.col("lang")]).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            vectors = np.rint(text_vectors(batch.column(1).to_pylist()) * SCALE).astype(np.int64)
            for name in set(names.tolist()):
                sums[name] = sums.get(name, 0) + vectors[names == name].sum(axis=0)
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(list(sums), pa.string()), "part": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))}
        )

    parts = sample.mapInArrow(bundle, "lang string, part array<long>").select("lang", F.posexplode("part").alias("at", "value"))
    totals = parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("cells"))
    rows = sorted((row["lang"], [cell["value"] for cell in row["cells"]]) for row in totals.collect())
    vectors = np.array([cells for _, cells in rows], dtype=np.float64).reshape(len(rows), DIMENSIONS)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Profiles([name for name, _ in rows], vectors / np.where(norms > 0, norms, 1))


def with_language(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, in one pass and without a shuffle."""
    docs = docs.drop(*[name for name in ("lang_pred", "score") if name != text])
    place = docs.columns.index(text)
    languages, vectors = profiles.languages, profiles.vectors.astype(np.float32)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, max(1, whole.num_rows), 1024):
                batch = whole.slice(start, 1024)
                found = text_vectors(batch.column(place).to_pylist())
                known = np.abs(found).any(axis=1) & bool(languages)
                cosines = found @ vectors.T if languages else np.zeros((len(found), 1), np.float32)
                best = cosines.argmax(axis=1) if len(found) else np.zeros(0, int)
                score = np.clip(cosines[np.arange(len(found)), best], 0, 1).astype(np.float64)
                names = [languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())], names=schema.names
                )

    return docs.mapInArrow(predict, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the documents that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    profiles = learn(docs.where(~held_out(doc_id)), doc_id=doc_id, text=text, lang=lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.col(text).alias("text"))
    return with_language(rows, profiles).drop("text")
