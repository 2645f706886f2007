"""Masked pseudo-likelihood of documents under a small bidirectional window network.

The network sees ``REACH`` words on either side of a word, never the word itself, and
predicts it; the score of a document is the sum of the conditional log-probabilities of all
its words. The network predicts the class of a word: the most frequent words of all documents
have their own, the more the more different words there are, all others share ``SHARED``
classes by hash. A class is predicted in two steps, its group and its place in the group, so
a word costs two small softmaxes. A word of a shared class then has its share of the class,
count(word) / count(class) over all documents; a word counted once, or in no document, has
1 / count(class). The most frequent of them are looked up while scoring, the rest is joined.

Training is plain numpy inside tasks: every partition trains on all its words from the
same start, and the parameters are averaged by number of words, ``ROUNDS`` times. Steps are
small at first, and small partitions are passed over again, so that each makes ``LEAST_STEPS``
at least, however the input is split. What is
gathered grows with the input: counts of all words, and one set of parameters a partition.
Scores and words still to be looked up are written once under ``spark.checkpoint.dir``.

Nulls and texts without a word have 0 words, score 0 and a null mean. Texts of any length are
read whole, in blocks that see the words around them. Repeated rows and null ids are passed
on. An empty table trains nothing and gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.store import written

REACH = 2
WIDTH = 16
#: Groups of classes, and classes in a group, for up to ``FEW_WORDS`` different words; ``MORE_GROUPS`` more each time they double.
GROUPS = 32
MORE_GROUPS = 2
FEW_WORDS = 1 << 16
VOCABULARY = GROUPS * GROUPS
SHARED = 64
#: Words of shared classes at most whose counts travel with the scoring tasks; the counts of all others are joined.
LISTED = 1 << 16
#: Steps of counts within a power of e, by which the words to list are told.
COUNT_STEPS = 64
ROUNDS = 1
RATE = 0.15
SEED = 1
#: Words in a training step at most, and in a block of scoring.
BLOCK = 1 << 14
#: Words in the first training steps of a partition. A step grows with the words before it; a partition is passed
#: over until it has made ``LEAST_STEPS``.
LEAST_BLOCK = 1 << 10
LEAST_STEPS = 64
#: Words whose probabilities are computed at once, so few that what is computed of them stays in a core's cache.
PART = 1 << 12
#: Words gathered before a task trains on them, and code points of texts before it numbers their words; a text is never cut.
BATCH = 1 << 18
GATHERED = 1 << 21
#: Different characters replaced one by one in a text; more are by a pattern.
FEW_CHARACTERS = 64
#: Parameters in one row of the averaging, and groups of partitions that are added up first.
PIECE = 1024
SALTS = 256
#: Words of a text that are still to be looked up, with their numbers.
PAIRS = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))
WORD = re.compile(r"[^\W_]+")
NO_WORD = re.compile(r"[\W_]+")
#: ASCII with a blank for all that is no part of a word, and a word that no text has, put between texts.
BLANKED = "".join(chr(n) if chr(n).isalnum() else " " for n in range(128))
EDGE = "."
OFFSETS = [*range(-REACH, 0), *range(1, REACH + 1)]

def groups_for(words: int) -> int:
    """Groups of classes for so many different words."""
    return GROUPS + MORE_GROUPS * max(0, math.floor(math.log2(max(words, 1) / FEW_WORDS)))


def shapes(groups: int) -> dict[str, tuple[int, ...]]:
    return {
        "near": (len(OFFSETS), groups * groups + 1, WIDTH), "shift": (WIDTH,), "group": (WIDTH, groups), "group_bias": (groups,),
        "gate": (groups, WIDTH), "place": (WIDTH, groups), "place_bias": (groups, groups),
    }


class Vocabulary(dict):
    """Class numbers of the words with a class of their own."""

    def __init__(self, words=(), groups: int = GROUPS):
        super().__init__(words)
        self.groups = groups

    def __reduce__(self):
        return type(self), (dict(self), self.groups)


@dataclass
class Shares:
    """Log-shares of the ``listed`` words in their shared class, and of a word counted once by class."""

    listed: dict[str, float]
    once: list[float]


@dataclass
class Network:
    """Parameters of the window network by name."""

    parts: dict[str, np.ndarray]

    @staticmethod
    def start(seed: int = SEED, groups: int = GROUPS) -> Network:
        draw = np.random.default_rng(seed)
        parts = {name: (draw.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in shapes(groups).items()}
        for name in ("shift", "group_bias", "place_bias"):
            parts[name][:] = 0
        parts["gate"] += 1
        return Network(parts)

    def flat(self) -> np.ndarray:
        return np.concatenate([self.parts[name].ravel() for name in shapes(self.groups)])

    @property
    def groups(self) -> int:
        return len(self.parts["group_bias"])

    @staticmethod
    def of(values: np.ndarray, groups: int = GROUPS) -> Network:
        parts, at = {}, 0
        for name, shape in shapes(groups).items():
            size = int(np.prod(shape))
            parts[name] = values[at : at + size].reshape(shape).astype(np.float32)
            at += size
        return Network(parts)

    def _hidden(self, around: np.ndarray) -> np.ndarray:
        total = np.take(self.parts["near"][0], around[0], axis=0)
        for offset in range(1, len(OFFSETS)):
            total += np.take(self.parts["near"][offset], around[offset], axis=0)
        total += self.parts["shift"]
        return np.tanh(total, out=total)

    def _logits(self, hidden: np.ndarray, group: np.ndarray):
        first = hidden @ self.parts["group"]
        gated = hidden * self.parts["gate"][group]
        second = gated @ self.parts["place"]
        for part in in_parts(len(hidden)):
            first[part] += self.parts["group_bias"]
            second[part] += np.take(self.parts["place_bias"], group[part], axis=0)
        return first, gated, second

    def log_probabilities(self, words: np.ndarray, around: np.ndarray) -> np.ndarray:
        """Log-probability of each word given those ``around`` it (a row for each offset)."""
        group, place = np.divmod(words, self.groups)
        first, _, second = self._logits(self._hidden(around), group)
        return log_chosen(first, group).astype(np.float64) + log_chosen(second, place)

    def gradients(self, words: np.ndarray, around: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean negative log-probability."""
        group, place = np.divmod(words, self.groups)
        rows = np.arange(len(words))
        hidden = self._hidden(around)
        d_first, gated, d_second = self._logits(hidden, group)
        softmax(d_first, len(words))
        softmax(d_second, len(words))
        share = np.float32(1 / len(words))
        d_first[rows, group] -= share
        d_second[rows, place] -= share
        d_gated = d_second @ self.parts["place"].T
        d_total = d_first @ self.parts["group"].T
        d_total += d_gated * np.take(self.parts["gate"], group, axis=0)
        d_total *= 1 - hidden * hidden
        d_gated *= hidden
        # The few groups are summed by a product with their indicators.
        of_group = np.zeros((len(words), self.groups), np.float32)
        of_group[rows, group] = 1
        return {
            "near": summed_rows(around, d_total, self.groups**2 + 1),
            "shift": d_total.sum(axis=0), "group": hidden.T @ d_first, "group_bias": d_first.sum(axis=0),
            "gate": of_group.T @ d_gated, "place": gated.T @ d_second, "place_bias": of_group.T @ d_second,
        }


def in_parts(words: int) -> list[slice]:
    """Slices of so few words that what is computed of them stays in a core's cache."""
    return [slice(at, at + PART) for at in range(0, words, PART)]


def log_chosen(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen entry of each row of the log-softmax; the values are used up."""
    values -= largest(values)
    some = values[np.arange(len(values)), chosen]
    return some - np.log(np.exp(values, out=values).sum(axis=1))


def softmax(values: np.ndarray, parts: int) -> None:
    """Rows become their softmax over a number of parts."""
    for part in in_parts(len(values)):
        some = values[part]
        some -= largest(some)
        np.exp(some, out=some)
        some /= some.sum(axis=1, keepdims=True) * np.float32(parts)


def largest(values: np.ndarray) -> np.ndarray:
    """The largest entry of each row, as a column."""
    # Over whole columns, which takes half the time of one short row after another.
    return np.ascontiguousarray(values.T).max(axis=0)[:, None]


def summed_rows(keys: np.ndarray, rows: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of each key, for each row of ``keys``."""
    columns = np.ascontiguousarray(rows.T, np.float64)
    sums = np.empty((len(keys), size, len(columns)))
    for at, some in enumerate(keys):
        for k, column in enumerate(columns):
            sums[at, :, k] = np.bincount(some, column, size)
    return sums


class Steps:
    """Gradient steps whose size falls with the gradients seen so far."""

    def __init__(self, network: Network):
        self.network = network
        self.seen = {name: np.full(part.shape, 1e-8, np.float32) for name, part in network.parts.items()}

    def step(self, words: np.ndarray, around: np.ndarray) -> None:
        for name, gradient in self.network.gradients(words, around).items():
            self.seen[name] += gradient * gradient
            self.network.parts[name] -= (RATE * gradient / np.sqrt(self.seen[name])).astype(np.float32)


def classes(text: str | None, known: Vocabulary) -> list[int]:
    """Class numbers of the words of a text."""
    return class_numbers(pa.array(WORD.findall((text or "").lower()), pa.string()), known).tolist()


def class_numbers(words: pa.Array, known: Vocabulary) -> np.ndarray:
    """Class numbers of words."""
    own = pc.index_in(words, value_set=pa.array(list(known), words.type)).fill_null(-1).to_numpy()
    others = np.flatnonzero(own < 0)
    numbers = np.array([*known.values(), 0])[own]
    coded = words.take(pa.array(others)).cast(pa.large_binary()).to_numpy(zero_copy_only=False)
    numbers[others] = known.groups**2 - SHARED + np.fromiter(map(zlib.crc32, coded), np.int64, len(coded)) % SHARED
    return numbers


def shared_class(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % SHARED


@dataclass
class Windows:
    """The words of some texts: class numbers of each and of those around it, and its place among the different ``words``.

    The first of the different words is the edge of texts.
    """

    numbers: np.ndarray
    around: np.ndarray
    places: np.ndarray
    words: pa.Array
    classes: np.ndarray
    sizes: np.ndarray


def windows(texts: Iterator[str | None], known: Vocabulary) -> Iterator[Windows]:
    """Class numbers of the words of many texts, the words around each, and how many words each text has."""
    some, total = [], 0
    for text in texts:
        some.append(blanked((text or "").lower()))
        total += len(some[-1])
        if total >= GATHERED:
            yield _windows(some, known)
            some, total = [], 0
    if some:
        yield _windows(some, known)


def blanked(text: str) -> str:
    """The text with a blank for every character that is no part of a word."""
    if text.isascii():
        return text.translate(BLANKED)
    others = [character for character in set(text) if not character.isalnum()]
    if len(others) > FEW_CHARACTERS:
        return NO_WORD.sub(" ", text)
    for character in others:
        text = text.replace(character, " ")
    return text


def _windows(texts: list[str], known: Vocabulary) -> Windows:
    edge = f" {EDGE}" * REACH
    joined = "".join([edge, *(f" {text}{edge}" for text in texts)])[1:]
    # Each different word is looked up once.
    coded = pc.ascii_split_whitespace(pa.array([joined], pa.large_string())).values.dictionary_encode()
    found = coded.indices.to_numpy()
    of_word = class_numbers(coded.dictionary, known)
    of_word[0] = known.groups**2
    numbers, places = of_word[found], np.flatnonzero(found)
    ends = np.flatnonzero(found == 0)[REACH - 1 :: REACH]
    around = np.stack([numbers[places + offset] for offset in OFFSETS])
    return Windows(numbers[places], around, found[places], coded.dictionary, of_word, np.diff(ends) - REACH)


def gathered(found: Iterator[Windows]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Class numbers of the words of whole texts, ``BATCH`` words at least but in the end, and of those around them."""
    numbers, around, total = [], [], 0
    for some in found:
        ends, start = np.cumsum(some.sizes), 0
        while (full := np.searchsorted(ends, start + BATCH - total)) < len(ends):
            part = slice(start, ends[full])
            yield np.concatenate([*numbers, some.numbers[part]]), np.concatenate([*around, some.around[:, part]], axis=1)
            numbers, around, total, start = [], [], 0, ends[full]
        numbers.append(some.numbers[start:])
        around.append(some.around[:, start:])
        total += ends[-1] - start
    if total:
        yield np.concatenate(numbers), np.concatenate(around, axis=1)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[str | None]:
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            yield from batch.column(column).slice(start, 256).to_pylist()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, count`` of every word of all documents."""
    words = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    return docs.select(words.alias("word")).groupBy("word").count()


def _step() -> Column:
    return F.floor(F.log("count") * COUNT_STEPS)


def frequent(counts: DataFrame) -> tuple[Vocabulary, list, list, int]:
    """The vocabulary, the rows of its words and of frequent words without a class of their own, and the count step below which words are not listed."""
    steps = sorted(((row["step"], row["n"]) for row in counts.groupBy(_step().alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    groups = groups_for(sum(n for _, n in steps))
    own = groups * groups - SHARED
    least, total = steps[0][0] + 1 if steps else 0, 0
    for step, n in steps:
        total += n
        if total > own + LISTED:
            break
        least = step
    rows = counts.where(_step() >= least).collect()
    rows.sort(key=lambda row: (-row["count"], row["word"]))
    if len(rows) < own:
        # More words of one count than are listed: only those with a class of their own are, all others are joined.
        rows, least = counts.orderBy(F.desc("count"), "word").limit(own).collect(), steps[0][0] + 1 if steps else 0
    return Vocabulary({row["word"]: number for number, row in enumerate(rows[:own])}, groups), rows[:own], rows[own:], least


def vocabulary(docs: DataFrame, text: str = "text") -> Vocabulary:
    """The words with a class of their own, most frequent first; counted over all documents."""
    return frequent(word_counts(docs, text))[0]


def shares(counts: DataFrame, own: list, listed: list) -> Shares:
    """Shares of words in their shared class, from the counts of all words."""
    of_class = F.pmod(F.crc32(F.encode("word", "UTF-8")), F.lit(SHARED)).alias("class")
    totals = [0] * SHARED
    for row in counts.groupBy(of_class).agg(F.sum("count").alias("n")).collect():
        totals[row["class"]] = row["n"]
    for row in own:
        totals[shared_class(row["word"])] -= row["count"]
    once = [-math.log(max(total, 1)) for total in totals]
    return Shares({row["word"]: math.log(row["count"]) + once[shared_class(row["word"])] for row in listed}, once)


def train(docs: DataFrame, known: Vocabulary, rounds: int = ROUNDS, text: str = "text") -> Network:
    """Average the networks that the partitions of ``docs`` train; one set of parameters comes to the driver."""
    network, groups = Network.start(groups=known.groups), known.groups
    texts = docs.select(F.spark_partition_id().alias("part"), F.col(text).alias("text"))
    for _ in range(rounds):
        start = network.flat()

        def fit(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            steps, total, made, part = Steps(Network.of(start, groups)), 0, 0, None

            def numbered(batches):
                nonlocal part
                for batch in batches:
                    if part is None and batch.num_rows:
                        part = batch.column(0)[0].as_py()
                    yield batch

            for words, around in gathered(windows(_texts(numbered(batches), 1), known)):
                at = 0
                while at < len(words):
                    size = min(BLOCK, max(LEAST_BLOCK, (total + at) // LEAST_STEPS))
                    steps.step(words[at : at + size], around[:, at : at + size])
                    at += size
                    made += 1
                total += len(words)
            # So few steps were made in one batch, which is still at hand.
            while total and made < LEAST_STEPS:
                for at in range(0, total, LEAST_BLOCK):
                    steps.step(words[at : at + LEAST_BLOCK], around[:, at : at + LEAST_BLOCK])
                    made += 1
            if total:
                values = steps.network.flat().astype(np.float64) * total
                pieces = [values[at : at + PIECE] for at in range(0, len(values), PIECE)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(range(len(pieces))), pa.int32()), pa.array([part] * len(pieces), pa.int32()),
                        pa.array([total] * len(pieces), pa.int64()), pa.array([piece.tolist() for piece in pieces], pa.list_(pa.float64())),
                    ],
                    names=["piece", "part", "words", "weighted"],
                )

        def added(table: pa.Table) -> pa.Table:
            # In order of partitions, so that sums come out the same each time.
            table = table.sort_by("part")
            total = np.zeros(len(table.column("weighted")[0]))
            for values in table.column("weighted"):
                total += values.values.to_numpy(zero_copy_only=False)
            words = sum(table.column("words").to_pylist())
            return pa.table(
                {
                    "piece": pa.array([table.column("piece")[0].as_py()], pa.int32()), "part": pa.array([table.column("part")[0].as_py()], pa.int32()),
                    "words": pa.array([words], pa.int64()), "weighted": pa.array([total.tolist()], pa.list_(pa.float64())),
                }
            )

        kinds = "piece int, part int, words long, weighted array<double>"
        fitted = texts.mapInArrow(fit, kinds)
        some = fitted.groupBy("piece", F.pmod("part", F.lit(SALTS)).alias("salt")).applyInArrow(added, kinds)
        rows = some.groupBy("piece").applyInArrow(added, kinds).collect()
        if not rows:
            return network
        rows.sort(key=lambda row: row["piece"])
        network = Network.of(np.concatenate([np.array(row["weighted"]) / row["words"] for row in rows]), groups)
    return network


def score(docs: DataFrame, network: Network, known: Vocabulary, doc_id: str = "doc_id", text: str = "text", within: Shares | None = None) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean`` of the classes of the words: one pass without a shuffle.

    Given ``within``, the shares of words in shared classes are added; words that are not listed there
    count as seen once and follow as ``rest``, each with its number in the text.
    """
    values, groups = network.flat(), network.groups
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    fields = "n_words long, log_likelihood double, mean double"

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.of(values, groups)
        for batch in batches:
            sums, counts, rest = [], [], []
            for found in windows(_texts(iter([batch]), 1), known):
                words, around = found.numbers, found.around
                logs = [own.log_probabilities(words[at : at + PART], around[:, at : at + PART]) for at in range(0, len(words), PART)]
                logs = np.concatenate([[0.0], np.cumsum(np.concatenate(logs))]) if logs else np.zeros(1)
                ends = np.cumsum(found.sizes)
                sums.append(logs[ends] - logs[ends - found.sizes])
                counts.append(found.sizes)
                if within is not None:
                    added, left = _added(found, known, within)
                    sums[-1] += added
                    rest.append(left)
            total = np.concatenate(sums) if sums else np.zeros(0)
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            mean = [value / n if n else None for value, n in zip(total.tolist(), counts.tolist())]
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(total, pa.float64()), pa.array(mean, pa.float64())]
            names = ["doc_id", "n_words", "log_likelihood", "mean"]
            if within is not None:
                columns, names = [*columns, pa.concat_arrays(rest) if rest else pa.array([], PAIRS)], [*names, "rest"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    if within is not None:
        fields += ", rest array<struct<word: string, n: int>>"
    return rows.mapInArrow(scored, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {fields}")


def _added(found: Windows, known: Vocabulary, within: Shares) -> tuple[np.ndarray, pa.Array]:
    """Log-shares of the words of each text in shared classes, and its words that are not listed with their numbers."""
    first = known.groups**2 - SHARED
    shared = (found.classes >= first) & (found.classes < known.groups**2)
    listed = pc.index_in(found.words, value_set=pa.array(list(within.listed), found.words.type)).fill_null(-1).to_numpy()
    once = np.array(within.once)[np.where(shared, found.classes - first, 0)]
    share = np.where(shared, np.where(listed < 0, once, np.array([*within.listed.values(), 0.0])[listed]), 0.0)
    left = shared & (listed < 0)
    texts = np.repeat(np.arange(len(found.sizes)), found.sizes)
    added = np.bincount(texts, share[found.places], len(found.sizes))
    some = left[found.places]
    pairs, n = np.unique(texts[some] * len(found.words) + found.places[some], return_counts=True)
    of_text, places = np.divmod(pairs, len(found.words))
    ends = np.concatenate([[0], np.cumsum(np.bincount(of_text, minlength=len(found.sizes)))])
    words = pa.StructArray.from_arrays([found.words.take(pa.array(places)).cast(pa.string()), pa.array(n, pa.int32())], fields=list(PAIRS.value_type))
    return added, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words, type=PAIRS)


def pseudo_likelihood(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on all documents and score all words of all: doc_id, n_words, log_likelihood, mean."""
    counts = written(word_counts(docs, text), "words")
    known, own, listed, least = frequent(counts)
    network = train(docs, known, text=text)
    part = score(docs, network, known, doc_id, text, shares(counts, own, listed))
    # The number of a row is written with it, so both sides of the join agree on it.
    part = written(part.withColumn("_row", F.monotonically_increasing_id()), "scores")
    # Listed and own words are none of the rest; a word counted once adds nothing.
    rare = counts.where((_step() < least) & (F.col("count") > 1))
    pairs = part.select("_row", F.explode("rest").alias("pair")).select("_row", "pair.word", "pair.n")
    gain = pairs.join(rare, "word").groupBy("_row").agg(F.sum(F.col("n") * F.log("count")).alias("_gain"))
    total = F.col("log_likelihood") + F.coalesce("_gain", F.lit(0.0))
    whole = part.join(gain, "_row", "left").withColumn("log_likelihood", total)
    mean = F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words"))
    return whole.select("doc_id", "n_words", "log_likelihood", mean.alias("mean"))
