"""Anchors of byte windows: the numpy kernel of the repeated-window search.

Every window of ``WIDTH`` bytes has an anchor inside, the ``GRAM`` bytes with the least
hash. Equal windows have anchors of equal bytes, so suffixes need to be ordered from
anchors only, about one position in fourteen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes of a window, and of the first digit: a suffix's first bytes from its anchor on.
WIDTH = 50
GRAM = 24
REACH = WIDTH - GRAM
#: Zero bytes between texts; wider than any context reaches.
GAP = 64
#: Window starts handled at once; small enough for the cache.
CHUNK = 1 << 16
#: Odd 64-bit multipliers of the hashes: fixed values, any odd numbers serve.
ODD = np.random.default_rng(50).integers(1 << 62, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass
class Texts:
    """Texts of a block side by side, ``GAP`` zero bytes around each; ``starts`` and ``ends`` are their places."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def side_by_side(texts: list[bytes | None]) -> Texts:
    sizes = np.fromiter((len(text or b"") for text in texts), np.int64, len(texts))
    ends = np.cumsum(sizes + GAP)
    pad = bytes(GAP)
    return Texts(np.frombuffer(pad + b"".join(part for text in texts for part in (text or b"", pad)), np.uint8), ends - sizes, ends)


def words_at(buffer: np.ndarray, first: int, last: int) -> np.ndarray:
    """The eight bytes from every place in [first, last) on, as one number, mixed."""
    loose = np.ndarray((last - first,), dtype="<u8", buffer=buffer[first : last + 7], strides=(1,))
    mixed = loose * ODD[0]
    mixed ^= mixed >> np.uint64(29)
    return mixed


@dataclass
class Anchors:
    """Anchors in order of place: text number, place, hash of the gram, first and last window start."""

    text: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def __getitem__(self, some) -> Anchors:
        return Anchors(self.text[some], self.place[some], self.gram[some], self.first[some], self.last[some])


def anchors(texts: Texts) -> Anchors:
    """All anchors of the texts. A window start between texts, or too near an end, has none."""
    found: list[tuple[np.ndarray, ...]] = []
    stop = len(texts.buffer) - GAP
    last_start = texts.ends - WIDTH
    for begin in range(GAP, stop, CHUNK):
        end = min(stop, begin + CHUNK)
        # Grams of windows that start in [begin, end) start in [begin, end + REACH].
        eight = words_at(texts.buffer, begin, end + REACH + 17)
        size = end - begin + REACH + 1
        least = eight[:size] + eight[8 : 8 + size] * ODD[1] + eight[16 : 16 + size] * ODD[2]
        places = np.arange(begin, begin + size, dtype=np.uint64)
        least &= np.uint64(0xFFFFFFFFFFFFFFC0)
        least |= places & np.uint64(63)
        for step in (1, 2, 4, 8):
            least = np.minimum(least[:-step], least[step:])
        least = np.minimum(least[: end - begin], least[REACH + 1 - 16 : REACH + 1 - 16 + end - begin])
        starts = places[: end - begin]
        anchor = starts + ((least - starts) & np.uint64(63))
        heads = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
        heads = np.concatenate([[0], heads])
        tails = np.append(heads[1:], end - begin) - 1
        found.append((anchor[heads].astype(np.int64), least[heads] >> np.uint64(6), heads + begin, tails + begin))
    if not found:
        none = np.zeros(0, np.int64)
        return Anchors(none, none, none.astype(np.uint64), none, none)
    place, gram, first, last = (np.concatenate(parts) for parts in zip(*found))
    # Windows of a run that lie in the gap or reach over an end do not count. An anchor
    # inside a text has its windows there; the gap's own anchors go.
    text = np.searchsorted(texts.starts, place, "right") - 1
    first = np.maximum(first, texts.starts[text])
    last = np.minimum(last, last_start[text])
    kept = (text >= 0) & (first <= last)
    return Anchors(text, place, gram, first, last)[kept]


def gathered(buffer: np.ndarray, places: np.ndarray, offsets: list[int], seed: int) -> np.ndarray:
    """Hash of the eight-byte pieces at ``offsets`` from each place."""
    total = np.full(len(places), ODD[seed], np.uint64)
    loose = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    for number, offset in enumerate(offsets):
        piece = loose[places + offset] * ODD[seed + 1]
        piece ^= piece >> np.uint64(29)
        total += piece * ODD[(seed + 2 + number) % len(ODD)]
        total ^= total >> np.uint64(32)
        total *= ODD[seed + 1]
    return total ^ (total >> np.uint64(29))


def context_hash(texts: Texts, some: Anchors, seed: int = 3) -> np.ndarray:
    """Hash of the bytes that the windows of an anchor can reach, and of where the text ends in them."""
    reach = [*range(-REACH, WIDTH - 8, 8), WIDTH - 8]
    before = np.minimum(REACH, some.place - texts.starts[some.text])
    after = np.minimum(WIDTH, texts.ends[some.text] - some.place)
    edges = (before * 64 + after).astype(np.uint64)
    total = gathered(texts.buffer, some.place, reach, seed) + edges * ODD[seed]
    total ^= total >> np.uint64(31)
    return total * ODD[seed + 1]


def window_hash(texts: Texts, starts: np.ndarray, seed: int = 17) -> np.ndarray:
    return gathered(texts.buffer, starts, [*range(0, WIDTH - 8, 8), WIDTH - 8], seed)
