"""Words of texts as arrays: where they are and what they hash to, without a loop per word."""

from collections.abc import Iterator

import numpy as np

PLACES = 256
SEED = 7


class WordHasher:
    """Hashes words as sums of random numbers, one per byte value and place in the word.

    ``alphabet`` says for every byte what stands for it in a word; 0 marks a byte between words.
    """

    def __init__(self, alphabet: np.ndarray):
        numbers = np.random.default_rng(SEED).integers(0, 2**63, (PLACES, 256), dtype=np.uint64)
        self.alphabet = alphabet.astype(np.uint8)
        self.numbers = numbers.ravel()

    def words(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, lengths and hashes of the words in an array of bytes."""
        folded = self.alphabet[raw]
        inside = np.concatenate([[False], folded != 0, [False]])
        change = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = change[::2], change[1::2]
        if not len(begins):
            return begins, begins, np.zeros(0, np.uint64)
        lengths = ends - begins
        taken = folded[inside[1:-1]].astype(np.int64)
        first = np.cumsum(lengths) - lengths
        place = (np.arange(len(taken)) - np.repeat(first, lengths)) % PLACES
        hashes = np.add.reduceat(self.numbers[place * 256 + taken], first)
        return begins, lengths, hashes


def lower_ascii() -> np.ndarray:
    table = np.arange(256)
    table[65:91] += 32
    return table


def letters() -> np.ndarray:
    """Letters, digits and bytes above ASCII in lower case; all else lies between words."""
    table = lower_ascii()
    kept = np.zeros(256, bool)
    kept[48:58] = kept[65:91] = kept[97:123] = kept[128:] = True
    return np.where(kept, table, 0)


def visible() -> np.ndarray:
    """All bytes but white space, as they are."""
    table = np.arange(256)
    table[[0, 9, 10, 11, 12, 13, 32]] = 0
    return table


def raw_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def joined(texts: list[str], limit: int = 1 << 20) -> Iterator[tuple]:
    """Texts as arrays of some ``limit`` bytes with white space between them: the bytes, where each
    piece begins, and the number of its text. A text longer than the limit is cut at white space
    into several pieces."""
    held, owners, size = [], [], 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, held), np.int64, len(held)) + 1
        raw = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        return raw, np.cumsum(lengths) - lengths, np.array(owners, np.int64)

    for number, text in enumerate(texts):
        rest = text.encode("utf-8", "surrogatepass")
        while True:
            cut = len(rest)
            if cut > limit:
                cut = max(rest.rfind(b" ", 0, limit), rest.rfind(b"\n", 0, limit))
                cut = cut if cut > 0 else limit
            piece, rest = rest[:cut], rest[cut:]
            held.append(piece)
            owners.append(number)
            size += len(piece)
            if size >= limit:
                yield out()
                held, owners, size = [], [], 0
            if not rest:
                break
    if held:
        yield out()
