"""Whole texts to token ids with a public byte-level BPE tokenizer, fast on repeating words.

A byte-level tokenizer cuts a text into pre-tokens before it merges. Some of these cuts
can be told from the bytes alone: before a single blank or line end between two other
characters, after such a line end, and between a Latin letter and a comma or full stop.
Texts are cut there into chunks; each distinct chunk is encoded once, with all that
stands between two such cuts left to the tokenizer, and the ids are put together by
numpy. Ids are the same as those of whole texts.

Chunks are remembered for one task and in bounded memory: all are forgotten when there
are more than ``CACHED``. A slice of texts and its chunks are held at a time; one text
longer than a slice is held whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tripgrid.llm.flat import coded, ends_of, flat, slices

CACHED = 400_000
# Chunks that are one pre-token each: one Latin word, comma, full stop or line end.
PLAIN = r"^ ?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$|^[,.\n]$"


@lru_cache(maxsize=1)
def load(path: str):
    """The tokenizer of a file, read once in a Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if any(re.search(r"[\s,.]", special) for special in specials(tokenizer)):
        raise ValueError("special tokens that hold white space, commas or full stops are not supported")
    return tokenizer


def _byte_names() -> dict[int, str]:
    """How byte-level vocabularies print each byte: as itself where it is visible, else from 256 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b != 0xAD]
    others = sorted(set(range(256)) - set(visible))
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_NAMES = _byte_names()


def merged(tokenizer, pretoken: str) -> list[int]:
    """The ids of one pre-token, straight from the merges."""
    if pretoken.isascii() and pretoken[1:].isalpha() and pretoken[0] == " ":
        named = _BYTE_NAMES[0x20] + pretoken[1:]
    else:
        named = pretoken.encode().decode("latin-1").translate(_BYTE_NAMES)
    return [t.id for t in tokenizer.model.tokenize(named)]


def specials(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def _class(*spans: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in spans:
        out[a : b + 1] = True
    return out


# ASCII characters that are no blank in any engine, and first bytes of characters of
# which none is: blanks beyond ASCII begin with C2, E1, E2, E3 or EF.
_SOLID = _class((0x00, 0x08), (0x0E, 0x1B), (0x21, 0x7F), (0xC3, 0xE0), (0xE4, 0xEE), (0xF0, 0xF4))
_LATER = _class((0x80, 0xBF))
_LETTER = _class((0x41, 0x5A), (0x61, 0x7A))
_STOP = _class((0x2C, 0x2C), (0x2E, 0x2E))


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending byte positions where chunks begin, the start of every text that is not empty among them."""
    n = len(data)
    solid, later = _SOLID[data], _LATER[data]
    if later.any():
        for _ in range(3):
            solid[1:] |= later[1:] & solid[:-1]
    line = data == 0x0A
    at = np.zeros(n + 1, bool)
    # Both neighbours of a single blank or line end are solid.
    at[1 : n - 1] = ((data == 0x20) | line)[1:-1] & solid[:-2] & solid[2:]
    at[1:n] |= at[: n - 1] & line[:-1]
    letter = _LETTER[data]
    # E0..FF after C3, without the signs for times and division: letters of two bytes.
    letter[1:] |= (data[:-1] == 0xC3) & later[1:] & (data[1:] != 0x97) & (data[1:] != 0xB7)
    at[1:n] |= _STOP[data][1:] & letter[:-1]
    at[starts] = True
    return np.flatnonzero(at[:n])


def chunks(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Code of each chunk, the distinct chunks, and where each text's chunks begin and the last one's end."""
    data, starts = flat(texts)
    begin = cuts(data, starts) if len(data) else np.zeros(0, np.int64)
    code, names = coded(data, np.append(begin, len(data)))
    return code, names, np.searchsorted(begin, starts)


class Encoder:
    """Encodes arrays of texts for one task; remembers the ids of chunks in bounded memory."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _ids(self, names: pa.Array) -> list[list[int]]:
        """The ids of each chunk."""
        plain = pc.match_substring_regex(names, PLAIN).to_pylist()
        texts = names.to_pylist()
        others = iter(self.tokenizer.encode_batch_fast([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        return [merged(self.tokenizer, t) if p else next(others).ids for t, p in zip(texts, plain, strict=True)]

    def _learn(self, names: pa.Array) -> np.ndarray:
        """Where the ids of each distinct chunk stand in ``ids``, by number."""
        if len(self.known) > CACHED:
            self._forget()
        texts = names.to_pylist()
        number = np.fromiter(map(self.known.get, texts, repeat(-1)), np.int64, len(texts))
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = len(self.known) + np.arange(len(new))
            found = self._ids(names.take(pa.array(new)))
            self.known.update(zip((texts[i] for i in new), number[new].tolist(), strict=True))
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return number

    def _slice(self, texts: pa.Array) -> list[np.ndarray]:
        code, names, first = chunks(texts)
        number = self._learn(names)[code]
        size = self.ends[number + 1] - self.ends[number]
        after = ends_of(size)
        ids = self.ids[np.repeat(self.ends[number] - after[:-1], size) + np.arange(after[-1])]
        return np.split(ids, after[first[1:-1]])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text without nulls, one array after the other."""
        for _, part in slices(texts):
            yield from self._slice(part)
