"""Cutting a text into units that a byte-level tokenizer encodes independently, so that units can be cached.

The tokenizers' pattern lets at most one space lead a word, and a run of white space is a match of its own up to the
space that leads the next word. So a text can be cut before any space that has something other than white space on
either side, and around any line end between two such characters; the matches of the whole text are the units'
matches, one after another. Where white space follows white space the text is cut before spaces only, and not inside
the run.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RUN = re.compile(r"\s\s")


def units(text: str) -> list[str]:
    """The units of a text; joined they are the text."""
    if not _RUN.search(text):
        lines = [[line[0], *[" " + x for x in line[1:]]] for line in (x.split(" ") for x in text.split("\n"))]
        return [x for k, line in enumerate(lines) for x in (["\n", *line] if k else line) if x]
    pieces = text.split(" ")
    out: list[str] = []
    held, open_run = pieces[0], pieces[0][-1:].isspace()  # open_run: what is held ends in white space
    for piece in pieces[1:]:
        if (not held or open_run) and (not piece or piece[0].isspace()):
            held += " " + piece  # white space, or the beginning, on both sides
        else:
            out.append(held)
            held = " " + piece
        open_run = held[-1].isspace()
    out.append(held)
    return [x for x in out if x]


#: Longer units, whole lines in a script without spaces say, are encoded anew each time.
LONGEST = 64
ENTRY = 220  # bytes that an entry of a table costs beside its characters
TOGETHER = 1 << 18  # characters of texts that are looked up together
KEYS = 20_000  # units looked up at a time, so that one long text can't fill a table far beyond its bound


class UnitCache:
    """What encode() makes of units, for texts at a time; the joined results of a text's units are the text's result.

    Units are kept with their leading space cut off in one table and as they are in another. A table that is full
    becomes the old one, from which units that are met again are taken over, and the old one before it is forgotten.
    All four together hold no more than most_bytes and what one lookup adds; forget() empties them.
    encode_row gets units that each are one space and then something that neither begins nor ends with white space;
    put in a row, such units still encode independently.
    """

    def __init__(self, encode: Callable[[list[str]], list], encode_row: Callable[[list[str]], list] | None = None, most_bytes: int = 64 << 20):
        self.bare, self.spaced = _Table(encode, "", most_bytes // 8), _Table(encode_row or encode, " ", 3 * most_bytes // 8)

    def parts(self, text: str) -> list:
        return next(self._some([text]))

    def many(self, texts: Iterable[str]) -> Iterator[list]:
        """parts() of each text; short texts are looked up together, which costs less."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._some(held)
                held, size = [], 0
        if held:
            yield from self._some(held)

    def _some(self, texts: list[str]) -> Iterator[list]:
        split = [None if _RUN.search(text) else [x.split(" ") for x in text.split("\n")] for text in texts]
        firsts = iter(self.bare.get([line[0] for lines in split if lines for line in lines]))
        rest, at, end = self.spaced.get([x for lines in split if lines for line in lines for x in line[1:]]), 0, self.bare.get(["\n"])
        for text, lines in zip(texts, split, strict=True):
            if lines is None:
                yield self.bare.get(units(text))
                continue
            out: list = []
            for k, line in enumerate(lines):
                if k:
                    out += end
                first = next(firsts)
                if line[0]:
                    out.append(first)
                out += rest[at : at + len(line) - 1]
                at += len(line) - 1
            yield out

    def forget(self) -> None:
        self.bare.forget()
        self.spaced.forget()


class _Table:
    """Two generations of at most full bytes each."""

    def __init__(self, encode: Callable[[list[str]], list], lead: str, full: int):
        self.encode, self.lead, self.full = encode, lead, full
        self.forget()

    def forget(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def get(self, keys: list[str]) -> list:
        if len(keys) > KEYS:
            return [v for k in range(0, len(keys), KEYS) for v in self.get(keys[k : k + KEYS])]
        if self.held > self.full:
            self.old, self.young, self.held = self.young, {}, 0
        young, old, held = self.young, self.old, self.held
        got = list(map(young.get, keys))
        if None in got:
            at = [i for i, v in enumerate(got) if v is None]
            new = {}
            for i in at:
                k = keys[i]
                v = old.get(k)
                if v is None:
                    new[k] = None
                else:
                    got[i] = young[k] = v
                    held += ENTRY + len(k) + len(v)
            if new:
                made = dict(zip(new, self.encode([self.lead + k for k in new]), strict=True))
                for k, v in made.items():
                    if len(k) <= LONGEST:
                        young[k] = v
                        held += ENTRY + len(k) + len(v)
                for i in at:
                    if got[i] is None:
                        got[i] = made[keys[i]]
            self.held = held
        return got


#: Any two characters of white space, for Arrow's expressions, whose own class knows ASCII only.
RUN = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]{2}"


def flat(cache: UnitCache, texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, none null, one after another, and how many each has; the cache's results are ids as bytes.

    The units of all texts are told apart in Arrow and each different one is looked up once; texts in which white space
    follows white space are cut one by one.
    """
    slow = pc.match_substring_regex(texts, RUN).to_numpy(zero_copy_only=False)
    if not slow.any():
        return _flat(cache, texts, kind)
    ids, counts = _flat(cache, texts.filter(pa.array(~slow)), kind)
    n = np.zeros(len(texts), np.int64)
    n[~slow] = counts
    own = [np.frombuffer(b"".join(cache.bare.get(units(text))), kind) for text in texts.filter(pa.array(slow)).to_pylist()]
    n[slow] = [len(x) for x in own]
    cut = np.append(0, np.cumsum(np.where(slow, 0, n)))[np.flatnonzero(slow)]
    parts, last = [], 0
    for at, x in zip(cut.tolist(), own, strict=True):
        parts += [ids[last:at], x]
        last = at
    return np.concatenate([*parts, ids[last:]]), n


def _flat(cache: UnitCache, texts: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    lists = pc.split_pattern(texts, "\n")
    lines = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    text_of = np.repeat(np.arange(len(texts), dtype=np.int32), lines)  # of a line
    words = pc.split_pattern(lists.flatten(), " ")
    each = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    begins = np.cumsum(each) - each  # the first word of each line
    word = words.flatten()
    is_first = np.zeros(len(word), bool)
    is_first[begins] = True
    firsts, rest = (word.filter(pa.array(m)).dictionary_encode() for m in (is_first, ~is_first))
    del words, word, lists
    bare, spaced = firsts.dictionary.to_pylist(), rest.dictionary.to_pylist()
    held = [*cache.bare.get(["\n", *bare]), *cache.spaced.get(spaced)]
    held = [b"" if k and k <= len(bare) and not bare[k - 1] else v for k, v in enumerate(held)]  # a line that begins with its space, or is empty
    unit = np.empty(len(is_first), np.int32)
    unit[is_first] = firsts.indices.to_numpy() + 1
    unit[~is_first] = rest.indices.to_numpy() + (1 + len(bare))
    further = np.flatnonzero(text_of[1:] == text_of[:-1]) + 1 if len(text_of) else np.zeros(0, np.int64)  # lines after a line end
    unit = np.insert(unit, begins[further], 0)
    all_ids = np.frombuffer(b"".join(held), kind)
    n = np.fromiter(map(len, held), np.int32, len(held)) // int(kind[-1])
    start = np.cumsum(n, dtype=np.int32) - n
    own = n[unit]
    ends = np.cumsum(own, dtype=np.int64)
    wide = np.int64 if len(ends) and ends[-1] >= 1 << 31 else np.int32
    at = np.arange(int(ends[-1]) if len(ends) else 0, dtype=wide)
    at += np.repeat((start[unit] - (ends - own)).astype(wide), own)
    # A text has its lines' words and a line end between two lines.
    units_of = np.add.reduceat(each, np.append(0, np.cumsum(lines)[:-1])) + lines - 1 if len(lines) else np.zeros(0, np.int64)
    upto = np.append(0, ends)[np.append(0, np.cumsum(units_of))]
    return all_ids[at], np.diff(upto)
