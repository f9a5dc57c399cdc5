"""Byte-level BPE by dynamic programming over prefixes.

Of all ways to end a byte prefix with a token, exactly one is the last token of the prefix's own encoding: the token
that is valid beside the last token of what stands before it. Two neighbouring tokens are valid if the merges, applied
to their bytes alone, give these two again; a sequence is an encoding if and only if all its neighbours are valid. So
one token for each prefix stores the encodings of all prefixes. A piece then grows by appending, at a cost that only
depends on what is appended, and after an edit only the prefixes up to where the old and new tables agree again, over
the length of the longest token, are done anew.

Documents are split into the pattern's matches, each of which is a piece, as the tiktoken library does. Units of text
(byte_units.py) are remembered within a task, up to CACHED bytes.

Defined results: a null text is empty and has no ids; its digests are those of the empty string; repeated rows count
each; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_units import UnitCache
from .shared import small_batches, table

NONE = -1
LEAF: dict = {}  # shared by all tokens that no longer token ends in
CACHED = 96 << 20  # bytes of units that a worker remembers within a task
PAIRS = 200_000  # pairs of tokens that it remembers, some 20 MB
_open: dict[tuple[str, str], Coder] = {}


class Merges:
    """Ranks, which of their tokens the merges can make, and which neighbours are valid."""

    def __init__(self, ranks: dict[bytes, int], remembered: int = PAIRS):
        self.ranks, self.bytes_of = ranks, {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self.remembered = remembered
        self._made: dict[int, bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        #: Tokens by their bytes from the last to the first: under each byte the token, or NONE, and what goes on before.
        self.ends: dict = {}
        for token, rank in ranks.items():
            node = self.ends
            for k in range(len(token) - 1, -1, -1):
                entry = node.get(token[k])
                if entry is None or entry[1] is LEAF and k:
                    entry = (NONE if entry is None else entry[0], {} if k else LEAF)
                if not k:
                    entry = (rank, entry[1])
                node[token[k]] = entry
                node = entry[1]
        #: Pairs of tokens that have been tried, and whether they are valid neighbours.
        self.known: dict[int, bool] = {}  # left << 32 | right

    def merge(self, piece: bytes, least: int = 1) -> list[bytes]:
        """The parts that the merges leave of a short piece, the lowest rank first, the leftmost of equals; least ends them sooner."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def made(self, token: int) -> bool:
        """Whether the merges make the token from its bytes."""
        made = self._made.get(token)
        if made is None:
            piece = self.bytes_of[token]
            made = self._made[token] = len(piece) == 1 or self.merge(piece) == [piece]
        return made

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token; null for a single byte."""
        if token not in self._split:
            piece = self.bytes_of[token]
            parts = self.merge(piece, 2)
            self._split[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._split[token]

    def valid(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are beside each other, the right one being made; remembered for each pair.

        Their merges are undone from the latest back. They don't stay if at some point what then lies on either side of
        the border would have been merged sooner than the merge that was undone last; of equal ranks the left one counts
        as sooner.
        """
        if len(self.known) > self.remembered:
            self.known.clear()
        a, b, before, bytes_of, ranks = left, right, 1 << 62, self.bytes_of, self.ranks
        valid = True
        while True:
            across = ranks.get(bytes_of[a] + bytes_of[b])
            if across is not None and across < before:
                valid = False
                break
            of_a, of_b = self.split(a), self.split(b)
            if of_a and (a > b or not of_b):
                a, before = of_a[1], a
            elif of_b:
                b, before = of_b[0], b + 1
            else:
                break
        valid = self.known[left << 32 | right] = valid and self.made(right)
        return valid


class Prefixes:
    """A piece of bytes with the last token of each of its prefixes."""

    def __init__(self, merges: Merges, piece: bytes = b""):
        self.merges, self.piece, self.last = merges, b"", []
        self.append(piece)

    def _extend(self, piece: bytes, last: list[int], upto: int) -> None:
        """Adds to last, which holds the last tokens of shorter prefixes, those of the prefixes with up to so many bytes."""
        m = self.merges
        ends, known = m.ends, m.known
        for start in range(len(last), upto):
            node = ends
            while True:
                entry = node.get(piece[start]) if start >= 0 else None
                if entry is None:
                    raise ValueError("no token ends here; the ranks lack single bytes")
                token, node = entry
                if token >= 0:
                    if start:
                        before = last[start - 1]
                        valid = known.get(before << 32 | token)
                        if m.valid(before, token) if valid is None else valid:
                            break
                    elif m.made(token):
                        break
                start -= 1
            last.append(token)

    def append(self, more: bytes) -> None:
        self.piece += more
        self._extend(self.piece, self.last, len(self.piece))

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of piece[start:end]; returns how many prefixes were done anew."""
        piece, old = self.piece[:start] + new + self.piece[end:], self.last
        last, shift, same, n = old[:start], len(new) - (end - start), 0, 0
        for at in range(start + 1, len(piece) + 1):
            self._extend(piece, last, at)
            token = last[-1]
            n += 1
            # Beyond the edit: as many equal tokens as the longest token has bytes, and all that follow are equal.
            same = same + 1 if at - shift > end and old[at - shift - 1] == token else 0
            if same >= self.merges.longest:
                last += old[at - shift :]
                break
        self.piece, self.last = piece, last
        return n

    def encoding(self, end: int | None = None) -> list[int]:
        """The encoding of the first end bytes, all by default."""
        end, out = len(self.piece) if end is None else end, []
        while end:
            out.append(self.last[end - 1])
            end -= len(self.merges.bytes_of[out[-1]])
        return out[::-1]


class Coder:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.merges, self.pattern = Merges(ranks), regex.compile(pattern)
        self.units = UnitCache(lambda new: [",".join(map(str, self._unit(x))) for x in new], most_bytes=CACHED)
        self.bytes_of = {str(k): v for k, v in self.merges.bytes_of.items()}

    def _unit(self, unit: str) -> list[int]:
        out: list[int] = []
        for match in self.pattern.findall(unit):
            piece = match.encode()
            whole = self.merges.ranks.get(piece)  # the library takes a piece that is a token as it is
            out += [whole] if whole is not None else Prefixes(self.merges, piece).encoding()
        return out

    def encode(self, text: str) -> str:
        """Decimal ids, joined by commas."""
        return ",".join(self.units.parts(text)) if text else ""

    def encode_many(self, texts: Iterable[str]) -> Iterator[str]:
        return map(",".join, self.units.many(texts))

    def forget(self) -> None:
        """Gives back what texts have left behind; the ranks stay."""
        self.units.forget()
        self.merges.known.clear()

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))) if ids else b""


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _open:
        with open(path, "rb") as f:
            _open[path, pattern] = Coder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)
    return _open[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, full: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if full, ids (comma-joined) and decoded (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        try:
            for b in batches:
                out: dict[str, list] = {"doc_id": b["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
                if full:
                    out |= {"ids": [], "decoded": []}
                for ids in c.encode_many(b["text"]):
                    decoded = c.decode(ids)
                    out["n_tokens"].append(ids.count(",") + 1 if ids else 0)
                    out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                    if full:
                        out["ids"].append(ids)
                        out["decoded"].append(decoded)
                yield pd.DataFrame(out)
        finally:
            c.forget()  # workers live on after their task

    small_batches(docs.sparkSession)
    # Ids pass through Python as strings: pandas has no exact long with nulls.
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded binary" * full
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
