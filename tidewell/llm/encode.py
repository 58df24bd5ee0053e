"""Encoding a whole corpus with a public byte-level BPE vocabulary (problem 7).

A text is cut by the vocabulary's pattern, and each distinct piece is encoded by dynamic programming over its
prefixes: an automaton over all tokens lists, for every prefix, the tokens that are a suffix of it, longest first;
the first of them that may stand behind the last token of the prefix before it is the *unique* last token of any
valid encoding of this prefix. Following these back-pointers from the end gives exactly the ids that repeated
merging gives, in time linear in the piece. Two tokens may stand side by side if no merge would have crossed
their border: both are unmerged step by step, latest merge first, and the border pair is looked up at each step.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern that cuts a text before merging, as the vocabulary's description gives it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one token in base64 and its id per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder:
    """Encodes pieces of text; ``remember`` bounds how many distinct pieces are kept with their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remember: int = 400_000):
        self.ranks, self.remember = ranks, remember
        self.cut = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.known: dict[str, array] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        # A token's last merge is the encoding of its bytes by the tokens before it: two halves.
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                self.halves[rank] = pair = self._halves(token, rank)
                self.merged[pair] = rank
        self.fits.clear()  # while merges were missing, a pair could seem to fit

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        for cut in range(1, len(token)):
            a, b = self.ranks.get(token[:cut], _NEVER), self.ranks.get(token[cut:], _NEVER)
            if a < rank and b < rank and self._compatible(a, b):
                return a, b
        raise ValueError(f"token {rank} is not made of two earlier ones")

    def _compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border between tokens a and b when their bytes are encoded together."""
        made_a = made_b = _NEVER  # when a, b become part of something longer
        while True:
            crossing = self.merged.get((a, b), _NEVER)
            if crossing < made_a and crossing <= made_b and crossing != _NEVER:
                return False
            over_a, over_b = self.halves.get(a), self.halves.get(b)
            if over_a is None and over_b is None:
                return True
            if over_b is None or (over_a is not None and a > b):
                made_a, a = a, over_a[1]
            else:
                made_b, b = b, over_b[0]

    def piece(self, text: str) -> array:
        """The ids of one piece."""
        data = text.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return array("i", (whole,))
        last, size = [-1] * (len(data) + 1), [0] * (len(data) + 1)
        fits = self.fits
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            end += 1
            if last[end] >= 0:
                continue
            if length < end:
                pair = (last[end - length], rank)
                ok = fits.get(pair)
                if ok is None:
                    if len(fits) > self.remember:
                        fits.clear()
                    ok = fits[pair] = self._compatible(*pair)
                if not ok:
                    continue
            last[end], size[end] = rank, length
        ids, at = array("i"), len(data)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def encode(self, text: str, into: array) -> None:
        """Appends the ids of a text."""
        known = self.known
        for part in self.cut(text):
            ids = known.get(part)
            if ids is None:
                if len(known) > self.remember:
                    known.clear()
                ids = self.piece(part)
                if len(part) < 64:
                    known[part] = ids
            into.extend(ids)


_ENCODERS: dict[int, PrefixEncoder] = {}


def encode_corpus(documents: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row, without special tokens; their strings count as ordinary text.

    ``vocabulary`` is the path of a rank file, read on the driver and broadcast (its size does not depend on the
    corpus). An empty or null text gives an empty list. Repeated rows are encoded each. No rows are moved between
    tasks; each worker keeps the ids of a bounded number of distinct pieces.
    """
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(len(ranks.value))
        if encoder is None or encoder.ranks is not ranks.value:
            encoder = _ENCODERS[len(ranks.value)] = PrefixEncoder(ranks.value)
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                ids, ends = array("i"), array("i", (0,))
                for value in batch.column("text").to_pylist():
                    if value:
                        encoder.encode(value, ids)
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(ids), pa.int32()) if len(ids) else pa.array([], pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "ids"])

    return documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, "doc_id bigint, ids array<int>")
