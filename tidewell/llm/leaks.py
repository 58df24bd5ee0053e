"""Evaluation texts that leak into training text (problem 8), by pigeonhole edit matching.

Each passage of ``words`` consecutive words of a test item, with the blanks around it, is split into ``errors + 1``
pieces without overlap. If a document holds the passage with at most ``errors`` edited characters, at least one piece
is untouched. One automaton over
all pieces of the test items runs over each normalised document; around each piece that it hits, the rest of the
passage is compared by Myers' bit-parallel edit distance. Exact matches are those of distance 0.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARKS = regex.compile(r"\p{M}+")
_GAPS = re.compile(r"[\W_]+")


def normalised(text: str) -> str:
    """The words of a text (runs of letters and digits) without case and diacritics, each between two blanks."""
    text = text.casefold()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text))
    return f" {_GAPS.sub(' ', text).strip()} "


def myers_distance(pattern: str, text: str, most: int, anchored_end: bool) -> int:
    """Least edit distance of ``pattern`` to a prefix of ``text`` (to a suffix if ``anchored_end``), or ``most + 1``.

    Myers' bit-vectors in one integer: a column of the distance table per character of ``text``.
    """
    if anchored_end:
        pattern, text = pattern[::-1], text[::-1]
    size = len(pattern)
    if not size:
        return 0
    masks: dict[str, int] = {}
    for n, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << n
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, best = full, 0, size, size
    for c in text[: size + most]:
        equal = masks.get(c, 0)
        across = (((equal & plus) + plus) ^ plus) | equal | minus
        h_plus = minus | ~(across | plus) & full
        h_minus = plus & across
        score += bool(h_plus & top) - bool(h_minus & top)
        h_plus = (h_plus << 1 | 1) & full  # the text's start is fixed: the upper border rises by one
        h_minus = (h_minus << 1) & full
        vertical = equal | minus
        plus = h_minus | ~(vertical | h_plus) & full
        minus = h_plus & vertical
        best = min(best, score)
    return best if best <= most else most + 1


class PassageIndex:
    """The pieces of the passages of some items, ready to be looked for in documents."""

    def __init__(self, items: list[tuple[int, str]], words: int, errors: int):
        self.errors = errors
        edges = [words * k // (errors + 1) for k in range(errors + 2)]
        # piece -> {(text before it, text after it) within a passage: items}
        self.pieces: dict[str, dict[tuple[str, str], set[int]]] = {}
        for item, text in items:
            tokens = text.split()
            for at in range(len(tokens) - words + 1):
                passage = f" {' '.join(tokens[at : at + words])} "
                # A blank between two pieces belongs to the first one only.
                starts = [0, *(len(" ".join(tokens[at : at + n])) + 2 for n in edges[1:-1]), len(passage)]
                if words <= errors:
                    starts = [len(passage) * k // (errors + 1) for k in range(errors + 2)]
                for a, b in zip(starts, starts[1:], strict=False):
                    self.pieces.setdefault(passage[a:b], {}).setdefault((passage[:a], passage[b:]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for piece in self.pieces:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def _distance(self, left: str, right: str, before: str, after: str) -> int:
        """Edits around an untouched piece, of the parts of the passage before and after it; blanks count as characters."""
        most = self.errors
        total = 0
        for want, text, at_end in ((left, before, True), (right, after, False)):
            if want:
                exact = text.endswith(want) if at_end else text.startswith(want)
                if not exact:
                    # The pigeonhole once more: with the edits left, some part of `want` is untouched in the text.
                    left_over = most - total
                    cuts = [len(want) * k // (left_over + 1) for k in range(left_over + 2)]
                    if not left_over or not any(want[a:b] in text for a, b in zip(cuts, cuts[1:], strict=False)):
                        return most + 1
                    total += myers_distance(want, text, most - total, at_end)
                    if total > most:
                        return most + 1
        return total

    def found(self, text: str) -> dict[int, int]:
        """The items of which the normalised text holds a passage, with the least number of edits."""
        out: dict[int, int] = {}
        if not self.pieces:
            return out
        for end, piece in self.automaton.iter(text):
            first, after_at = end + 1 - len(piece), end + 1
            for (left, right), items in self.pieces[piece].items():
                if all(out.get(i) == 0 for i in items):
                    continue
                reach = max(len(left), len(right)) + self.errors
                before, after = text[max(0, first - reach) : first], text[after_at : after_at + reach]
                distance = self._distance(left, right, before, after)
                if distance <= self.errors:
                    for i in items:
                        out[i] = min(distance, out.get(i, distance))
        return out


_INDEXES: dict[int, PassageIndex] = {}


def leaked_passages(documents: DataFrame, items: DataFrame, words: int = 12, errors: int = 1, block_chars: int = 400_000) -> DataFrame:
    """Which documents hold at least ``words`` consecutive words of which test items, up to ``errors`` edits.

    ``documents``: doc_id, text; ``items``: item_id, text. Returns doc_id, item_id and edits (the least number of
    edited characters in any passage; 0 means the words are equal), one row per pair. Words are runs of letters and
    digits, compared without case and diacritics. Null, empty and short texts match nothing; repeated rows do not
    repeat results. The test set is a stated query set: it is broadcast in blocks of at most ``block_chars``
    characters, so the memory for it is bounded however large it is; each block is one pass over the documents.
    """
    spark = documents.sparkSession
    texts = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = texts.select(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (block_chars // 2)) if chars > block_chars else 1)
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    out = None
    for block in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([(r.item_id, normalised(r.text)) for r in part.toLocalIterator()])

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _INDEXES.get(id(held.value))
            if index is None or index.source is not held.value:
                _INDEXES.clear()
                index = _INDEXES[id(held.value)] = PassageIndex(held.value, words, errors)
                index.source = held.value
            for batch in batches:
                rows: list[tuple[int, int, int]] = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                    rows += [(doc, item, edits) for item, edits in index.found(normalised(text.as_py())).items()]
                columns = list(zip(*rows, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], names=["doc_id", "item_id", "edits"])

        found = docs.mapInArrow(search, "doc_id bigint, item_id bigint, edits int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
