"""Long exact spans shared between records (problem 9), by difference-cover anchors.

A difference cover D modulo p has, for every shift, two members that differ by it. If two texts agree over at
least ``length`` characters, then whatever their offset, one of the first p places of the common run has a
residue in D in both texts. Hashing the windows of ``length - p + 1`` characters that start at places with a
residue in D (about 1 in sqrt(p)) therefore meets every common run at an anchor that both texts share. Around
the shared anchors only, the run is extended: every full window of ``length`` characters that holds such an anchor is
looked up among the other texts' windows, so each anchor grows exactly as far as some other record agrees.

Work is shared out by hash values, never by pairs of records: a passage that a third of the records repeat costs
one row per record and window. Such a passage is no hot key either: of the records that meet in one chunk of a task
only two go to the hash's own bucket, as witnesses for the other tasks; the rest are known to share it and are spread
over the buckets of their ids. Records with equal texts are one text here and are settled at once (all of such a text
is shared). The number of buckets follows from the counted characters, a bucket is a partition, and rows travel packed
by chunk and bucket, so a task holds some two million characters' worth of hashes at any size of the corpus.

Anchors only screen. Windows are told apart by two polynomials modulo different primes below 2**32: two windows of n
characters that differ, however they are built, agree in both for at most n * n of the some 2**64 choices of bases.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.shared import buckets

#: The base of the anchors' hash modulo 2**64, and prime moduli with bases of those of the windows.
_BASE, _PRIMES = 6364136223846793005, ((4294967291, 2654435769), (4294967279, 3266489917))
_CHUNK, _BUCKET_CHARS = 1 << 20, 1 << 21


def difference_cover(q: int) -> list[int]:
    """q + 1 residues modulo p = q*q + q + 1 (q a prime) whose differences are all residues.

    The zeros of a linear recurrence of order three over the field of q elements, if its period is the largest.
    """
    p = q * q + q + 1
    for a in range(q):
        for b in range(q):
            for c in range(1, q):
                x, y, z, zeros = 0, 0, 1, []
                for at in range(p):
                    if x == 0:
                        zeros.append(at)
                    x, y, z = y, z, (a * z + b * y + c * x) % q
                if len(zeros) == q + 1 and len({(u - v) % p for u in zeros for v in zeros}) == p:
                    return zeros
    raise ValueError(f"no cover found for {q}")


@cache
def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The period and residues used for runs of ``length`` characters: the largest period of at most half of it."""
    primes = [q for q in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47) if q * q + q + 1 <= max(length // 2, 1)]
    if not primes:
        return 1, (0,)
    q = primes[-1]
    return q * q + q + 1, tuple(difference_cover(q))


@cache
def _powers(base: int, modulus: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k for k < n; modulus 2**64 is that of the numbers themselves."""
    out = []
    for b in (base, pow(base, -1, modulus)):
        held = np.ones(1, np.uint64)
        while len(held) < n:
            more = held * np.uint64(pow(b, len(held), modulus))
            held = np.concatenate([held, more if modulus == 1 << 64 else more % np.uint64(modulus)])
        out.append(held[:n])
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Texts:
    """Some texts in one array of code points, with hashes of any window."""

    def __init__(self, texts: list[str]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        """Quick hash of the ``width`` characters from each place in ``at`` on."""
        up, down = _powers(_BASE, 1 << 64, self._size())
        sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum((self.codes.astype(np.uint64) + np.uint64(0x9E3779B9)) * up[: len(self.codes)], out=sums[1:])
        return _mixed((sums[at + width] - sums[at]) * down[at])

    def window_hashes(self, at: np.ndarray, width: int) -> np.ndarray:
        """The residues of the window's two polynomials, one in each half."""
        out = np.zeros(len(at), np.uint64)
        for prime, base in _PRIMES:
            up, down = _powers(base, prime, self._size())
            p, sums = np.uint64(prime), np.zeros(len(self.codes) + 1, np.uint64)
            np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * up[: len(self.codes)] % p, out=sums[1:])  # far below 2**64
            out = out << np.uint64(32) | (sums[at + width] - sums[at]) % p * down[at] % p
        return out

    def _size(self) -> int:
        return 1 << max(10, int(len(self.codes) + 1).bit_length())

    def anchors(self, width: int, period: int, residues: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Which text, and place in the joined texts, of every window of ``width`` at a cover position."""
        chosen = np.zeros(period, bool)
        chosen[list(residues)] = True
        which = np.repeat(np.arange(len(self.lengths)), self.lengths)
        local = np.arange(len(self.codes)) - self.starts[which]
        at = np.flatnonzero(chosen[local % period] & (local + width <= self.lengths[which]))
        return which[at], at


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Row ranges of about _CHUNK characters."""
    sizes, first, held = pa.compute.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False), 0, 0
    for n, size in enumerate(sizes):
        held += int(size)
        if held >= _CHUNK:
            yield first, n + 1
            first, held = n + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _short(hashes: np.ndarray) -> np.ndarray:
    """The upper half of each hash; the bucket is taken from all of it, so buckets and halves are independent."""
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _met_here(owners: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which rows share their hash with other records of the chunk, but for two witnesses a hash (its least and its greatest record)."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.argsort(hashes, kind="stable")
    held, of = hashes[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    sizes = np.diff(np.append(first, len(held)))
    least, most = np.repeat(np.minimum.reduceat(of, first), sizes), np.repeat(np.maximum.reduceat(of, first), sizes)
    met = np.zeros(len(hashes), bool)
    met[order] = (of != least) & (of != most)
    return met


def _grouped(key: np.ndarray, **columns: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The different keys, and the columns as one list per key; order within a key stays."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(key)).astype(np.int32))
    return key[first], {name: pa.ListArray.from_arrays(offsets, pa.array(x[order])) for name, x in columns.items()}


def _by_id(ids: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(parts)).astype(np.int64)


def _packed(ids: np.ndarray, which: np.ndarray, by: np.ndarray, parts: int, **columns: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, met, docs and the columns) of hashes, one for each bucket."""
    owners = ids[which]
    met = _met_here(owners, by)
    bucket = np.where(met, _by_id(owners, parts), (_mixed(by) % np.uint64(parts)).astype(np.int64))
    key, lists = _grouped(bucket * 2 + met, docs=owners, **columns)
    return pa.RecordBatch.from_pydict({"bucket": pa.array((key // 2).astype(np.int32)), "met": pa.array(key % 2 == 1), **lists})


def _held(batches: Iterator[pa.RecordBatch], *columns: str) -> list[np.ndarray]:
    """The unpacked columns of all rows of a bucket; ``met`` is repeated for each element."""
    rows = [b for b in batches if b.num_rows]
    out = []
    for name in columns:
        if name == "met":
            parts = [np.repeat(b["met"].to_numpy(zero_copy_only=False), pa.compute.list_value_length(b["docs"]).to_numpy(zero_copy_only=False)) for b in rows]
        else:
            parts = [b[name].flatten().to_numpy() for b in rows]
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return out


def _shared(docs: np.ndarray, met: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which rows hold a hash that occurs under more than one doc_id."""
    order = np.argsort(hashes, kind="stable")
    held, of = hashes[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    sizes = np.diff(np.append(first, len(held)))
    out = np.zeros(len(hashes), bool)
    out[order] = np.repeat(np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first), sizes)
    return out | met.astype(bool)


def shared_spans(documents: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each record with a run of at least ``length`` characters that another record has too, how much is shared.

    Returns doc_id and shared_chars, the number of the text's characters (code points, compared exactly) that lie
    in such a run. Rows with a null id or text, and texts shorter than ``length``, have none. Rows that repeat a
    doc_id with the same text count once. The positions of one record are the largest group that is ever collected.
    """
    period, residues = cover_for(length)
    width = length - period + 1
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(f"doc_id is not null and length(text) >= {length}")
    parts = max(buckets(documents.sparkSession), -(-(docs.agg(F.sum(F.length("text"))).first()[0] or 0) // _BUCKET_CHARS))

    # Records with equal texts: all of the text is shared; the least id stands for them below.
    keys = docs.select("doc_id", F.md5("text").alias("key"), F.length("text").alias("chars"))
    alike = keys.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least <> most")
    copies = keys.join(alike, "key").select("doc_id", "chars", (F.col("doc_id") == F.col("least")).alias("stands")).distinct()
    single = docs.join(copies.where("not stands").select("doc_id"), "doc_id", "left_anti")

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, end in _chunks(batch):
                texts = Texts(batch.column("text")[first:end].to_pylist())
                which, at = texts.anchors(width, period, residues)
                hashes = texts.hashes(at, width)
                yield _packed(ids[first:end], which, hashes, parts, hashes=_short(hashes))

    def met_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, met, hashes = _held(batches, "docs", "met", "hashes")
        if len(of):
            hit = _shared(of, met, hashes)
            key, lists = _grouped(of[hit], hashes=hashes[hit])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(key), **lists})

    anchors = single.mapInArrow(anchor_rows, "bucket int, met boolean, docs array<bigint>, hashes array<int>").repartitionById(parts, "bucket")
    met = anchors.mapInArrow(met_anchors, "doc_id bigint, hashes array<int>").groupBy("doc_id").agg(F.flatten(F.collect_list("hashes")).alias("met"))

    def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, end in _chunks(batch):
                texts = Texts(batch.column("text")[first:end].to_pylist())
                which, at = texts.anchors(width, period, residues)
                found = _short(texts.hashes(at, width))
                lists = batch.column("met")[first:end]
                owner = np.repeat(np.arange(end - first), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))
                # A hash met by one text of the chunk may occur in another, which then has met it too or holds no match.
                hit = np.isin(found, lists.flatten().to_numpy()) if len(owner) else np.zeros(len(found), bool)
                which, at = which[hit], at[hit]
                near = np.zeros(len(texts.codes) + 2, np.int32)
                np.add.at(near, np.maximum(at - period + 1, texts.starts[which]), 1)
                np.add.at(near, at + 1, -1)
                starts = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                of = np.searchsorted(texts.starts, starts, side="right") - 1
                local = starts - texts.starts[of]
                fits = local + length <= texts.lengths[of]
                starts, of, local = starts[fits], of[fits], local[fits]
                hashes = texts.window_hashes(starts, length)
                yield _packed(ids[first:end], of, hashes, parts, hashes=hashes.view(np.int64), places=local.astype(np.int32))

    def met_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, met, hashes, places = _held(batches, "docs", "met", "hashes", "places")
        if len(of):
            hit = _shared(of, met, hashes)
            of, places = of[hit], places[hit]
            key, lists = _grouped(_by_id(of, parts), docs=of, places=places)
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(key.astype(np.int32)), **lists})

    def covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, places = _held(batches, "docs", "places")
        if len(of):
            order = np.lexsort((places, of))
            of, places = of[order], places[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            gaps = np.minimum(np.diff(places, prepend=0), length)
            gaps[first] = length
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(of[first]), "shared_chars": pa.array(np.add.reduceat(gaps, first))})

    candidates = docs.join(met, "doc_id").select("doc_id", "text", "met")
    windows = candidates.mapInArrow(window_rows, "bucket int, met boolean, docs array<bigint>, hashes array<bigint>, places array<int>").repartitionById(parts, "bucket")
    starts = windows.mapInArrow(met_windows, "bucket int, docs array<bigint>, places array<int>").repartitionById(parts, "bucket")
    spans = starts.mapInArrow(covered, "doc_id bigint, shared_chars bigint")
    whole = copies.select("doc_id", F.col("chars").cast("bigint").alias("shared_chars"))
    return spans.unionByName(whole).groupBy("doc_id").agg(F.max("shared_chars").alias("shared_chars"))
