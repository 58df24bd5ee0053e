"""Upper bounds of the pair score (D1, I7) over squares of events, in numpy; no pair that can reach the least score is lost.

Pairs of characters in common bound the edit similarity and containment, hashed words in common bound Jaccard and key
terms. Both are products of matrices: of the square roots of two counts the product is at least the smaller count, and
collisions only raise it. Where these leave a chance, the longest common subsequence of the titles, and then of the
contents, tightens the bound of the edit similarity: characters that an alignment leaves in place are one. It is worked
out in machine words, for one text and many others at a time. The caller scores what is left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ALPHABET = np.zeros(256, np.uint8)
_ALPHABET[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8)] = np.arange(1, 38)
#: Rows of either side at a time; bits of a text in a machine word, whose last bit takes the carry.
_STRIPE, _BITS = (256, 1024), 63
_ONES = np.uint64((1 << _BITS) - 1)
#: Titles up to this length are compared character by character; pairs with a longer one are left to the caller.
LONGEST = 256


class Texts:
    """What normal texts (I1) are bounded by, one row per text; words are hashed into ``hashes`` buckets."""

    def __init__(self, texts: list[str], hashes: int):
        size = len(texts)
        self.length = np.fromiter(map(len, texts), np.int64, size)
        self.codes = _ALPHABET[np.frombuffer("".join(texts).encode(), np.uint8)]
        self.start = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(size), self.length)
        inner = owner[1:] == owner[:-1]
        kinds = np.minimum(self.codes, 28 - (self.codes < 37)).astype(np.int64)  # all digits as one
        self.twos = _roots(owner[1:][inner], (kinds[:-1] * 29 + kinds[1:])[inner], size, 29 * 29)
        # Words: runs of codes other than 0.
        first = np.flatnonzero((self.codes > 0) & np.r_[True, ~inner | (self.codes[:-1] == 0)][: len(self.codes)])
        last = np.flatnonzero((self.codes > 0) & np.r_[~inner | (self.codes[1:] == 0), True][: len(self.codes)])
        letters = last - first + 1
        place = np.arange(len(self.codes)) - np.repeat(np.r_[0, first], np.diff(np.r_[0, first, len(self.codes)]))
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(place.max(initial=0)) + 1, 0x9E3779B97F4A7C15, np.uint64))
            value = (self.codes.astype(np.uint64) + np.uint64(1)) * powers[place] * (self.codes > 0)
        whole = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
        word = whole[last + 1] - whole[first]
        word ^= word >> np.uint64(31)
        digits = np.r_[0, np.cumsum((self.codes > 26) & (self.codes < 37))]
        others = np.r_[0, np.cumsum(self.codes > 26)]
        term = (letters > 4) | (digits[last + 1] > digits[first]) | ((letters > 1) & (others[last + 1] == others[first]))
        # Each different word of a text once.
        order = np.lexsort((word, owner[first]))
        word, of, letters, term = word[order], owner[first][order], letters[order], term[order]
        new = np.r_[True, (word[1:] != word[:-1]) | (of[1:] != of[:-1])][: len(word)]
        word, of, letters, term = word[new], of[new], letters[new], term[new]
        self.words = _roots(of, (word % np.uint64(hashes)).astype(np.int64), size, hashes)
        self.count, self.long, self.terms = (np.bincount(of, x, minlength=size).astype(np.float32) for x in (np.ones(len(of)), letters > 2, term))

    def columns(self, longest: int | None = None) -> np.ndarray:
        """The codes by place and text, up to ``longest`` of each; 38 after a text's end."""
        most = int(self.length.max(initial=0))
        out = np.full((most if longest is None else min(most, longest), len(self.length)), 38, np.uint8)
        for n, column in enumerate(out):
            rows = np.flatnonzero(self.length > n)
            column[rows] = self.codes[self.start[rows] + n]
        return out


def _roots(owner: np.ndarray, bucket: np.ndarray, size: int, buckets: int, chunk: int = 1000) -> np.ndarray:
    """The square roots of the counts by owner (sorted) and bucket."""
    out = np.zeros((size, buckets), np.float32)
    bounds = np.searchsorted(owner, np.arange(0, size + chunk, chunk))
    for n, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        part = out[n * chunk : (n + 1) * chunk]
        if len(part):
            flat = (owner[low:high] - n * chunk) * buckets + bucket[low:high] % buckets
            np.sqrt(np.bincount(flat, minlength=part.size).reshape(part.shape), out=part, casting="same_kind")
    return out


def common_subsequences(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, chunk: int = 16_384) -> np.ndarray:
    """The length of the longest common subsequence of the texts p of a and q of b (columns of codes), pair by pair.

    The differences within a row of the table are bits (Hyyro): with M the places of the row's character, the next ones
    are V + (V & M) or V - (V & M), and bits that are 0 at the end are common characters.
    """
    size, words = a.shape[1], -(-len(a) // _BITS)
    places = np.zeros((words, size, 39), np.uint64)
    for n, column in enumerate(a):
        places[n // _BITS, np.arange(size), column] |= np.uint64(1 << n % _BITS)
    places[:, :, 38] = 0
    places, out = places.reshape(words, size * 39), np.zeros(len(p), np.int32)
    length_a, length_b = ((x < 38).sum(axis=0) for x in (a, b))
    need = -(-length_a // _BITS)
    order = np.lexsort((length_b[q], need[p]))
    cuts = np.flatnonzero(np.diff(need[p[order]])) + 1
    for group in np.split(order, cuts):
        for low in range(0, len(group), chunk):
            at = group[low : low + chunk]
            to, own, count = q[at], p[at] * 39, int(need[p[at[0]]])
            state = [np.full(len(at), _ONES) for _ in range(count)]
            both, total, carry = (np.empty(len(at), np.uint64) for _ in range(3))
            where = np.empty(len(at), np.int64)
            for column in b[: length_b[to].max()]:
                np.add(own, column[to], out=where)
                for w, v in enumerate(state):
                    np.take(places[w], where, out=both, mode="clip")
                    both &= v
                    np.add(v, both, out=total)
                    if w:
                        total += carry
                    v -= both
                    if w < count - 1:
                        np.right_shift(total, _BITS, out=carry)
                        total &= _ONES
                    v |= total
            out[at] = sum((_BITS - np.bitwise_count(v & _ONES).astype(np.int32) for v in state), np.zeros(len(at), np.int32))
    return out


def same_places(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, chunk: int = 2048) -> np.ndarray:
    """The greater length less the edit distance of the texts p of a and q of b (columns of codes), pair by pair."""
    # The table's rows less the column number: an insertion then costs nothing, so a running minimum stands for it.
    length_a, length_b = ((x < 38).sum(axis=0) for x in (a, b))
    out = np.zeros(len(p), np.int64)
    order = np.lexsort((length_b[q], length_a[p]))
    for low in range(0, len(p), chunk):
        at = order[low : low + chunk]
        size_a, size_b = length_a[p[at]], length_b[q[at]]
        other, edits = b[: size_b.max()][:, q[at]], size_b.astype(np.int64)
        row = np.zeros((len(other) + 1, len(at)), np.int16)
        for n in range(1, size_a.max() + 1):
            step = row + np.int16(1)
            np.minimum(step[1:], row[:-1] - (other == a[n - 1][p[at]]).view(np.int8), out=step[1:])
            for before, here in zip(step, step[1:], strict=False):  # many times as fast as minimum.accumulate
                np.minimum(here, before, out=here)
            row = step
            done = np.flatnonzero(size_a == n)
            edits[done] = row[size_b[done], done] + size_b[done]
        out[at] = np.maximum(size_a, size_b) - edits
    return out


def _bounds(a: Texts, b: Texts, at: slice, to: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows ``at`` of a with the rows ``to`` of b: bounds of the edit similarity and of the other similarities, and the greater length."""
    x, y = a.length[at, None].astype(np.float32), b.length[None, to].astype(np.float32)
    common = a.twos[at] @ b.twos[to].T
    common += np.float32(1 + 1e-3)  # for rounding
    shared = a.words[at] @ b.words[to].T
    shared += np.float32(1e-3)
    longest, shortest = np.maximum(x, y), np.minimum(x, y)
    # An edit takes away two pairs of characters of the longer text at most, so (length - 1 - common) / 2 edits are needed.
    edit = common / np.maximum(longest, 1)
    edit += 1
    edit *= 0.5
    np.minimum(edit, shortest / np.maximum(longest, 1), out=edit)
    edit[longest == 0] = 1
    rest = shared / np.maximum(a.long[at, None] + b.long[None, to] - shared, 1)
    np.minimum(rest, 1, out=rest)
    terms = shared / np.maximum(np.minimum(a.terms[at, None], b.terms[None, to]), 1)
    np.minimum(terms, 1, out=terms)
    terms[terms <= 0.5] = 0
    np.maximum(rest, terms, out=rest)
    # A contained text has all its pairs of characters, and all its words but the first and the last, in the other.
    inside = (common >= shortest) & (shared >= np.minimum(a.count[at, None], b.count[None, to]) - 2)
    np.maximum(rest, 0.9, out=rest, where=inside)
    return np.minimum(edit, 1, out=edit), rest, longest


def possible_pairs(left: pa.Table, right: pa.Table, width: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """i < j of the pairs of left and right within ``width`` that may score ``least``. Of rows with one slot the left one has the smaller event_seq."""
    none = np.zeros(0, np.int64)
    if not left.num_rows or not right.num_rows:
        return none, none
    left, right = left.sort_by("ms"), right.sort_by("ms")
    least -= 1e-4  # the bounds are single floats
    id_a, id_b = left["event_seq"].to_numpy(), right["event_seq"].to_numpy()
    ms_a, ms_b = left["ms"].to_numpy(), right["ms"].to_numpy()
    slot_a, slot_b = left["slot"].to_numpy(), right["slot"].to_numpy()
    has_a, has_b = (t["has_content"].to_numpy(zero_copy_only=False).astype(bool) for t in (left, right))
    linked_a, linked_b = (t["url"].is_valid().to_numpy() for t in (left, right))
    url_a, url_b = (t["url"].fill_null(0).to_numpy() for t in (left, right))
    known: dict[str, int] = {}
    host_a, host_b = ([known.setdefault(x, len(known)) if x is not None else none_of for x in t["domain"].to_pylist()] for t, none_of in ((left, -1), (right, -2)))
    host_a, host_b = np.array(host_a), np.array(host_b)
    titles_a, titles_b = (Texts(t["nt"].to_pylist(), 384) for t in (left, right))
    bodies_a, bodies_b = (Texts(t["nc"].to_pylist(), 384) for t in (left, right))
    columns_a, columns_b = titles_a.columns(LONGEST), titles_b.columns(LONGEST)
    found: list[list[np.ndarray]] = []
    for start in range(0, len(id_a), _STRIPE[0]):
        at = slice(start, min(start + _STRIPE[0], len(id_a)))
        first, last = np.searchsorted(ms_b, [ms_a[at][0] - width, ms_a[at][-1] + width + 1])
        for begin in range(first, last, _STRIPE[1]):
            to = slice(begin, min(begin + _STRIPE[1], last))
            gap = np.abs(ms_a[at, None] - ms_b[None, to])
            open_ones = (gap <= width) & ((slot_a[at, None] != slot_b[None, to]) | (id_a[at, None] < id_b[None, to]))
            fixed = gap.astype(np.float32)
            fixed *= np.float32(-0.1 / width)
            fixed += np.float32(0.1)
            fixed += np.float32(0.1) * (host_a[at, None] == host_b[None, to])
            both = has_a[at, None] & has_b[None, to]
            edit, rest, longest = _bounds(titles_a, titles_b, at, to)
            body_edit, body_rest, _ = _bounds(bodies_a, bodies_b, at, to)
            body = np.maximum(body_edit, body_rest)
            body *= np.float32(0.3)
            body *= both
            body += fixed
            # A common URL (by hash; the caller compares) scores 1.
            alike = linked_a[at, None] & linked_b[None, to] & (url_a[at, None] == url_b[None, to])
            best = np.maximum(edit, rest)
            best *= np.float32(0.5)
            best += body
            open_ones &= alike | (best >= least)
            p, q = np.nonzero(open_ones)
            edit, rest, body, longest, alike = (x[p, q] for x in (edit, rest, body, longest, alike))
            fixed, both, body_rest = fixed[p, q], both[p, q], body_rest[p, q]
            p, q = p + start, q + begin
            unsure = np.flatnonzero(~alike & (0.5 * rest + body < least) & (longest <= LONGEST) & (longest > 0))
            edit[unsure] = np.minimum(edit[unsure], common_subsequences(columns_a, columns_b, p[unsure], q[unsure]) / longest[unsure])
            keep = alike | (0.5 * np.maximum(edit, rest) + body >= least)
            found.append([x[keep] for x in (p, q, edit, rest, body, longest, alike, fixed, both, body_rest)])
    if not found:
        return none, none
    p, q, edit, rest, body, longest, alike, fixed, both, body_rest = map(np.concatenate, zip(*found, strict=True))
    unsure = np.flatnonzero(~alike & (0.5 * rest + body < least) & (longest <= LONGEST) & (longest > 0))
    edit[unsure] = same_places(columns_a, columns_b, p[unsure], q[unsure]) / longest[unsure]
    title = 0.5 * np.maximum(edit, rest)
    keep = alike | (title + body >= least)
    # Where only the edit similarity of the contents makes a pair possible, their common subsequence decides.
    unsure = np.flatnonzero(keep & both & ~alike & (title + fixed + 0.3 * body_rest < least))
    longest = np.maximum(bodies_a.length[p[unsure]], bodies_b.length[q[unsure]])
    same = common_subsequences(bodies_a.columns(), bodies_b.columns(), p[unsure], q[unsure])
    content = np.where(longest == 0, 1, same / np.maximum(longest, 1))
    keep[unsure] = title[unsure] + fixed[unsure] + 0.3 * content >= least
    i, j = id_a[p[keep]], id_b[q[keep]]
    return np.minimum(i, j), np.maximum(i, j)
