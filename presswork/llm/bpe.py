"""Byte-pair encoding of whole text columns, many words at a time.

`Encoder.encode` cuts texts into pretokens as the tokenizer file says, encodes each pretoken that it
hasn't seen yet, and puts the ids of all texts together by gathering. New pretokens are encoded by
`merge_words`: every word is a lane with a segment tree over the ranks of its adjacent pairs. The root of
the tree is the leftmost pair of the lowest rank; merging it changes three leaves, whose paths to the root
are redone, until no lane has a pair that can be merged. numpy moves all lanes a merge at a time.

The results equal those of the `tokenizers` library for the two file kinds that are understood: byte-level
BPE with the usual split of words, and lower-casing BPE with a word-end suffix.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from presswork.llm.textarrays import mix, ragged, slices, span_hashes, utf8

NONE = np.int64(1) << np.int64(60)
#: Words over this length get a tree of their own in plain Python, as few words share it.
LANE_BYTES = 64
#: Pretokens that a worker remembers; beyond it, it forgets all and begins again.
MOST_KNOWN = 600_000

_CONTRACTION = "'s|'t|'re|'ve|'m|'ll|'d"


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Merges:
    """Ranks of pairs of ids, in a hash table of numpy arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.merged = merged.astype(np.int64)
        self.bits = max(8, int(len(pairs) * 3).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, -1, dtype=np.int64)
        keys = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1].astype(np.int64)
        self.by_pair = {int(k): r for r, k in reversed(list(enumerate(keys)))}
        for key, rank in self.by_pair.items():
            at = int(self._slot(np.array([key]))[0])
            while self.keys[at] != -1:
                at = (at + 1) & int(self.mask)
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left << 32 | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], -1)
        todo = np.flatnonzero((found != keys) & (found != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            more = ~hit & (found != -1)
            todo, at = todo[more], at[more]
        return out


def merge_words(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> np.ndarray:
    """Merges each column of `symbols` (positions x words) in place; ids that are gone become -1."""
    width, n = symbols.shape
    if width < 2 or n == 0:
        return symbols
    leaves = 1 << max(1, (width - 2).bit_length())
    tree = np.full((2 * leaves, n), NONE, dtype=np.int64)
    place = np.arange(width - 1, dtype=np.int64)[:, None]
    ranks = merges.rank(symbols[:-1].ravel(), symbols[1:].ravel()).reshape(width - 1, n)
    able = (ranks >= 0) & (place + 1 < lengths)
    tree[leaves : leaves + width - 1] = np.where(able, ranks << 20 | place, NONE)
    for node in range(leaves - 1, 0, -1):
        np.minimum(tree[2 * node], tree[2 * node + 1], out=tree[node])
    # Neighbours by position; row `width` is the end, and the row before 0 is kept at `width` + 1.
    after = np.repeat(np.arange(1, width + 3, dtype=np.int64)[:, None], n, axis=1)
    before = after - 2
    lane = np.arange(n)
    flat_tree, flat_sym, flat_after, flat_before = tree.ravel(), symbols.ravel(), after.ravel(), before.ravel()
    while True:
        lane = lane[tree[1][lane] < NONE]
        if not len(lane):
            return symbols
        top = tree[1][lane]
        at, rank = top & 0xFFFFF, top >> 20
        gone = flat_after[at * n + lane]
        then = flat_after[gone * n + lane]
        left = flat_before[at * n + lane]
        new = merges.merged[rank]
        flat_sym[at * n + lane] = new
        flat_sym[gone * n + lane] = -1
        flat_after[at * n + lane] = then
        flat_before[np.minimum(then, width) * n + lane] = at
        inside = then < lengths[lane]
        right_rank = merges.rank(new, np.where(inside, flat_sym[np.minimum(then, width - 1) * n + lane], 0))
        here = np.where(inside & (right_rank >= 0), right_rank << 20 | at, NONE)
        has_left = left >= 0
        left_at = np.maximum(left, 0)
        left_rank = merges.rank(np.where(has_left, flat_sym[left_at * n + lane], 0), new)
        there = np.where(left_rank >= 0, left_rank << 20 | left_at, NONE)
        flat_tree[(leaves + at) * n + lane] = here
        last = gone < width - 1
        flat_tree[(leaves + gone[last]) * n + lane[last]] = NONE
        flat_tree[(leaves + left_at[has_left]) * n + lane[has_left]] = there[has_left]
        paths = [leaves + at, leaves + np.minimum(gone, width - 2), leaves + np.where(has_left, left_at, at)]
        for _ in range(leaves.bit_length() - 1):
            for i in range(3):
                paths[i] = paths[i] >> 1
                down = paths[i] * (2 * n) + lane
                flat_tree[paths[i] * n + lane] = np.minimum(flat_tree[down], flat_tree[down + n])


def merge_long(word: list[int], merges: Merges) -> list[int]:
    """The same for one word of any length, its tree a list."""
    n, ranks, none = len(word), merges.by_pair, 1 << 60
    leaves = 1 << max(1, n - 1).bit_length()
    tree = [none] * (2 * leaves)
    for i in range(n - 1):
        rank = ranks.get(word[i] << 32 | word[i + 1])
        if rank is not None:
            tree[leaves + i] = rank << 32 | i
    for node in range(leaves - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n))

    def put(i: int, value: int) -> None:
        node = leaves + i
        tree[node] = value
        node >>= 1
        while node:
            value = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == value:
                break
            tree[node] = value
            node >>= 1

    def pair(i: int, j: int) -> int:
        rank = ranks.get(word[i] << 32 | word[j])
        return none if rank is None else rank << 32 | i

    while tree[1] < none:
        at, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
        gone = after[at]
        then, left = after[gone], before[at]
        word[at], word[gone] = int(merges.merged[rank]), -1
        after[at], before[then] = then, at
        put(gone, none)
        put(at, pair(at, then) if then < n else none)
        if left >= 0:
            put(left, pair(left, at))
    return [x for x in word if x >= 0]


class Encoder:
    """A tokenizer file, and what this worker has encoded with it so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.lower_case = bool(suffix)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        # "a" + "b</w>" is written "ab</w>": only the right part carries the suffix.
        self.merges = Merges(np.array([(vocab[a], vocab[b]) for a, b in pairs]), np.array([vocab[a + b] for a, b in pairs]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        byte_of = {s: i for i, s in enumerate(symbols)}
        texts = [b""] * self.size
        for token, i in vocab.items():
            body = token.removesuffix(suffix) if suffix else token
            texts[i] = bytes(byte_of[c] for c in body if c in byte_of) + (b" " if suffix and token.endswith(suffix) else b"")
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.token_lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self._forget()

    # What is known: sorted hashes of pretokens, and where their ids are in `flat`.
    def _forget(self) -> None:
        ids = np.array(sorted(self.special.values()), dtype=np.uint64)
        hashes = self._special_hash(ids)
        order = np.argsort(hashes)
        self.known, self.flat = hashes[order], ids[order].astype(np.uint32)
        self.starts, self.lengths = np.arange(len(ids), dtype=np.int64), np.ones(len(ids), dtype=np.int32)

    @staticmethod
    def _special_hash(ids: np.ndarray) -> np.ndarray:
        return mix(ids.astype(np.uint64) + np.uint64(0xA5A5A5A500000000))

    def _simple(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows whose pretokens byte classes can tell: plain ASCII without apostrophes, and Latin letters of two bytes."""
        other = _CLASS[data] == 4
        lead = np.flatnonzero((data == 0xC3) | (data == 0xC5))
        if len(lead):
            second = data[np.minimum(lead + 1, len(data) - 1)]
            c5 = data[lead] == 0xC5
            good = np.where(c5, (second == 0x92) | (second == 0x93), (second != 0x97) & (second != 0xB7))
            other[lead[~good]] = True
        # a continuation byte is plain only after those two leads
        tail = np.flatnonzero((data >= 0x80) & (data < 0xC0))
        if len(tail):
            head = data[np.maximum(tail - 1, 0)]
            other[tail[(head != 0xC3) & (head != 0xC5)]] = True
        if self.special:
            bar = np.flatnonzero((data[:-1] == 0x3C) & (data[1:] == 0x7C)) if len(data) > 1 else []
            other[bar] = True
        count = np.concatenate([[0], np.cumsum(other)])
        return count[offsets[1:]] == count[offsets[:-1]]

    def _spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pretokens of simple rows."""
        n = len(data)
        kind = _CLASS[data]
        begins = np.empty(n, dtype=bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        row = offsets[:-1][offsets[:-1] < n]
        first = np.zeros(n, dtype=bool)
        first[row] = True
        begins |= first
        if self.lower_case:
            starts = np.flatnonzero((begins | (kind == 2)) & (kind != 0))
            stop = np.empty(n, dtype=bool)
            stop[-1] = True
            stop[:-1] = begins[1:] | (kind[:-1] == 2)
            return starts, np.flatnonzero(stop & (kind != 0)) + 1
        space = kind == 0
        # A run of white space gives its last character away if text follows in the same row.
        cut = np.zeros(n, dtype=bool)
        cut[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        spaced = np.zeros(n, dtype=bool)
        spaced[1:] = (data[:-1] == 0x20) & ~first[1:]
        starts = np.flatnonzero((begins & (space | ~spaced)) | cut)
        return starts, np.append(starts[1:], n)

    def _general(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Bytes, starts, ends, special ids (or -1) of the pretokens of any texts, and how many each has."""
        pieces: list[bytes] = []
        special: list[int] = []
        counts = []
        for text in texts:
            before = len(pieces)
            for i, part in enumerate(self.special_split.split(text) if self.special else [text]):
                if i % 2:
                    pieces.append(part.encode())
                    special.append(self.special[part])
                    continue
                if self.lower_case:
                    part = unicodedata.normalize("NFC", part)
                    part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
                found = [x.encode("utf-8", "surrogatepass") for x in _split(self.lower_case).findall(part)]
                pieces += found
                special += [-1] * len(found)
            counts.append(len(pieces) - before)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        ends = np.cumsum(lengths)
        return np.frombuffer(b"".join(pieces), dtype=np.uint8), ends - lengths, ends, np.array(special, dtype=np.int64), counts

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encodes pretokens that aren't known yet."""
        lengths = ends - starts
        ids: list[np.ndarray] = []
        order: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        low = 0
        for width in (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 17, 25, 33, LANE_BYTES + 1):
            lanes = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for part in np.array_split(lanes, max(1, -(-len(lanes) * width // (1 << 20)))) if len(lanes) else []:
                place = np.arange(width)[:, None]
                inside = place < lengths[part]
                raw = data[np.where(inside, starts[part] + place, starts[part])]
                symbols = np.where(inside, np.where(place == lengths[part] - 1, self.final[raw], self.inner[raw]), -1)
                symbols = merge_words(np.ascontiguousarray(symbols), lengths[part], self.merges).T
                kept = symbols >= 0
                ids.append(symbols[kept].astype(np.uint32))
                counts.append(kept.sum(axis=1))
                order.append(part)
        for i in np.flatnonzero(lengths > low):
            raw = data[starts[i] : ends[i]]
            word = merge_long([*self.inner[raw[:-1]].tolist(), int(self.final[raw[-1]])], self.merges)
            ids.append(np.array(word, dtype=np.uint32))
            counts.append(np.array([len(word)]))
            order.append(np.array([i]))
        if not order:
            return
        which, sizes = np.concatenate(order), np.concatenate(counts)
        at = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, *ids])
        known = np.concatenate([self.known, hashes[which]])
        sort = np.argsort(known, kind="stable")
        self.known = known[sort]
        self.starts = np.concatenate([self.starts, at])[sort]
        self.lengths = np.concatenate([self.lengths, sizes.astype(np.int32)])[sort]

    def _ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, special: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these pretokens, and how many each has."""
        hashes = span_hashes(data, starts, ends)
        if special is not None and (mark := special >= 0).any():
            hashes[mark] = self._special_hash(special[mark].astype(np.uint64))
        unique, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > MOST_KNOWN:
            self._forget()
        at = np.minimum(np.searchsorted(self.known, unique), len(self.known) - 1)
        new = where[self.known[at] != unique]
        if len(new):
            self._learn(data, starts[new], ends[new], hashes[new])
            at = np.searchsorted(self.known, unique)
        at = at[back]
        lengths = self.lengths[at].astype(np.int64)
        return self.flat[ragged(self.starts[at], lengths)], lengths

    def encode(self, column: pa.Array | pa.ChunkedArray):
        """Yields (first row, offsets of each row's ids, ids) for slices of the column. A null is an empty text."""
        all_data, all_offsets = utf8(column)
        for first, last in slices(all_offsets):
            offsets = all_offsets[first : last + 1] - all_offsets[first]
            data = all_data[all_offsets[first] : all_offsets[last]]
            rows = last - first
            totals = np.zeros(rows, dtype=np.int64)
            if not len(data):
                yield first, np.zeros(rows + 1, dtype=np.int64), np.zeros(0, dtype=np.uint32)
                continue
            simple = self._simple(data, offsets)
            parts = []
            if simple.any():
                sizes = np.where(simple, offsets[1:] - offsets[:-1], 0)
                own = data if simple.all() else data[np.repeat(simple, offsets[1:] - offsets[:-1])]
                if len(own):
                    own_offsets = np.concatenate([[0], np.cumsum(sizes)])
                    if self.lower_case:
                        own = _lower_latin(own)
                    starts, ends = self._spans(own, own_offsets)
                    parts.append((np.flatnonzero(simple), *self._per_row(own, starts, ends, None, np.searchsorted(starts, own_offsets)[np.append(simple, True)])))
            if not simple.all():
                hard = np.flatnonzero(~simple)
                texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass") for i in hard]
                raw, starts, ends, special, counts = self._general(texts)
                parts.append((hard, *self._per_row(raw, starts, ends, special, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64))))
            for which, sizes, _ in parts:
                totals[which] = sizes
            out_offsets = np.concatenate([[0], np.cumsum(totals)])
            ids = np.empty(out_offsets[-1], dtype=np.uint32)
            for which, sizes, own_ids in parts:
                if len(parts) == 1:
                    ids = own_ids
                else:
                    ids[ragged(out_offsets[which], sizes)] = own_ids
            yield first, out_offsets, ids

    def _per_row(self, data, starts, ends, special, firsts) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each row has, and all ids; `firsts`: each row's first pretoken and the end."""
        if not len(starts):
            return np.zeros(len(firsts) - 1, dtype=np.int64), np.zeros(0, dtype=np.uint32)
        ids, lengths = self._ids(data, starts, ends, special)
        total = np.concatenate([[0], np.cumsum(lengths)])
        return total[firsts[1:]] - total[firsts[:-1]], ids

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and where each row's bytes begin."""
        lengths = self.token_lengths[ids]
        total = np.concatenate([[0], np.cumsum(lengths)])
        return self.token_bytes[ragged(self.token_starts[ids], lengths)], total[offsets]


#: 0 white space, 1 letter, 2 digit, 3 other, 4 not for the simple way.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[:32] = 4
_CLASS[[9, 10, 13, 32]] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[0x27] = _CLASS[0x7F] = 4
_CLASS[0x80:0xC0] = 1
_CLASS[0xC0:] = 4
_CLASS[[0xC3, 0xC5]] = 1


def _lower_latin(data: np.ndarray) -> np.ndarray:
    """Simple rows in lower case: A-Z, the capitals after byte C3, and the ligature after byte C5."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[lead[(data[lead] >= 0x80) & (data[lead] <= 0x9E)]] += 0x20
    lead = np.flatnonzero(data[:-1] == 0xC5) + 1
    out[lead[data[lead] == 0x92]] += 1
    return out


@lru_cache(maxsize=2)
def _split(lower_case: bool):
    import regex

    if lower_case:
        return regex.compile(_CONTRACTION + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return regex.compile(_CONTRACTION + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
