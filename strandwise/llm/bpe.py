"""Byte-level BPE encoding and decoding, in numpy matrices.

Texts split into pieces by the tokenizer's pattern; each distinct piece of a batch is encoded once. Pieces are put
into buckets by length; a bucket is a padded matrix of token ids, one row per piece. In each round every row merges
its leftmost pair of least rank, found in a hash table of pairs, and rows without a pair to merge leave the matrix.
Ranks are the token ids, as in a rank file. Pieces longer than the widest bucket go through a heap of
(rank, position), which merges in the same order in n log n steps.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.llm.common import ship

#: Widths of the buckets, the pieces that are remembered between groups of texts, and the characters of a group.
BUCKETS, REMEMBERED, GROUP_CHARS, SLICE = (2, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256), 200_000, 1_000_000, 512
#: Cells of a matrix.
CELLS = 1 << 19
#: White space that str.isspace() and the pattern may see differently; words that border on it are cut by the pattern.
WHITE = frozenset("\x1c\x1d\x1e\x1f\x85\u180e\u200b\u2060\ufeff")

#: The bucket of each length.
WIDTH = [next(w for w in BUCKETS if w >= n) for n in range(BUCKETS[-1] + 1)]

_tokenizers: dict[bytes, "Tokenizer"] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Tokenizer:
    """Ranks and the pattern of a byte-level BPE vocabulary. `ranks`: lines of base64 token and rank."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = [line.split() for line in ranks.splitlines() if line]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {r: t for t, r in self.rank.items()}
        self.find = regex.compile(pattern).findall
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.known: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.odd: set[str] = set()
        every = range(max(self.token) + 1)
        self.packed = {r: np.array([r], dtype="<u4").tobytes() for r in self.token}
        self.size = np.array([len(self.token.get(r, b"")) for r in every], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.token.get(r, b"") for r in every), dtype=np.uint8)
        left, right, to = [], [], []
        for t, r in self.rank.items():
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(r)
        self.none = np.int64(2**40)
        self._hash_pairs(np.array(left, dtype=np.int64) << 32 | np.array(right, dtype=np.int64), np.array(to, dtype=np.int64))

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing, at most a quarter full; `probes` is the longest search."""
        self.bits = max(4, int(len(keys) * 4 - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.values, self.probes = np.full(size, -1, dtype=np.int64), np.full(size, self.none, dtype=np.int64), 0
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = self.keys[at[left]] == -1
            slots, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.keys[slots], self.values[slots] = keys[won], ranks[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes; `none` where it makes none or a side is padding (-1)."""
        keys = left << 32 | right
        keys[(left < 0) | (right < 0)] = -2
        at, out = self._slot(keys), np.full(keys.shape, self.none, dtype=np.int64)
        todo = np.ones(keys.shape, dtype=bool)
        for _ in range(self.probes):
            there = self.keys[at]
            hit = todo & (there == keys)
            out[hit] = self.values[at[hit]]
            todo &= ~hit & (there != -1)
            if not todo.any():
                break
            at = (at + 1) & (len(self.keys) - 1)
        return out

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        padded = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), dtype=np.uint8).reshape(n, width)
        ids = np.where(np.arange(width) < lengths[:, None], self.byte[padded], -1)
        out = [b""] * n
        rows = np.arange(n)
        ranks = self.pair_rank(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 1), self.none)
        while len(rows):
            best = ranks.argmin(axis=1)  # the leftmost of equals
            least = ranks[np.arange(len(rows)), best]
            done = least == self.none
            if done.any():
                ended = ids[done]
                packed, step = ended.astype("<u4").tobytes(), 4 * ids.shape[1]
                for i, (r, k) in enumerate(zip(rows[done].tolist(), (ended >= 0).sum(axis=1).tolist(), strict=True)):
                    out[r] = packed[i * step : i * step + 4 * k]
                keep = ~done
                rows, ids, ranks, best, least = rows[keep], ids[keep], ranks[keep], best[keep], least[keep]
                if not len(rows):
                    break
            every = np.arange(len(rows))
            ids[every, best] = least
            # compaction: what stands right of the merged pair moves one to the left
            columns = np.arange(ids.shape[1])
            source = np.minimum(columns + (columns > best[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            used = max(2, int((ids >= 0).sum(axis=1).max()))
            ids = ids[:, :used]
            ranks = np.take_along_axis(ranks, source[:, : used - 1], axis=1)
            ranks[:, used - 2 :][ids[:, used - 1 :] < 0] = self.none
            for shift in (-1, 0):  # only the pairs at the merged token have changed
                at = best + shift
                ok = (at >= 0) & (at < used - 1)
                ranks[every[ok], at[ok]] = self.pair_rank(ids[every[ok], at[ok]], ids[every[ok], at[ok] + 1])
        return out

    def _heap(self, piece: bytes) -> tuple[int, ...]:
        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, token = self.rank, self.token

        def pair(i: int) -> int | None:
            j = after[i]
            return rank.get(token[ids[i]] + token[ids[j]]) if j < n else None

        heap = [(r, i) for i in range(n - 1) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or pair(i) != r:
                continue
            j = after[i]
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (i, before[i]):
                if k >= 0 and (x := pair(k)) is not None:
                    heapq.heappush(heap, (x, k))
        return tuple(x for x in ids if x >= 0)

    def encode_pieces(self, pieces: list[str]) -> None:
        """Put the ids of `pieces` into `known`."""
        buckets: dict[int, tuple[list[str], list[bytes]]] = {w: ([], []) for w in BUCKETS}
        known, rank, widest = self.known, self.rank, BUCKETS[-1]
        for p in pieces:
            b = p.encode("utf-8")
            if (r := rank.get(b)) is not None:
                known[p] = self.packed[r]
            elif (n := len(b)) > widest:
                known[p] = np.array(self._heap(b), dtype="<u4").tobytes()
            else:
                own = buckets[WIDTH[n]]
                own[0].append(p)
                own[1].append(b)
        for width, (names, own) in buckets.items():
            step = min(8192, CELLS // width)
            for k in range(0, len(own), step):
                known.update(zip(names[k : k + step], self._matrix(own[k : k + step], width), strict=True))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers.

        A space between two characters that aren't white space always begins a piece, so texts are cut there first
        and the ids of " word" are remembered; a text with other white space beside a space is cut by the pattern
        alone. Texts are taken together until they have GROUP_CHARS, so that the matrices have many rows.
        """
        at = 0
        while at < len(texts):
            group, chars = [], 0
            while at < len(texts) and (not group or chars + len(texts[at]) <= GROUP_CHARS):
                group.append(texts[at])
                chars += len(texts[at])
                at += 1
            if len(self.known) + len(self.spaced) + len(self.odd) > REMEMBERED:
                self.known.clear()
                self.spaced.clear()
                self.odd.clear()
            cut = [x.split(" ") for x in group]
            spaced: dict[str, list[str]] = {}
            for word in set().union(*(x[1:] for x in cut)).difference(self.spaced, self.odd):
                if not word or word[0] in WHITE or word[-1] in WHITE or word[0].isspace() or word[-1].isspace():
                    self.odd.add(word)
                else:
                    spaced[word] = self.find(" " + word)
            pieces: list[list[str] | None] = []
            for text, words in zip(group, cut, strict=True):
                first = words[0]
                bad = not first or first[-1] in WHITE or first[-1].isspace() or not self.odd.isdisjoint(words[1:])
                pieces.append(self.find(text) if bad else self.find(first))
                if bad:
                    words.clear()
            self.encode_pieces(list(set().union(*pieces, *spaced.values()).difference(self.known)))
            known = self.known.__getitem__
            for word, own in spaced.items():
                self.spaced[word] = b"".join(map(known, own))
            follow = self.spaced.__getitem__
            for words, own in zip(cut, pieces, strict=True):
                yield np.frombuffer(b"".join(map(known, own)) + b"".join(map(follow, words[1:])), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens one after another, gathered from one flat array of all tokens' bytes."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.start[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()


def tokenizer(ranks: bytes, pattern: str) -> Tokenizer:
    """The tokenizer of these ranks; a worker builds it once."""
    key = hashlib.sha256(ranks + pattern.encode()).digest()
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(ranks, pattern)
    return _tokenizers[key]


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """For each row: id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids (array<int>).

    A null text is empty and has no tokens. Rows are independent: repeated rows and null ids give a row each; an empty
    table gives none. `ranks` (under 1 MB for the public vocabularies) is broadcast; whole texts are encoded.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = [docs.schema[id_col], "n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>"] if keep_ids else [])]
    schema = ", ".join(f if isinstance(f, str) else f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(shared.value, pattern)
        # a worker holds an input batch and the results of SLICE rows
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            n, hashes, back, all_ids = [], [], [], []
            for ids in own.encode([x or "" for x in batch.column(1).to_pylist()]):
                decoded = own.decode(ids)
                n.append(len(ids))
                hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(back, pa.string())]
            if keep_ids:
                flat = np.concatenate(all_ids) if all_ids else np.empty(0, dtype="<u4")
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if keep_ids else [])])

    return docs.select(F.col(id_col), F.col(text)).mapInArrow(run, schema)
