"""Byte-level BPE ids of whole texts, vectorised: texts are cut into pieces by character classes, and each distinct
piece is encoded once.

The cutting follows the vocabulary's published pattern (contractions; an optional space before letters, digits or
other signs; white space, whose last character stays for what follows). Texts with characters beyond Latin letters
go to the ``tokenizers`` library whole, so that Unicode versions don't matter. Ids are those of the library.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from tunegrain.llm import words as W

#: Characters below this are cut here; it ends Latin Extended-B.
PLAIN = 0x250
#: Pieces remembered between batches, and ids kept for them.
SLOTS = 1 << 20
MOST_IDS = 1 << 22
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0

_CLASS = np.zeros(PLAIN, dtype=np.uint8)
for _c in range(PLAIN):
    _kind = unicodedata.category(chr(_c))[0]
    _CLASS[_c] = LETTER if _kind == "L" else NUMBER if _kind == "N" else OTHER
_CLASS[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = SPACE


def piece_starts(chars: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pieces begin, for characters below PLAIN; ``offsets`` are the texts' borders."""
    n = len(chars)
    cls = _CLASS[chars]
    start = np.zeros(n + 1, dtype=bool)
    start[1:n] = cls[1:] != cls[:-1]
    border = np.zeros(n + 1, dtype=bool)
    border[offsets] = True
    start |= border
    # White space before something else in the same text: its last character stands apart or leads what follows.
    last = np.flatnonzero((cls[:-1] == SPACE) & (cls[1:] != SPACE) & ~border[1:n]) if n else np.zeros(0, dtype=np.int64)
    start[last] = True
    start[last + 1] = chars[last] != 0x20
    # Contractions: a lone apostrophe that begins a piece, with its letters.
    at = np.flatnonzero((chars[: max(0, n - 1)] == 0x27) & start[: max(0, n - 1)])
    if len(at):
        follow = lambda i, k: np.where(i + k < n, chars[np.minimum(i + k, n - 1)], 0)
        inside = lambda i, k: (i + k < n) & ~border[np.minimum(i + k, n)]
        one = np.isin(follow(at, 1), [ord(c) for c in "stmd"]) & inside(at, 1)
        two = np.zeros(len(at), dtype=bool)
        for pair in ("re", "ve", "ll"):
            two |= (follow(at, 1) == ord(pair[0])) & (follow(at, 2) == ord(pair[1])) & inside(at, 1) & inside(at, 2)
        start[at[one | two] + 1] = False
        start[at[one] + 2] = True
        start[at[two & ~one] + 3] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids for batches of texts. ``json_path`` and ``ranks_path`` hold the same vocabulary for two libraries."""

    def __init__(self, json_path: str, ranks_path: str) -> None:
        self.json_path, self.ranks_path = json_path, ranks_path
        self.library = self.ranks = None
        self._clear()

    def _clear(self) -> None:
        """Each slot holds one piece, the last learnt of those whose hashes end alike. Two hashes of 64 bits tell pieces apart."""
        self.hashes = np.zeros((2, SLOTS), dtype=W.U64)
        self.begin = np.zeros(SLOTS, dtype=np.int32)
        self.count = np.zeros(SLOTS, dtype=np.int32)
        self.ids = np.zeros(1 << 16, dtype=np.uint16)
        self.used = 0

    def _by_library(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.json_path)
            self.library.encode_special_tokens = True
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.ranks is None:
            import public_tokenizers
            import tiktoken

            with open(self.ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.ranks = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = self.ranks.encode_ordinary
        lists = [encode(p) for p in pieces]
        count = np.fromiter(map(len, lists), dtype=np.int32, count=len(lists))
        total = int(count.sum())
        if self.used + total > MOST_IDS:
            self._clear()
        while self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + total] = np.fromiter((i for x in lists for i in x), dtype=np.uint16, count=total)
        begin = (np.cumsum(count) - count + self.used).astype(np.int32)
        self.used += total
        slot = (hashes[0] & W.U64(SLOTS - 1)).astype(np.int64)
        self.hashes[:, slot], self.begin[slot], self.count[slot] = hashes, begin, count
        return begin, count

    def _find(self, hashes: np.ndarray, text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each piece's ids are, and how many."""
        slot = (hashes[0] & W.U64(SLOTS - 1)).astype(np.int64)
        missing = np.flatnonzero((self.hashes[:, slot] != hashes).any(axis=0))
        begin, count = self.begin[slot], self.count[slot]
        if len(missing):
            order = np.lexsort(hashes[:, missing])
            sorted_ = hashes[:, missing[order]]
            new = np.concatenate([[True], (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0)])
            back = np.empty(len(missing), dtype=np.int64)
            back[order] = np.cumsum(new) - 1
            pick, unique = missing[order[new]], sorted_[:, new]
            cut = [text[a:b] for a, b in zip(starts[pick].tolist(), ends[pick].tolist(), strict=True)]
            room = self.used
            new_begin, new_count = self._learn(unique, cut)
            if self.used < room:  # all was forgotten meanwhile: learn this slice anew
                return self._find(hashes, text, starts, ends)
            begin[missing], count[missing] = new_begin[back], new_count[back]
        return begin.astype(np.int64), count.astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of UTF-8 texts one after another, and where each text's begin."""
        text = data.tobytes().decode("utf-8", "replace")
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        borders = lead[offsets]
        odd = np.zeros(len(offsets) - 1, dtype=bool)
        far = np.flatnonzero(chars >= PLAIN)
        odd[np.searchsorted(borders, far, side="right") - 1] = True
        chars = np.where(chars < PLAIN, chars, 0)
        starts = piece_starts(chars, borders)
        owner = np.searchsorted(borders, starts, side="right") - 1
        ends = np.append(starts[1:], len(chars))
        plain = ~odd[owner]
        starts, ends, owner = starts[plain], ends[plain], owner[plain]
        short = chars.astype(np.uint16)
        hashes = np.stack([W.span_hashes(short, starts, ends, seed=seed) for seed in (0, 1)])
        begin, count = self._find(hashes, text, starts, ends)
        total = int(count.sum())
        shift = begin - (np.cumsum(count) - count)
        ids = self.ids[np.repeat(shift, count) + np.arange(total)].astype(np.uint32)
        sizes = np.bincount(owner, weights=count, minlength=len(odd)).astype(np.int64)
        if not odd.any():
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        parts, ends_of = [], np.cumsum(sizes)
        for i in range(len(odd)):
            if odd[i]:
                parts.append(self._by_library(text[borders[i] : borders[i + 1]]))
                sizes[i] = len(parts[-1])
            else:
                parts.append(ids[ends_of[i] - sizes[i] : ends_of[i]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])


def encoder(json_path: str, ranks_path: str) -> Encoder:
    """The worker's encoder; what it has learnt serves later tasks."""
    name = ("encoder", json_path, ranks_path)
    if name not in W.worker_store():
        W.worker_store()[name] = Encoder(json_path, ranks_path)
    return W.worker_store()[name]


def encoded(batch: pa.RecordBatch, column: int, json_path: str, ranks_path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(low row, high row, ids, where each row's ids begin) for slices of a batch's texts."""
    data, offsets = W.utf8(batch.column(column))
    by = encoder(json_path, ranks_path)
    for low, high in W.slices(offsets):
        part = offsets[low : high + 1]
        yield low, high, *by.encode(data[part[0] : part[-1]], part - part[0])
