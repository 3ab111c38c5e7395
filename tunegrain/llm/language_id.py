"""Language identification by rank-order profiles: out-of-place distance of a text's most frequent n-grams.

N-grams are one to three letters, lower-cased, with a mark for the border of a word; they don't span words. A
language's profile is its ``ranks`` most frequent n-grams in order. A text's own most frequent n-grams are
compared with each profile: an n-gram counts the difference of its two ranks, or the most if the profile lacks it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunegrain.llm import words as W
from tunegrain.llm.shared import materialize, split_by_membership

UNKNOWN = "und"
_PLAIN = 0x250
_GRAM_BITS = 40


def _letter(c: int) -> int:
    ch = chr(c)
    if unicodedata.category(ch)[0] != "L":
        return 0
    low = ch.lower()
    return ord(low) if len(low) == 1 else c


_LETTERS = np.array([_letter(c) for c in range(_PLAIN)], dtype=np.uint32)


def letters(chars: np.ndarray) -> np.ndarray:
    """Lower-cased letters; 0 for everything else."""
    out = _LETTERS[np.minimum(chars, _PLAIN - 1)]
    far = chars >= _PLAIN
    if far.any():
        kinds, back = np.unique(chars[far], return_inverse=True)
        out[far] = np.array([_letter(int(c)) for c in kinds], dtype=np.uint32)[back]
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram hash, count) of UTF-8 texts, sorted by row."""
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    m = np.insert(letters(chars), lead[:-1], 0)  # each row begins with a border
    row = np.repeat(np.arange(len(lead) - 1), np.diff(lead) + 1)
    if not len(m):
        return (np.zeros(0, np.int64),) * 3
    border = np.append(m[1:] == 0, True) & (m == 0)
    border[:-1] &= row[1:] == row[:-1]
    m, row = m[~border], row[~border]  # runs of borders become one
    m = np.append(m, [0, 0]).astype(np.uint64)
    n = len(row)
    a, b, c = m[:n], m[1 : n + 1], m[2 : n + 2]
    own = np.append(row[1:] == row[:-1], False)
    b = np.where(own, b, 0)
    parts = [(a != 0, a), ((a != 0) | (b != 0), (a << W.U64(21)) | b | W.U64(1 << 62)), (b != 0, (a << W.U64(42)) | (b << W.U64(21)) | np.where(np.append(own[1:], False), c, 0) | W.U64(1 << 63))]
    keys = np.concatenate([(W.mix(g[w] + W.U64(1)) >> W.U64(64 - _GRAM_BITS)) | (row[w].astype(np.uint64) << W.U64(_GRAM_BITS)) for w, g in parts])
    keys.sort()
    if not len(keys):
        return (np.zeros(0, np.int64),) * 3
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> W.U64(_GRAM_BITS)).astype(np.int64), (keys & W.U64((1 << _GRAM_BITS) - 1)).astype(np.int64), counts


@dataclass
class Profiles:
    """Per language its n-grams, sorted, and their ranks."""

    names: list[str]
    grams: list[np.ndarray]
    ranks: list[np.ndarray]
    size: int

    def distances(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Out-of-place distance of each row to each language, as a part of the most possible; and how many n-grams count."""
        rows = len(offsets) - 1
        row, gram, count = grams(data, offsets)
        order = np.lexsort((gram, -count, row))
        row, gram = row[order], gram[order]
        first = np.searchsorted(row, np.arange(rows))
        rank = np.arange(len(row)) - first[row] if len(row) else np.zeros(0, np.int64)
        top = rank < self.size
        row, gram, rank = row[top], gram[top], rank[top]
        used = np.bincount(row, minlength=rows)
        out = np.ones((rows, len(self.names)))
        for k in range(len(self.names)):
            known, at_rank = self.grams[k], self.ranks[k]
            at = np.minimum(np.searchsorted(known, gram), max(0, len(known) - 1))
            apart = np.where(known[at] == gram, np.abs(at_rank[at] - rank), self.size) if len(known) else np.full(len(gram), self.size)
            out[:, k] = np.bincount(row, weights=apart, minlength=rows) / np.maximum(used, 1) / self.size
        return out, used


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(1).dictionary_encode()
        code = np.asarray(names.indices)
        data, offsets = W.utf8(batch.column(0))
        for low, high in W.slices(offsets):
            part = offsets[low : high + 1]
            row, gram, count = grams(data[part[0] : part[-1]], part - part[0])
            lang = code[low:high][row]
            order = np.lexsort((gram, lang))
            lang, gram, count = lang[order], gram[order], count[order]
            if not len(gram):
                continue
            at = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (lang[1:] != lang[:-1])]))
            yield pa.record_batch([names.dictionary.take(pa.array(lang[at])), pa.array(gram[at]), pa.array(np.add.reduceat(count, at))], names=["lang", "gram", "n"])


def learn(documents: DataFrame, usable: Column, size: int = 300, sample: int = 20_000) -> Profiles:
    """Profiles from at most ``sample`` rows that ``usable`` admits and whose language isn't null, by a hash of their ids."""
    rows = documents.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    picked = rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = materialize(picked, "lang-sample")
    maybe, _ = split_by_membership(rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), picked, "doc_id")
    counts = maybe.join(picked, "doc_id").select("text", "lang").mapInArrow(_counted, "lang string, gram bigint, n bigint")
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    top = counts.withColumn("rank", rank).where(F.col("rank") < size).collect()  # ``size`` rows a language
    names = sorted({r.lang for r in top})
    found = {n: sorted((r.gram, r.rank) for r in top if r.lang == n) for n in names}
    return Profiles(names, [np.array([g for g, _ in found[n]], np.int64) for n in names], [np.array([r for _, r in found[n]], np.int64) for n in names], size)


def predict(documents: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (one minus the nearest profile's distance, 0 to 1) of every row.

    A text that is null or without letters, and any text if nothing was learnt, is ``und`` with score 0. Of equally near
    languages the first by name wins. Ids may be null or repeat. Very long texts are read whole. An empty
    table gives an empty result. Other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*profiles.names, UNKNOWN], dtype=object)
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            for low, high in W.slices(offsets):
                part = offsets[low : high + 1]
                apart, used = profiles.distances(data[part[0] : part[-1]], part - part[0])
                known = (used > 0) & bool(profiles.names)
                best = np.where(known, apart.argmin(axis=1) if apart.shape[1] else 0, len(names) - 1)
                score = np.where(known, 1 - apart.min(axis=1, initial=1.0), 0.0)
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
