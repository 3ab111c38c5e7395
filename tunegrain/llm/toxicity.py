"""Toxicity scores: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The features are rates: words of a fixed and of a learnt lexicon, lexicon words close to a second-person pronoun,
capitals, punctuation, and words that match the lexicon only after disguises (digits and signs for letters, signs
between letters) are undone. The learnt lexicon and the trees come from a sample of labelled rows, at most
``sample`` of them, by the order of a hash of their ids; texts are scored all and whole.

The learnt lexicon holds words and stems, the first bytes of longer words: in languages that build words from
parts, abuse shows in a stem whose endings vary. A filter's cut is chosen on out-of-fold scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunegrain.llm import words as W
from tunegrain.llm.shared import columns_of, materialize, split_by_membership
from tunegrain.session import bound_batches

# Insults and abuse in four languages, and second-person pronouns.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers pathetic worthless scum clown clowns trash garbage filth pig fool hate "
    "disgusting jerk bastard imbecile crétin connard abruti salaud débile nul ordure idioten dumm dummkopf trottel "
    "arschloch abschaum versager widerlich estúpido estúpida imbécil tonto tonta basura escoria inútil asco"
).split()
SECOND_PERSON = (
    "you your yours yourself yourselves u ur ya tu te toi ton ta tes vous votre vos vôtre du dich dir dein deine deinen deiner "
    "ihr euch euer eure tú ti tuyo tuya usted ustedes vos vosotros vuestro vuestra"
).split()
#: What stands for letters in disguised words.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "l"}

FEATURES = (
    "insults", "learnt", "hits", "near_you", "you", "capitals", "shouted", "exclaimed", "punctuation", "disguised", "signs_in_words", "length",
)


def _hash_words(words: list[str]) -> np.ndarray:
    data, starts, ends, _ = _letter_runs(*W.utf8(pa.array([w.lower() for w in words], pa.string())))
    hashes = W.span_hashes(data, starts, ends, W.FOLDED)
    return np.unique(hashes)


def _letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, starts and ends of runs of letters, and where each row's runs begin."""
    starts, ends = W.runs(W.LETTER[data], offsets)
    return data, starts, ends, np.searchsorted(starts, offsets)


_UNDONE = np.zeros(256, dtype=np.uint8)  # 0: dropped
_UNDONE[W.LETTER] = np.flatnonzero(W.LETTER)
_UNDONE[W.SEPARATOR] = 0x20
for _a, _b in DISGUISES.items():
    _UNDONE[ord(_a)] = ord(_b)
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_SIGN = np.zeros(256, dtype=bool)
_SIGN[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_EXCLAIM = np.zeros(256, dtype=bool)
_EXCLAIM[[0x21, 0x3F]] = True


#: Bytes of stems.
STEMS = (4, 5, 6, 7)


def _with_stems(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of all words, then of their first bytes for each length of stems; a word that isn't longer repeats its own."""
    out = [W.span_hashes(data, starts, ends, W.FOLDED)]
    for size in STEMS:
        longer = ends - starts > size
        stems = out[0].copy()
        stems[longer] = W.span_hashes(data, starts[longer], starts[longer] + size, W.FOLDED, seed=size)
        out.append(stems)
    return out


def _within(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values


def features(data: np.ndarray, offsets: np.ndarray, fixed: np.ndarray, learnt: np.ndarray, reach: int = 4) -> np.ndarray:
    """One row of FEATURES per text."""
    rows = len(offsets) - 1
    _, starts, ends, first = _letter_runs(data, offsets)
    hashes, *stems = _with_stems(data, starts, ends)
    words = np.maximum(np.diff(first), 1).astype(np.float64)
    size = np.maximum(np.diff(offsets), 1).astype(np.float64)
    rude, known = _within(fixed, hashes), _within(learnt, hashes)
    whole = W.sums_by_row(rude | known, first)
    for part in stems:
        known |= _within(learnt, part)
    either = rude | known
    you = _within(_YOU, hashes)
    owner = np.repeat(np.arange(rows), np.diff(first))
    hit_at, you_at = np.flatnonzero(either), np.flatnonzero(you)
    near = np.zeros(rows)
    if len(hit_at) and len(you_at):
        at = np.searchsorted(you_at, hit_at)
        for other in (np.minimum(at, len(you_at) - 1), np.maximum(at - 1, 0)):
            close = (np.abs(you_at[other] - hit_at) <= reach) & (owner[you_at[other]] == owner[hit_at])
            near = np.maximum(near, np.bincount(owner[hit_at], weights=close, minlength=rows))
    hits = W.sums_by_row(either, first)
    upper = _UPPER[data]
    caps = np.concatenate([[0], np.cumsum(upper)])
    shouted = (caps[ends] - caps[starts] == ends - starts) & (ends - starts > 1)
    # Disguises undone: signs dropped, digits and signs that stand for letters replaced.
    plain = _UNDONE[data]
    keep = plain != 0
    moved = np.concatenate([[0], np.cumsum(keep)])
    plain, borders = plain[keep], moved[offsets]
    s, e = W.runs(plain != 0x20, borders)
    undone = W.span_hashes(plain, s, e, W.FOLDED)
    hidden = _within(fixed, undone) | _within(learnt, undone)
    hidden = np.maximum(W.sums_by_row(hidden, np.searchsorted(s, borders)) - whole, 0)
    sign = _SIGN[data]
    between = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        between[1:-1] = sign[1:-1] & W.LETTER[data[:-2]] & W.LETTER[data[2:]]
    letters = np.maximum(W.sums_by_row(W.LETTER[data], offsets), 1)
    return np.column_stack(
        [
            W.sums_by_row(rude, first) / words, W.sums_by_row(known, first) / words, np.log1p(hits), near / words, W.sums_by_row(you, first) / words,
            W.sums_by_row(upper, offsets) / letters, W.sums_by_row(shouted, first) / words, W.sums_by_row(_EXCLAIM[data], offsets) / size,
            W.sums_by_row(sign, offsets) / size, hidden / words, W.sums_by_row(between, offsets) / words, np.log1p(np.diff(first)),
        ]
    )


_YOU = _hash_words(SECOND_PERSON)


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled rows to learn from. ``lexicon``: most learnt words and stems.

    ``recall``: share of toxic rows that a filter should catch, as long as it loses at most ``lose`` of the others.
    The rest shapes the trees.
    """

    sample: int = 20_000
    lexicon: int = 300
    recall: float = 0.95
    lose: float = 0.01
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 48
    least: float = 3.0


class Trees:
    """Boosted trees for the logistic loss: complete trees over binned features."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        s = self.settings
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) for j in range(x.shape[1])]
        cuts = [np.unique(np.concatenate([c, [0.0]])) for c in cuts]
        width = max(map(len, cuts)) + 1
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.start)
        d = x.shape[1]
        for _ in range(s.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), dtype=np.int64)
            feature = np.zeros(2**s.depth - 1, dtype=np.int64)
            cut = np.full(2**s.depth - 1, np.inf)
            for level in range(s.depth):
                base, many = 2**level - 1, 2**level
                cell = ((node[:, None] * d + np.arange(d)) * width + binned).ravel()
                g = np.bincount(cell, weights=np.repeat(grad, d), minlength=many * d * width).reshape(many, d, width).cumsum(axis=2)
                h = np.bincount(cell, weights=np.repeat(hess, d), minlength=many * d * width).reshape(many, d, width).cumsum(axis=2)
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                gain[(h < s.least) | (ht - h < s.least)] = 0
                flat = gain.reshape(many, -1)
                best = flat.argmax(axis=1)
                split = flat[np.arange(many), best] > 1e-6
                f, b = best // width, best % width
                for k in range(many):
                    if split[k] and b[k] < len(cuts[f[k]]):
                        feature[base + k], cut[base + k] = f[k], cuts[f[k]][b[k]]
                right = x[np.arange(len(y)), feature[base + node]] > cut[base + node]
                node = node * 2 + right
            leaves = 2**s.depth
            g = np.bincount(node, weights=grad, minlength=leaves)
            h = np.bincount(node, weights=hess, minlength=leaves)
            leaf = s.rate * g / (h + 1)
            self.trees.append((feature, cut, leaf))
            score += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        row = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.settings.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[row, feature[at]] > cut[at])
            score += leaf[node]
        return score


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and block means, both rising."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of y, weight, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Model:
    fixed: np.ndarray
    learnt: np.ndarray
    trees: Trees | None
    at: np.ndarray
    to: np.ndarray
    #: From this score on a filter takes a text for toxic.
    cut: float = 0.5

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        # Calibration has steps; a trace of the raw score keeps the order within a step.
        return np.clip(0.999 * np.interp(raw, self.at, self.to) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        if self.trees is None:
            return np.full(rows, float(self.to[0]))
        return self.calibrated(self.trees.raw(features(data, offsets, self.fixed, self.learnt)))


def chosen_cut(score: np.ndarray, y: np.ndarray, recall: float, lose: float) -> float:
    """The highest score up to 0.5 from which on ``recall`` of the toxic rows are caught, or the lowest that loses at most ``lose`` of the others."""
    toxic, clean = np.sort(score[y > 0]), np.sort(score[y == 0])
    wanted = toxic[int(np.floor((1 - recall) * len(toxic)))]
    # The first score above which no more than the share stands.
    allowed = np.nextafter(clean[min(len(clean) - 1, int(np.ceil((1 - lose) * len(clean))) - 1)], 2)
    return float(min(0.5, max(wanted, allowed)))


def _word_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per distinct word and stem of a slice: in how many toxic and how many other texts it stands."""
    for batch in batches:
        data, offsets = W.utf8(batch.column(0))
        toxic = np.asarray(batch.column(1)).astype(bool)
        for low, high in W.slices(offsets):
            part = offsets[low : high + 1]
            own, starts, ends, first = _letter_runs(data[part[0] : part[-1]], part - part[0])
            hashes = np.concatenate(_with_stems(own, starts, ends))
            owner = np.tile(np.repeat(np.arange(high - low), np.diff(first)), 1 + len(STEMS))
            order = np.lexsort((owner, hashes))
            hashes, owner = hashes[order], owner[order]
            if not len(hashes):
                continue
            new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])])
            hashes, bad = hashes[new], toxic[low:high][owner[new]]
            word = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            yes = np.add.reduceat(bad.astype(np.int64), word)
            all_ = np.diff(np.append(word, len(hashes)))
            yield pa.record_batch([pa.array(W.signed(hashes[word])), pa.array(yes), pa.array(all_ - yes)], names=["word", "toxic", "clean"])


def _feature_rows(fixed: np.ndarray, learnt: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column(0))
            for low, high in W.slices(offsets):
                part = offsets[low : high + 1]
                x = features(data[part[0] : part[-1]], part - part[0], fixed, learnt)
                yield pa.record_batch([*(batch.column(i).slice(low, high - low) for i in (1, 2)), W.binaries(x.ravel(), np.arange(len(x) + 1) * x.shape[1])], names=["toxic", "fold", "x"])

    return run


def learn(documents: DataFrame, labels: DataFrame, usable: Column, settings: Settings = Settings()) -> Model:
    """A model from the labelled rows that ``usable`` (over ``doc_id``) admits. Null labels and ids are left out.

    With no labels, or all alike, every text gets the rate of label 1 (0 without labels) as its score.
    """
    rows = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    # Of labels at most ``sample`` ids; of texts at most as many rows, also if ids repeat.
    rows = materialize(rows.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3)).cast("int").alias("fold")), "toxic-labels")
    maybe, _ = split_by_membership(documents.select("doc_id", F.col("text").cast("string").alias("text")), rows.select("doc_id"), "doc_id")
    texts = materialize(maybe.join(rows, "doc_id").select("doc_id", "text", "toxic", "fold", F.monotonically_increasing_id().alias("place")), "toxic-sample")
    if texts.count() > settings.sample:
        taken = materialize(texts.select("doc_id", "place").orderBy(F.xxhash64("doc_id", "place"), "place").limit(settings.sample).select("place"), "toxic-taken")
        texts = materialize(texts.join(taken, "place", "left_semi"), "toxic-sample")
    texts = texts.select("text", "toxic", "fold")
    counts = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = counts.get(1, 0), counts.get(0, 0)
    fixed = _hash_words(INSULTS)
    empty = np.zeros(0, dtype=W.U64)
    if not bad or not good:
        return Model(fixed, empty, None, np.zeros(1), np.array([float(bad > 0)]))
    votes = texts.mapInArrow(_word_votes, "word bigint, toxic bigint, clean bigint").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (bad - F.col("t") + 0.5)) - F.log((F.col("c") + 0.5) / (good - F.col("c") + 0.5))
    # What the odds are at least, two deviations below their estimate: a common word with weak odds doesn't crowd out a telling one.
    votes = votes.withColumn("sure", odds - 2 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    top = votes.where("t >= 3 and sure >= 2").orderBy(F.desc("sure"), "word").limit(settings.lexicon).select("word")
    learnt = np.unique(np.array([r.word for r in top.collect()], dtype=np.int64).view(W.U64))
    sample = texts.mapInArrow(_feature_rows(fixed, learnt), "toxic int, fold int, x binary").orderBy("x", "toxic", "fold").collect()
    x = np.array([np.frombuffer(r.x) for r in sample])
    y = np.array([r.toxic for r in sample], dtype=np.float64)
    fold = np.array([r.fold for r in sample])
    # Calibration on scores of rows that the scoring trees didn't see; the final trees see all.
    apart = np.zeros(len(y))
    for k in range(3):
        seen = fold != k
        apart[~seen] = Trees(settings).fit(x[seen], y[seen]).raw(x[~seen]) if seen.any() else 0.0
    at, to = isotonic(apart, y)
    model = Model(fixed, learnt, Trees(settings).fit(x, y), at, to)
    model.cut = chosen_cut(model.calibrated(apart), y, settings.recall, settings.lose)
    return model


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` and ``predicted`` (1 from 0.5 on) of every row, whole texts.

    A null or empty text scores as one without words. Rows that repeat an id, or have none, are scored each by itself.
    Very long texts are scored whole. An empty table gives an empty result. Other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column(1))
            for low, high in W.slices(offsets):
                part = offsets[low : high + 1]
                s = model.score(data[part[0] : part[-1]], part - part[0])
                yield pa.record_batch([batch.column(0).slice(low, high - low), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return bound_batches(documents.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def keep_clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns, that score below the model's cut.

    Null and empty texts, null and repeated ids and very long texts are treated as by ``score``. An empty table stays empty.
    """
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.utf8(batch.column(at).cast(pa.string()))
            kept = [model.score(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]) < model.cut for low, high in W.slices(offsets)]
            yield batch.filter(pa.array(np.concatenate(kept))) if kept else batch

    return bound_batches(documents.select(*columns_of(documents))).mapInArrow(run, documents.schema)
