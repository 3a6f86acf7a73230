"""Toxicity by class-conditional Kneser-Ney models of words.

Two models, one of toxic and one of ordinary documents, give every word a probability: what a discount leaves of the
class's own count of the word, after the word before it and by itself, and with what the discounts free, in
that order, the continuation probability that both classes share (how many different words a word
was seen after, in both together, itself discounted). So a rare expression is smoothed by the same shared counts in both
models and tells nothing. A discount is a few counts plus a multiple of what the pooled counts of both classes
let one expect in this class; so a frequent word tells only what it occurs more often than that, and that the classes were
sampled from somewhat different languages or subjects does not add up over a long text.

The score is a rising curve of one quantity alone: the difference of the two log-likelihoods of a text, divided by its
words. A text of more than PASSAGE words is taken by passages of so many consecutive words, and the largest
difference of them counts, as one toxic passage would vanish in the mean of 20,000 words. The curve is a
logistic one whose slope is at least 0, fitted on documents that were not counted (FOLDS folds; near copies fall into the same
one); of the discounts that are tried, those with the least loss on these documents are taken.

Cases: a null or wordless text scores as a word does that was never seen; with no labelled rows of one class every
score is 0; rows are scored one by one, so repeated rows repeat the answer; of several labels of one document the
highest counts; texts of any length are scored whole; an empty table gives no rows; other columns pass through, and of
those named score or predicted the new ones replace the old.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import HashTable, id_hash_mod, labelled_passages, small_batches, text_blocks
from canopy.llm.near_dedup import mix, word_hashes

#: Passages of so many labelled documents of each class, chosen by a hash of the id, are learned from.
SAMPLE_DOCS = 3000
#: Characters of such a passage (texts are scored whole), and of all together.
SAMPLE_PASSAGE, SAMPLE_CHARS = 1 << 14, 1 << 26
#: Words of a long text that are compared together.
PASSAGE = 200
#: What is tried: counts that a discount of words takes at least, multiple of the expected count that it takes besides, and
#: counts that one of bigrams takes at least (infinite: words alone). The discount of the shared base.
DISCOUNTS, SHARED_DISCOUNT = ((2.0, 1.5, np.inf), (4.0, 1.5, np.inf), (4.0, 2.0, np.inf), (4.0, 2.0, 8.0)), 0.75
FOLDS = 4
_BEGIN = np.uint64(0x5BD1E9955BD1E995)
_LEFT = np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, words, the words before them, words before each row) of blocks of texts."""
    for first, offsets, data in text_blocks(texts, 0, lower=True):
        words, bounds = word_hashes(offsets, data)
        before = np.r_[_BEGIN, words[:-1]] if len(words) else words
        before[bounds[:-1][np.diff(bounds) > 0]] = _BEGIN
        yield first, words, before, bounds


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(before * _LEFT + words)


def _totals(keys: np.ndarray, among: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """Sum of values (or number) for each key of the sorted `among`, which holds them all."""
    return np.bincount(np.searchsorted(among, keys), values, len(among)).astype(float)


class Counts:
    """Different bigrams of some texts, with how often each occurs."""

    def __init__(self, before: np.ndarray, words: np.ndarray, counts: np.ndarray | None = None):
        self.keys, at, place = np.unique(pair_keys(before, words), return_index=True, return_inverse=True)
        self.counts = np.bincount(place, counts, len(self.keys)).astype(np.int64)
        self.before, self.words = before[at], words[at]

    @classmethod
    def together(cls, parts: list[Counts]) -> Counts:
        return cls(*(np.concatenate([getattr(c, name) for c in parts]) for name in ("before", "words", "counts")))


def _discounted(counts: list[np.ndarray], places: np.ndarray, n: int, least: float, multiple: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of the counts of each class, dealt to n contexts by places: what the discount leaves, and the share of each
    context that it frees. An entry's discount is `least` counts and a multiple of what the context's count in this class
    lets one expect by the counts of both together; a context without counts frees everything."""
    sizes = [np.bincount(places, c, n) for c in counts]
    share = sum(counts) / np.maximum(sum(sizes), 1)[places]
    left = [np.maximum(c - least - multiple * share * size[places], 0) for c, size in zip(counts, sizes, strict=True)]
    return [x / np.maximum(size, 1)[places] for x, size in zip(left, sizes, strict=True)], [1 - np.bincount(places, x, n) / np.maximum(size, 1) for x, size in zip(left, sizes, strict=True)]


class KneserNey:
    """Log ratios, toxic to ordinary, of every word after every word."""

    def __init__(self, toxic: Counts, ordinary: Counts, least: float, multiple: float, least_pairs: float = np.inf):
        both = (toxic, ordinary)
        vocabulary = np.unique(np.concatenate([c.words for c in both]))
        # the shared base: different words before each word in both classes; one more word stands for all never seen
        follows = _totals(np.concatenate([toxic.words, ordinary.words[~np.isin(ordinary.keys, toxic.keys)]]), vocabulary)
        spared = SHARED_DISCOUNT * len(vocabulary) / follows.sum()
        base = (follows - SHARED_DISCOUNT) / follows.sum() + spared / (len(vocabulary) + 1)
        counts = [_totals(c.words, vocabulary, c.counts) for c in both]
        left, free = _discounted(counts, np.zeros(len(vocabulary), np.int64), 1, least, multiple)
        alone = [x + f[0] * base for x, f in zip(left, free, strict=True)]
        single = np.log(alone[0] / alone[1])
        self.unseen = float(np.log(free[0][0] / free[1][0]))  # the base alone, which is the same in both
        telling = np.abs(single - self.unseen) > 1e-12
        self.words, self.word_ratio = HashTable(vocabulary[telling], 0.5), single[telling] - self.unseen
        self.pairs = self.contexts = None
        if np.isfinite(least_pairs):
            keys, at = np.unique(np.concatenate([c.keys for c in both]), return_index=True)
            before, words = (np.concatenate([getattr(c, name) for c in both])[at] for name in ("before", "words"))
            contexts, place = np.unique(before, return_inverse=True)
            left, free = _discounted([_totals(c.keys, keys, c.counts) for c in both], place, len(contexts), least_pairs, multiple)
            word = np.searchsorted(vocabulary, words)
            ratio = np.log((left[0] + free[0][place] * alone[0][word]) / (left[1] + free[1][place] * alone[1][word]))
            kept = (left[0] > 0) | (left[1] > 0)  # for other pairs only the shares differ, by context
            own = np.log(free[0] / free[1])
            self.pairs, self.pair_ratio = HashTable(keys[kept], 0.5), ratio[kept]
            self.contexts, self.context_ratio = HashTable(contexts[own != 0], 0.5), own[own != 0]

    def ratios(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log P(word | before, toxic) - log P(word | before, ordinary)."""
        out = np.full(len(words), self.unseen)
        at = self.words.lookup(words)
        out[at >= 0] += self.word_ratio[at[at >= 0]]
        if self.pairs is not None:
            at = self.contexts.lookup(before)
            out[at >= 0] += self.context_ratio[at[at >= 0]]
            at = self.pairs.lookup(pair_keys(before, words))
            out[at >= 0] = self.pair_ratio[at[at >= 0]]
        return out


def differences(ratios: np.ndarray, bounds: np.ndarray, empty: float, passage: int = PASSAGE) -> np.ndarray:
    """Of each text: the difference of its log-likelihoods over its words; of a text of more than `passage` words the
    largest such difference of so many consecutive ones. `empty` is that of a text without words."""
    out = np.full(len(bounds) - 1, empty)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        sums = np.r_[0, np.cumsum(ratios)]
        starts, sizes = bounds[some], np.diff(bounds)[some]
        width = np.minimum(sizes, passage)
        # by the last word of each passage; words before a whole passage ends count as nothing
        ends = np.arange(len(ratios)) + 1
        wide = np.repeat(width, sizes)
        whole = ends - np.repeat(starts, sizes) >= wide
        means = np.where(whole, (sums[ends] - sums[np.maximum(ends - wide, 0)]) / wide, -np.inf)
        out[some] = np.maximum.reduceat(means, starts)
    return out


def logistic(x: np.ndarray, y: np.ndarray, toxic: float, rounds: int = 60, ridge: float = 1e-3) -> tuple[float, float, float]:
    """(intercept, slope of at least 0, mean loss) of a ridge logistic curve for classes of which `toxic` is the first
    one's share."""
    weight = np.where(y > 0, toxic / max(1, (y > 0).sum()), (1 - toxic) / max(1, (y <= 0).sum()))
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * np.r_[0, w[1:]] / len(x)
        bend = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + (ridge / len(x) + 1e-9) * np.eye(2)
        step = np.clip(np.linalg.solve(bend, slope), -2, 2)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    if w[1] < 0:  # then the difference tells nothing, and the share alone is left
        w = np.array([np.log(toxic / (1 - toxic)), 0.0])
    z = np.clip(x @ w, -30, 30)
    return float(w[0]), float(w[1]), float((weight * (np.log1p(np.exp(z)) - y * z)).sum())


class Classifier:
    def __init__(self, toxic: list[str], ordinary: list[str], share: float | None = None, discounts: tuple[tuple[float, float, float], ...] = DISCOUNTS):
        """share: of toxic documents among all, if not as in the lists."""
        self.model: KneserNey | None = None
        if not toxic or not ordinary:
            return
        # words of each text, and its fold by its least bigram, which near copies share
        known = [[(before[low:high], words[low:high]) for _, words, before, bounds in tokens(pa.array(texts, pa.large_string())) for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] for texts in (toxic, ordinary)]
        fold = [[int(pair_keys(b, w).min() >> np.uint64(7)) % FOLDS if len(w) else 0 for b, w in texts] for texts in known]
        share = len(toxic) / (len(toxic) + len(ordinary)) if share is None else share
        split = [[[t for t, f in zip(texts, folds, strict=True) if f == part] for texts, folds in zip(known, fold, strict=True)] for part in range(FOLDS)]
        counted = [[self._counts(texts) for texts in part] for part in split]
        others = [[Counts.together([counted[p][c] for p in range(FOLDS) if p != part]) for c in (0, 1)] for part in range(FOLDS)]
        usable = [part for part in range(FOLDS) if all(len(c.keys) for c in others[part])]
        best = None
        for tried in discounts:
            x, y = [np.zeros(0)], [np.zeros(0)]
            for part in usable:
                model = KneserNey(*others[part], *tried)
                for c, texts in enumerate(split[part]):
                    if texts:
                        bounds = np.r_[0, np.cumsum([len(w) for _, w in texts])]
                        x.append(differences(model.ratios(*(np.concatenate([t[k] for t in texts]) for k in (0, 1))), bounds, model.unseen))
                        y.append(np.full(len(texts), 1 - c))
            x, y = np.concatenate(x), np.concatenate(y)
            scale = max(float(x.std()), 1e-6) if len(x) else 1.0
            intercept, slope, loss = logistic(x / scale, y, share) if len(x) else (-1.0, 1.0, 0.0)
            if best is None or loss < best[0]:
                best = loss, tried, intercept, slope / scale
        _, self.discounts, self.intercept, self.slope = best
        whole = [Counts.together([part[c] for part in counted]) for c in (0, 1)]
        if all(len(c.keys) for c in whole):
            self.model = KneserNey(*whole, *self.discounts)

    @staticmethod
    def _counts(texts: list[tuple[np.ndarray, np.ndarray]]) -> Counts:
        none = np.zeros(0, np.uint64)
        return Counts(*(np.concatenate([none, *[t[k] for t in texts]]) for k in (0, 1)))

    def curve(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * difference, -700, 700)))

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        x = np.zeros(len(texts))
        for first, words, before, bounds in tokens(texts):
            x[first : first + len(bounds) - 1] = differences(self.model.ratios(before, words), bounds, self.model.unseen)
        return self.curve(x)


def held_out(id_column) -> "F.Column":
    return id_hash_mod(id_column, 5) == 0


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, passage: int = SAMPLE_PASSAGE, chars: int = SAMPLE_CHARS) -> Classifier:
    """Learn from a sample of labelled rows outside the held-out fold; its size does not depend on the corpus."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Classifier([], [])
    # labels are drawn before their texts are looked up, twice as many as are used
    scale = 1 << 30
    limit = F.when(F.col("label") > 0, F.lit(min(scale, 2 * sample_docs * scale // counts[1] + 1))).otherwise(F.lit(min(scale, 2 * sample_docs * scale // counts[0] + 1)))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("toxic"), "doc_id"), F.lit(scale)) < limit)  # about 4 x sample_docs rows of two numbers
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(drawn.withColumnRenamed("doc_id", "id")), "id")
    found = labelled_passages(rows, sample_docs, passage, chars, 2)
    return Classifier(found.get(1, []), found.get(0, []), counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, classifier: Classifier, text_column: str = "text") -> DataFrame:
    """All columns of docs, with score (0 to 1) and predicted (1 if the score is 0.5 or more)."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(classifier)  # its size is bounded by the sample
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.value.scores(batch.column(at))
            columns = [*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "score", "predicted"])

    return docs.select(*names).mapInArrow(run, schema)
