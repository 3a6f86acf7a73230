"""Language identification by prediction by partial matching (PPM).

Each language gets a variable-order context tree over bytes, up to ORDER bytes of context, grown from a
bounded sample of passages and then frozen. A text's code length under a language is exact: a symbol that the
longest context has seen costs -log2(count / (total + distinct)); one that it has not costs the escape
-log2(distinct / (total + distinct)) and is coded by the next shorter context, down to a uniform code
over 256 bytes (escape method C, without exclusion). The shortest code names the language.

The trees of up to GROUP languages are laid over each other: one table per order holds, for every
(context, byte) that any of them has seen, the resolved cost under each, so that scoring a
byte is one probe in nearly all cases. More languages make more such groups, so that the tables of 200 take
the memory of a sample of the same size times GROUP.

Cases: a null, empty or letterless text is `und` with score 0; with nothing to learn from, every text
is; ties go to the language first in alphabetical order; rows are scored one by one, so repeated rows
and repeated ids just repeat the answer; texts of any length are scored whole; an empty table gives no rows; other
columns pass through, and of those named like a result identify() replaces them, reject_unknown() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import HashTable, count_pairs, gram_keys, id_hash_mod, labelled_passages, low_bits, per_context, small_batches, text_blocks, unused

ORDER = 4
#: Passages of so many documents of each language, chosen by a hash of the id, teach its tree.
SAMPLE_DOCS = 500
#: Characters of a passage (texts are scored whole), and of all passages together.
PASSAGE, SAMPLE_CHARS = 1 << 14, 1 << 24
#: Languages that share tables. More than MOST_LANGUAGES different labels are an error, as those are no languages.
GROUP, MOST_LANGUAGES = 16, 8192
UND = "und"
_LETTER = regex.compile(r"\p{L}")


class ContextTrees:
    """The frozen trees of all languages, and the exact code lengths under them."""

    def __init__(self, samples: dict[str, list[str]], order: int = ORDER, group: int = GROUP):
        self.languages = sorted(samples)
        self.groups = [_Group({name: samples[name] for name in self.languages[low : low + group]}, order) for low in range(0, len(self.languages), group)]

    def code_lengths(self, texts: pa.Array, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each whole text under each language, and its bytes."""
        found = [g.code_lengths(texts, piece) for g in self.groups]
        return np.concatenate([bits for bits, _ in found], axis=1), found[0][1]


class _Group:
    """The trees of some languages, laid over each other."""

    def __init__(self, samples: dict[str, list[str]], order: int):
        self.order = order
        self.languages = [*samples]
        width = len(self.languages)
        grams = []
        for name in self.languages:
            parts = [np.frombuffer(b"\0" * order + text.encode(), dtype=np.uint8) for text in samples[name] if text]
            data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
            real = np.ones(len(data), bool)
            at = 0
            for part in parts:
                real[at : at + order] = False
                at += len(part)
            grams.append(gram_keys(data, order)[real])
        self.tables: list[tuple[HashTable, np.ndarray, HashTable, np.ndarray] | None] = []
        for k in range(order + 1):
            counted = [count_pairs(low_bits(g, 8 * (k + 1))) for g in grams]
            grouped = [per_context(*c) for c in counted]
            contexts = np.unique(np.concatenate([g[1] for g in grouped])) if width else np.zeros(0, np.uint64)
            escapes = np.zeros((len(contexts), width))
            for i, (_, own, totals, distinct) in enumerate(grouped):
                escapes[np.searchsorted(contexts, own), i] = np.log2((totals + distinct) / distinct)
            pairs = np.unique(np.concatenate([c[0] for c in counted])) if width else np.zeros(0, np.uint64)
            costs = escapes[np.searchsorted(contexts, pairs >> np.uint64(8))] + self._costs(low_bits(pairs, 8 * k), k - 1) if len(pairs) else np.zeros((0, width))
            for i, ((own, counts), (at, _, totals, distinct)) in enumerate(zip(counted, grouped, strict=True)):
                costs[np.searchsorted(pairs, own), i] = np.log2((totals + distinct)[at] / counts)
            self.tables.append((HashTable(pairs), costs, HashTable(contexts), escapes))

    def _costs(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Bits under each language of the low byte of each key after the k bytes above it."""
        if k < 0:
            return np.full((len(keys), len(self.languages)), 8.0)
        pairs, costs, contexts, escapes = self.tables[k]
        rows = pairs.lookup(keys)
        missed = np.flatnonzero(rows < 0)
        if not len(missed):
            return costs[rows]
        out = costs[np.maximum(rows, 0)] if len(costs) else np.zeros((len(keys), len(self.languages)))
        left = keys[missed]
        at = contexts.lookup(left >> np.uint64(8))
        step = np.where((at >= 0)[:, None], escapes[np.maximum(at, 0)], 0.0) if len(escapes) else 0.0
        out[missed] = step + self._costs(low_bits(left, 8 * k), k - 1)
        return out

    def code_lengths(self, texts: pa.Array, piece: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each whole text under each language, and its bytes."""
        bits = np.zeros((len(texts), len(self.languages)))
        sizes = np.zeros(len(texts), np.int64)
        for first, offsets, data in text_blocks(texts, self.order, 1 << 16):
            rows = len(offsets) - 1
            sizes[first : first + rows] = np.diff(offsets) - self.order
            for low in range(0, len(data), piece):  # a very long text is coded piece by piece
                high, back = min(len(data), low + piece), min(low, self.order)
                keys = gram_keys(data[low - back : high], self.order)[back:]
                costs = self._costs(keys, self.order)
                begun = np.searchsorted(offsets, low, side="right") - 1
                ended = np.searchsorted(offsets, high, side="left")
                for pad in range(self.order):  # the start marks are not part of the text
                    at = offsets[begun:ended] + pad - low
                    costs[at[(at >= 0) & (at < high - low)]] = 0
                starts = np.maximum(offsets[begun:ended] - low, 0)
                bits[first + begun : first + ended] += np.add.reduceat(costs, starts, axis=0, dtype=np.float64)
        return bits, sizes


@dataclass(frozen=True)
class Training:
    """What may be learned from: rows where `keep` holds; the bounds of the sample."""

    keep: Column
    docs: int = SAMPLE_DOCS
    passage: int = PASSAGE
    chars: int = SAMPLE_CHARS
    languages: int = MOST_LANGUAGES


def fit(docs: DataFrame, training: Training, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> ContextTrees:
    """Grow the trees from a sample whose size does not depend on the corpus."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.col(lang_column).alias("label"), training.keep.alias("keep"))
    return ContextTrees(labelled_passages(rows.where("keep"), training.docs, training.passage, training.chars, training.languages))


def identify(docs: DataFrame, trees: ContextTrees, text_column: str = "text") -> DataFrame:
    """All columns of docs, with lang_pred, score (0 to 1) and bits_per_byte of the best code."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trees)  # its size is bounded by the sample
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score, rate = predict(model.value, batch.column(at))
            columns = [*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(rate)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "bits_per_byte"])

    return docs.select(*names).mapInArrow(run, schema)


def predict(trees: ContextTrees, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and bits per byte of each text. The score is the posterior share of the best
    language when all are equally likely beforehand."""
    n = len(texts)
    pred, score, rate = [UND] * n, np.zeros(n), np.zeros(n)
    if not trees.languages or not n:
        return pred, score, rate
    bits, sizes = trees.code_lengths(texts)
    best = bits.argmin(axis=1)
    least = bits[np.arange(n), best]
    share = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
    for i, text in enumerate(texts):
        if sizes[i] and _LETTER.search(text.as_py()):
            pred[i], score[i], rate[i] = trees.languages[best[i]], share[i], least[i] / sizes[i]
    return pred, score, rate


def held_out(id_column: Column) -> Column:
    return id_hash_mod(id_column, 3) == 1


def reject_unknown(docs: DataFrame, trees: ContextTrees, lang_column: str = "lang") -> DataFrame:
    """The documents that are not `und`, in the same columns; where the language is null, the found one is filled in."""
    names = {c: unused(docs, f"own_{c}") for c in ("score", "lang_pred", "bits_per_byte")}
    back = {own: c for c, own in names.items() if c in docs.columns}
    scored = identify(docs.withColumnsRenamed(names), trees).where(F.col("lang_pred") != UND)
    lang = names.get(lang_column, lang_column)
    kept = [names.get(c, c) for c in docs.columns]
    return scored.select(*[F.coalesce(c, F.col("lang_pred")).alias(c) if c == lang else F.col(c) for c in kept]).withColumnsRenamed(back)
