"""Spelling variants of the words of a corpus: words one edit apart, found by shards of Aho-Corasick automata.

Words are runs of letters of whole texts, counted over all documents. Two words are near if they differ by exactly one
inserted, deleted or replaced code point. Cut in two, a word keeps one of its halves through such an edit: its head at offset
0 of the other word, or its tail at the other's end. So

1. every word deposits its two halves, as patterns, in the shards that the halves hash to;
2. every word is scanned by the automata of the shards that can hold a half which fits it (its own beginnings and
   ends of the lengths that halves of words of its length, one more and one less have: four shards at most);
3. an occurrence counts if its offset and the lengths fit (heads at 0, tails at the end, words at most one
   longer or shorter), and then the rests of both words are compared: they must be one edit apart.

A pair that meets by both halves counts once. A half that very many words share (a cell of CELL patterns or words holds no
more) is dealt over a grid of cells, in which every block of its patterns meets every block of the words to be scanned; in
a cell with many patterns of one half the rests are looked up by what is left of them without one code point instead
of one by one. Words, links and forms never leave the executors.

A word's form is its near word that occurs most, if it occurs twice as often at least; following forms leads to the root. As
counts double at each step, at most 60 steps are possible, and doubling the length of the steps takes 6 rounds.

Cases: null, empty and letterless texts have no words; a null doc_id counts as the empty text where it is hashed; words of
any length are compared whole; repeated rows count as often as they occur; an empty table gives no rows; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import checkpointed

#: Letters of a word, with those of A-Z in lower case; the least length and number of occurrences of a word.
LETTERS, LEAST_LENGTH, LEAST_COUNT = "a-zÀ-ÿ", 5, 3
#: One of so many (document, word) pairs loses a letter.
SLIPS = 97
#: Patterns, and words to scan, that a cell of a half has at most on average; and all rows of a shard.
CELL, SHARD_ROWS = 1 << 14, 1 << 15
#: Beyond so many patterns of one half, rests of up to so many code points are looked up.
FEW, LONG = 24, 48
#: Longer words are not scanned; what they begin and end with is looked up among the halves (automata take time with the
#: square of a word that repeats itself).
SCANNED = 128


def slipped(doc_id: Column, word: Column, slips: int = SLIPS) -> Column:
    """The word without one letter, in one of `slips` pairs of document and word (chosen by their crc32); else the word."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    return F.when(h % slips == 0, F.concat(F.substr(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def vocabulary(docs: DataFrame, slips: int = SLIPS, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words of docs (doc_id, text), as they are after slips."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = F.regexp_extract_all(F.translate("text", upper, upper.lower()), F.lit(f"[{LETTERS}]+"), F.lit(0))
    words = docs.select("doc_id", F.explode(F.filter(runs, lambda w: F.length(w) >= least_length)).alias("run"))
    words = words.select(slipped(F.col("doc_id"), F.col("run"), slips).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _halves(word: Column, length: Column) -> list[tuple[str, Column]]:
    """Beginning and end of a word as long as the halves of words of a length."""
    head = F.floor(length / 2).cast("int")
    tail = (length - head).cast("int")
    return [("h", F.substr(word, F.lit(1), head)), ("t", F.substr(word, F.length(word) - tail + 1, tail))]


def _routed(words: DataFrame, cell: int, shard_rows: int) -> DataFrame:
    """shard, word, n, half (of a pattern; null: a word to scan)."""
    word, length = F.col("word"), F.length("word")
    own = F.array(*[F.concat(F.lit(kind), half) for kind, half in _halves(word, length)])
    fits = F.array_distinct(F.array(*[F.concat(F.lit(kind), half) for n in (length - 1, length, length + 1) for kind, half in _halves(word, n)]))
    rows = words.select("word", "n", F.explode(own).alias("half"), F.lit(True).alias("pattern")).unionByName(words.select("word", "n", F.explode(fits).alias("half"), F.lit(False).alias("pattern")))
    # a half that no word has as its own is no pattern, and one that is only its own word's links nothing
    counts = rows.groupBy("half").agg(F.count_if("pattern").alias("patterns"), F.count_if(~F.col("pattern")).alias("scans")).where("patterns > 0 and scans > 1")
    across, down = (F.ceil(F.col(c) / cell).cast("int") for c in ("patterns", "scans"))
    counts = counts.select("half", across.alias("across"), down.alias("down"))
    met = rows.join(counts, "half")
    block = F.pmod(F.xxhash64("word"), F.when(F.col("pattern"), F.col("across")).otherwise(F.col("down"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("pattern"), F.col("down")).otherwise(F.col("across")) - 1)
    met = met.withColumn("block", block).withColumn("other", F.explode(others))
    met = met.withColumn("cell", F.when(F.col("pattern"), F.struct(F.col("block").alias("i"), F.col("other").alias("j"))).otherwise(F.struct(F.col("other").alias("i"), F.col("block").alias("j"))))
    met = checkpointed(met.select("word", "n", "half", "pattern", F.xxhash64("half", "cell").alias("cell")))
    shards = max(1, -(-met.count() // shard_rows))
    return met.select(F.pmod("cell", F.lit(shards)).alias("shard"), "cell", "word", "n", F.when(F.col("pattern"), F.col("half")).alias("half"))


def one_edit(a: str, b: str) -> bool:
    """Whether the two differ by exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # code points that both begin with
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low + 1 :] == b[low + 1 :] if len(a) == len(b) else a[low:] == b[low + 1 :]


class _Half:
    """The patterns of one half in one cell: rests of the words that have it."""

    def __init__(self, kind: str, half: str):
        self.kind, self.half = kind, half
        self.words: dict[int, list[tuple[str, str, int]]] = defaultdict(list)  # by the length of the word: rest, word, n
        self._left: dict[int, dict] = {}

    def add(self, word: str, n: int) -> None:
        self.words[len(word)].append((word[len(self.half) :] if self.kind == "h" else word[: len(word) - len(self.half)], word, n))

    def _without_one(self, length: int) -> dict[tuple[int, str], list[tuple[str, str, int]]]:
        """The words of a length by (place, rest without the code point there), and by (-1, rest), (-2, rest without any one)."""
        if length not in self._left:
            found = defaultdict(list)
            for entry in self.words[length]:
                rest = entry[0]
                found[-1, rest].append(entry)
                for i in range(len(rest)):
                    found[i, rest[:i] + rest[i + 1 :]].append(entry)
                for less in {rest[:i] + rest[i + 1 :] for i in range(len(rest))}:
                    found[-2, less].append(entry)
            self._left[length] = found
        return self._left[length]

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        size = len(word)
        rest = word[len(self.half) :] if self.kind == "h" else word[: size - len(self.half)]
        for length in (size - 1, size, size + 1):
            entries = self.words.get(length)
            if not entries:
                continue
            if len(entries) > FEW and len(rest) <= LONG:
                left = self._without_one(length)
                if length == size:
                    entries = [e for i in range(len(rest)) for e in left.get((i, rest[:i] + rest[i + 1 :]), ())]
                elif length < size:
                    entries = [e for less in {rest[:i] + rest[i + 1 :] for i in range(len(rest))} for e in left.get((-1, less), ())]
                else:
                    entries = left.get((-2, rest), ())
            for other, near, n in entries:
                if one_edit(rest, other):
                    yield near, n


def _occurrences(word: str, automaton: ahocorasick.Automaton, by_text: dict[str, list]) -> Iterator[tuple[int, int, list]]:
    """(begin, end, entry) of the halves that occur in a word."""
    size = len(word)
    if size <= SCANNED:
        if len(automaton):
            yield from ((stop + 1 - len(own[0][1].half), stop + 1, own) for stop, own in automaton.iter(word))
        return
    heads = {n // 2 for n in (size - 1, size, size + 1)}
    tails = {n - n // 2 for n in (size - 1, size, size + 1)}
    for begin, stop in {(0, n) for n in heads} | {(size - n, size) for n in tails}:
        if own := by_text.get(word[begin:stop]):
            yield begin, stop, own


def scan_shard(table: pa.Table) -> pa.Table:
    """word, near, n of all links of the words to scan with the patterns of a shard."""
    out: tuple[list[str], list[str], list[int]] = ([], [], [])
    automaton = ahocorasick.Automaton()
    halves: dict[str, dict[int, _Half]] = defaultdict(dict)
    scans: dict[str, set[int]] = defaultdict(set)
    for cell, word, n, half in zip(*(table.column(c).to_pylist() for c in ("cell", "word", "n", "half")), strict=True):
        if half is None:
            scans[word].add(cell)
        else:
            halves[half].setdefault(cell, _Half(half[0], half[1:])).add(word, n)
    by_text: dict[str, list[tuple[int, _Half]]] = defaultdict(list)
    for half, own in halves.items():
        by_text[half[1:]] += own.items()
    for text, own in by_text.items():
        if len(text) <= SCANNED // 2 + 1:
            automaton.add_word(text, own)
    automaton.make_automaton()
    for word, wanted in scans.items():
        for begin, stop, own in _occurrences(word, automaton, by_text):
            for cell, half in own:
                if cell not in wanted or (begin if half.kind == "h" else stop - len(word)):
                    continue
                for near, n in half.near(word):
                    # a pair that has met by its heads is not counted again by its tails
                    if half.kind == "h" or not word.startswith(near[: len(near) // 2]):
                        out[0].append(word)
                        out[1].append(near)
                        out[2].append(n)
    return pa.table({"word": pa.array(out[0], pa.string()), "near": pa.array(out[1], pa.string()), "n": pa.array(out[2], pa.int64())})


def links(words: DataFrame, cell: int = CELL, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """word, near, n (of near) for every two different words of `words` (word, n; no word twice) that are one edit
    apart, once each way."""
    return _routed(words, cell, shard_rows).groupBy("shard").applyInArrow(scan_shard, "word string, near string, n long")


def forms(words: DataFrame, found: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n."""
    best = found.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "n"), F.struct(-F.col("n"), F.col("near"))).alias("best"))
    takes = F.col("best.n") >= 2 * F.col("n")
    rows = words.join(best, "word", "left")
    return rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("best.near")).alias("form"), F.when(takes, F.col("best.n")).alias("form_n"))


def with_roots(rows: DataFrame) -> DataFrame:
    """All columns of rows (word, form and others), with root: the last word that following forms leads to."""
    steps = checkpointed(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = checkpointed(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = ahead.drop("moved")
        if ahead.where("moved").isEmpty():
            break
    return rows.join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def groups(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of the words of docs (doc_id, text)."""
    words = checkpointed(vocabulary(docs))
    return with_roots(checkpointed(forms(words, links(words))))
