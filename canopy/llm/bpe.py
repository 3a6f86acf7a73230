"""BPE encoding and decoding by speculation and verification, for word-end vocabularies.

The vocabulary file (a parameter; never copied here) is a `tokenizers` JSON of the kind that drops white
space, lower-cases and marks word ends. Words that are new to a worker are encoded a vector at a time:

1. speculate: greedy longest match over rolling hashes proposes tokens for all new words at once;
2. verify: a sequence of tokens is what merging would give exactly if every token is what merging its
   own bytes gives and every adjacent pair is compatible, that is, merging the pair's bytes gives the
   pair. Compatibility of all distinct new pairs is decided together by walking back their merges;
3. only words with a failing pair are merged exactly, with a heap over a linked list.

Cases: a null or empty text has no tokens and decodes to the empty text; a text in which the strings of
special tokens occur gets their ids, as the library does; words of any length are encoded whole; rows
are encoded one by one, so repeated rows repeat the answer; an empty table gives no rows; other columns pass through,
and of those named like a result the new ones replace the old.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from canopy.llm.common import HashTable, small_batches, text_runs

#: Words whose counts a worker remembers; beyond it the memory is emptied, which costs time only.
CACHE_WORDS = 400_000
#: Words whose ids a worker remembers, half of them at least the last used; and the characters that it encodes at a time.
#: Workers outlive their tasks, and an executor keeps several beside its heap.
RECENT_WORDS, BLOCK_CHARS = 100_000, 1 << 18
#: Longer words skip the memory, so that its size stays bounded.
CACHE_WORD_CHARS = 64
#: Bytes of a word beyond which it is matched by itself, at all its places at once.
LONG_WORD = 256
#: The normaliser and pattern of the supported vocabularies. Others are refused.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The apostrophe endings that the vocabulary's pattern names, and the white space below U+0250.
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
_SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_LATIN_END = 0x250


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LATIN_END) if unicodedata.category(chr(c))[0] == kind)


#: The vocabulary's pattern with the classes spelled out for texts below U+0250. Letters come first, as no
#: other alternative starts with one. Other texts are cut by the library's own normaliser and pattern, which
#: know the Unicode version that the vocabulary is used with.
_FAST = re.compile(f"[{_latin('L')}]+|{_ENDINGS}|[{_latin('N')}]|[^{_SPACE}{_latin('L')}{_latin('N')}]+")
_NOT_LATIN = re.compile(f"[^\x00-{chr(_LATIN_END - 1)}]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable in Latin-1, else
    the next free one from U+0100."""
    spare = iter(range(256, 512))
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _check_supported(spec: dict) -> None:
    """An error for a vocabulary file with other rules than those that are built in here."""
    model, cuts = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    odd = [name for name in ("dropout", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(name)]
    odd += ["normalizer"] * (spec["normalizer"] != _NORMALIZER) + ["pre_tokenizer"] * (cuts != [split, level]) + ["decoder"] * bool(spec["decoder"])
    odd += [t["content"] for t in spec["added_tokens"] if any(t[name] for name in ("single_word", "lstrip", "rstrip", "normalized"))]
    if model["type"] != "BPE" or odd:
        raise ValueError(f"the vocabulary has rules that are not supported: {', '.join(odd) or model['type']}")


class WordBpe:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _check_supported(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._hint = os.path.commonprefix([*self.special])
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self._unletter = unletter = {c: b for b, c in enumerate(letters)}
        self._library = Tokenizer.from_file(path)
        size = max(self.names) + 1
        self.byte_ids = np.array([[vocab[c], vocab[c + self.end]] for c in letters])
        # merges: rank of the merge that makes a token, and its two parts
        self.rank = np.full(size, -1, np.int64)
        self.parts = np.full((size, 2), -1, np.int64)
        self.merge_of: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in merges):
            made = vocab[a + b]
            self.merge_of.setdefault((vocab[a], vocab[b]), (rank, made))
            if self.rank[made] < 0:
                self.rank[made], self.parts[made] = rank, (vocab[a], vocab[b])
        pairs = np.array([(a << 32) | b for a, b in self.merge_of], dtype=np.uint64)
        self._made = np.full(len(merges), -1, np.int64)
        for rank, made in self.merge_of.values():
            self._made[rank] = made
        self._never = np.iinfo(np.int64).max
        self._pair_table, self._pair_rank = HashTable(pairs), np.array([r for r, _ in self.merge_of.values()], dtype=np.int64)
        # tokens by rolling hash; `ends` tells which stand only at a word's end
        rng = np.random.default_rng(7)
        self._byte_hash = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._base, self._mark = np.uint64(0x5851F42D4C957F2D), np.uint64(0xD1342543DE82EF95)
        self._powers = np.ones(1, np.uint64)
        ids, hashes, lengths = [], [], []
        for token, i in vocab.items():
            ends = bool(self.end) and token.endswith(self.end)
            raw = bytes(unletter[c] for c in (token[: -len(self.end)] if ends else token))
            if raw and self.exact(raw, ends) == [i]:  # tokens that merging never makes are not proposed
                h = 0
                for b in reversed(raw):
                    h = (h * int(self._base) + int(self._byte_hash[b])) & 0xFFFFFFFFFFFFFFFF
                ids.append(i)
                hashes.append((h ^ int(self._mark)) if ends else h)
                lengths.append(len(raw))
        self._tokens, self._token_ids = HashTable(np.array(hashes, np.uint64)), np.array(ids, np.int64)
        self._lengths = sorted(set(lengths), reverse=True)
        self._known: dict[str, str] = {}
        self._older: dict[str, str] = {}
        self._counts: dict[str, int] = {}
        shown = [bytes(unletter[c] for c in (t.removesuffix(self.end) if i not in self.special.values() else "")) for i, t in sorted(self.names.items())]
        assert [*self.names] and sorted(self.names) == list(range(size))
        self._token_size = np.array([len(b) for b in shown], np.int64)
        self._token_start = np.cumsum(self._token_size) - self._token_size
        self._token_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self._digits = [str(i) for i in range(size)]
        self._shown = {str(i): self.names[i] for i in range(size)}

    # -- words ------------------------------------------------------------------------------------
    def words(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case goes letter by letter, without final forms
            lowered = text.lower()
            if _NOT_LATIN.search(text) or _NOT_LATIN.search(lowered):
                whole = self._library.normalizer.normalize_str(text)
                return [bytes(self._unletter[c] for c in piece).decode() for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(whole)]
            return _FAST.findall(lowered)
        return _FAST.findall(text.lower())

    # -- speculate and verify ---------------------------------------------------------------------
    def _inverse_powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers) < n + 1:
            n = max(n + 1, 1 << 16)
            self._powers = np.cumprod(np.r_[np.uint64(1), np.full(n, self._base)], dtype=np.uint64)
            inverse = np.uint64(pow(int(self._base), -1, 1 << 64))
            self._unpowers = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse)], dtype=np.uint64)
        return self._powers, self._unpowers

    def propose(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: token ids one after the other, and each word's count."""
        short = [i for i, r in enumerate(raws) if len(r) <= LONG_WORD]
        if len(short) == len(raws):
            return self._propose_together(raws)
        found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raws)
        if short:
            ids, counts = self._propose_together([raws[i] for i in short])
            for i, own in zip(short, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                found[i] = own
        for i, raw in enumerate(raws):
            if len(raw) > LONG_WORD:
                found[i] = self._propose_alone(raw)
        return np.concatenate(found), np.array([len(x) for x in found])

    def _propose_alone(self, raw: bytes, block: int = 1 << 16) -> np.ndarray:
        """The same for one long word: the longest match at every place, a block of places at a time, then the chain of
        matches from the first place on."""
        data = np.frombuffer(raw, np.uint8)
        powers, unpowers = self._inverse_powers(len(data))
        sums = np.r_[np.uint64(0), np.cumsum(self._byte_hash[data] * powers[: len(data)], dtype=np.uint64)]
        got, taken = np.full(len(data), -1, np.int64), np.zeros(len(data), np.int64)
        for low in range(0, len(data), block):
            left = np.arange(low, min(low + block, len(data)))
            for length in self._lengths:
                at = left[left + length <= len(data)]
                h = (sums[at + length] - sums[at]) * unpowers[at]
                hit = self._tokens.lookup(np.where(at + length == len(data), h ^ self._mark, h))
                ok = hit >= 0
                got[at[ok]], taken[at[ok]] = self._token_ids[hit[ok]], length
                left = left[got[left] < 0]
        steps, chain, at = taken.tolist(), [], 0
        while at < len(steps):
            chain.append(at)
            at += steps[at]
        return got[chain]

    def _propose_together(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(r) for r in raws], np.int64)
        data = np.frombuffer(b"".join(raws), np.uint8)
        powers, unpowers = self._inverse_powers(len(data))
        sums = np.r_[np.uint64(0), np.cumsum(self._byte_hash[data] * powers[: len(data)], dtype=np.uint64)]
        stops = np.cumsum(sizes)
        at, word = stops - sizes, np.arange(len(raws))
        found_words, found_ids = [], []
        while len(at):
            stop = stops[word]
            got, taken = np.full(len(at), -1, np.int64), np.zeros(len(at), np.int64)
            for length in self._lengths:
                rows = np.flatnonzero((got < 0) & (at + length <= stop))
                if not len(rows):
                    continue
                a = at[rows]
                h = (sums[a + length] - sums[a]) * unpowers[a]
                h = np.where(a + length == stop[rows], h ^ self._mark, h)
                hit = self._tokens.lookup(h)
                ok = hit >= 0
                got[rows[ok]], taken[rows[ok]] = self._token_ids[hit[ok]], length
            found_words.append(word)
            found_ids.append(got)
            at = at + taken
            left = at < stop
            at, word = at[left], word[left]
        words, ids = np.concatenate(found_words), np.concatenate(found_ids)
        order = np.argsort(words, kind="stable")
        return ids[order], np.bincount(words, minlength=len(raws))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of each pair of tokens gives just that pair.

        The last merge across the border would have to join a suffix of the left token with a prefix of
        the right one, before either is used up by its own later merges; so walk back the later of the
        two last merges, and see whether a merge of the parts at the border would come earlier.
        """
        a, b = left.copy(), right.copy()
        bound = np.full(len(a), np.iinfo(np.int64).max)  # rank below which a merge across comes first
        ties = np.zeros(len(a), bool)  # whether a merge of the same rank, being further left, comes first
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = self._pair_table.lookup((x.astype(np.uint64) << np.uint64(32)) | y.astype(np.uint64))
            rank = np.where(at >= 0, self._pair_rank[np.maximum(at, 0)], np.iinfo(np.int64).max)
            broken = (at >= 0) & ((rank < bound[live]) | ((rank == bound[live]) & ties[live]))
            out[live[broken]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~broken & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[on], x[on], y[on], rx[on], ry[on]
            # equal ranks: the left one is merged first, so the right one is undone first
            undo_left = rx > ry
            a[live[undo_left]] = self.parts[x[undo_left], 1]
            b[live[~undo_left]] = self.parts[y[~undo_left], 0]
            bound[live] = np.maximum(rx, ry)
            ties[live] = ~undo_left
        return out

    def exact(self, raw: bytes, ends: bool = True) -> list[int]:
        """Merge pairs, the lowest rank first and the leftmost of equals."""
        n = len(raw)
        ids = [int(self.byte_ids[b, 0]) for b in raw]
        if ends:
            ids[-1] = int(self.byte_ids[raw[-1], 1])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merge_of.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], alive[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if m := self.merge_of.get((made, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, made, ids[after[i]], m[1]))
            if (p := before[i]) >= 0 and (m := self.merge_of.get((ids[p], made))):
                heapq.heappush(heap, (m[0], p, ids[p], made, m[1]))
        return [ids[i] for i in range(n) if alive[i]]

    def exact_many(self, raws: list[bytes]) -> list[list[int]]:
        """exact() for many words, one merge of every word at a time; long words go one by one."""
        out: list[list[int]] = [[]] * len(raws)
        sizes = np.array([len(r) for r in raws])
        for low, high in ((0, 8), (8, 16), (16, 32)):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(own):
                for w, ids in zip(own.tolist(), self._merge_rows([raws[w] for w in own], sizes[own]), strict=True):
                    out[w] = ids
        for w in np.flatnonzero(sizes > 32).tolist():
            out[w] = self.exact(raws[w])
        return out

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        at = self._pair_table.lookup((np.maximum(left, 0).astype(np.uint64) << np.uint64(32)) | np.maximum(right, 0).astype(np.uint64))
        return np.where((at >= 0) & (left >= 0) & (right >= 0), self._pair_rank[np.maximum(at, 0)], self._never)

    def _merge_rows(self, raws: list[bytes], sizes: np.ndarray) -> Iterator[list[int]]:
        width = int(sizes.max())
        columns = np.arange(width)
        ids = np.full((len(raws), width + 1), -1, np.int64)
        ids[:, :width][columns < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(raws), np.uint8), 0]
        rows = np.arange(len(raws))
        ids[rows, sizes - 1] = self.byte_ids[[r[-1] for r in raws], 1]
        done = ids.copy()
        ranks = self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(raws), width)
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of the lowest
            least = ranks[np.arange(len(rows)), at]
            over = least == self._never
            if over.any():
                done[rows[over]] = ids[over]
                rows, ids, ranks, at, least = rows[~over], ids[~over], ranks[~over], at[~over], least[~over]
                if not len(rows):
                    break
            lines = np.arange(len(rows))
            late = columns > at[:, None]
            ids[:, :-1] = np.where(late, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ids[lines, at] = self._made[least]
            ranks[:, :-1] = np.where(late[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = self._never
            ranks[lines, at] = self._pair_ranks(ids[lines, at], ids[lines, at + 1])
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1] = self._pair_ranks(ids[back, at[back] - 1], ids[back, at[back]])
        counts = (done >= 0).sum(axis=1).tolist()
        return (row[:n] for row, n in zip(done.tolist(), counts, strict=True))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        if not words:
            return []
        raws = [w.encode() for w in words]
        ids, counts = self.propose(raws)
        ends = np.cumsum(counts)
        within = np.ones(len(ids), bool)
        within[ends - 1] = False
        first = np.flatnonzero(within)
        bad_word = np.zeros(len(words), bool)
        word_of = np.repeat(np.arange(len(words)), counts)
        if len(first):
            pairs, at = np.unique((ids[first] << 32) | ids[first + 1], return_inverse=True)
            bad_word[word_of[first[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[at]]]] = True
        # the proposed tokens must spell the word, whatever their hashes say
        sizes = self._token_size[ids]
        begins = np.cumsum(sizes) - sizes
        spelled = self._token_bytes[np.arange(sizes.sum()) + np.repeat(self._token_start[ids] - begins, sizes)]
        wrong = np.flatnonzero(spelled != np.frombuffer(b"".join(raws), np.uint8))
        bad_word[word_of[np.searchsorted(begins, wrong, side="right") - 1]] = True
        bad = np.flatnonzero(bad_word).tolist()
        flat, lows = ids.tolist(), (ends - counts).tolist()
        out = [flat[low:high] for low, high in zip(lows, ends.tolist(), strict=True)]
        for w, merged in zip(bad, self.exact_many([raws[w] for w in bad]), strict=True):
            out[w] = merged
        return out

    def learn(self, words: set[str]) -> dict[str, str]:
        """The ids of each word as text, through the worker's memory: what is asked for again comes into its newer half, which
        becomes the older half when it is full."""
        if len(self._known) > RECENT_WORDS // 2:
            self._known, self._older = {}, self._known
        known, older, digits = self._known, self._older, self._digits
        new = [w for w in words if w not in known]
        known.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in older]
        long: dict[str, str] = {}
        for word, ids in zip(new, self.encode_words(new), strict=True):
            (known if len(word) <= CACHE_WORD_CHARS else long)[word] = " ".join([digits[i] for i in ids])
        return known | long if long else known

    def decode(self, ids: str) -> str:
        """The text that ids, as text, stand for: the strings of all tokens, special ones too, joined as the vocabulary
        file (which names no decoder) has it."""
        return " ".join(map(self._shown.__getitem__, ids.split(" "))) if ids else ""

    # -- texts ------------------------------------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        """Words and special strings of a whole text, in order; special ones are looked up by themselves."""
        if self._cut and self._hint in text:
            out: list[str] = []
            for i, part in enumerate(self._cut.split(text)):
                out += ["\0" + part] if i % 2 else self.words(part)
            return out
        return self.words(text)

    @staticmethod
    def _blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
        low = 0
        while low < len(texts):
            high, size = low, 0
            while high < len(texts) and (high == low or size < BLOCK_CHARS):
                size += len(texts[high] or "")
                high += 1
            yield texts[low:high]
            low = high

    def encode(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of tokens, ids joined by spaces, decoded text) of each whole text."""
        for block in self._blocks(texts):
            yield from self._encode_some(block)

    def _encode_some(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        collecting = gc.isenabled()
        gc.disable()  # millions of small strings and no cycles: the collector would only walk them
        try:
            cut = [self.pieces(t) if t else [] for t in texts]
            words = set().union(*cut)
            marked = {"\0" + name: str(i) for name, i in self.special.items()} if any(w[0] == "\0" for w in words) else {}
            known = self.learn(words.difference(marked))
            if marked:
                known = known | marked
            out = []
            for ws in cut:
                ids = " ".join([known[w] for w in ws])
                out.append((ids.count(" ") + 1 if ids else 0, ids, self.decode(ids)))
            return out
        finally:
            if collecting:
                gc.enable()

    def count(self, texts: list[str | None]) -> Iterator[int]:
        """The number of tokens of each whole text, by those of its words."""
        for block in self._blocks(texts):
            cut = [self.pieces(t) if t else [] for t in block]
            if len(self._counts) > CACHE_WORDS:
                self._counts = {}
            known, long = self._counts, {}
            new = [w for w in set().union(*cut) if w not in known]
            plain = [w for w in new if w[0] != "\0" or w[1:] not in self.special]
            for word, ids in zip(plain, self.encode_words(plain), strict=True):
                (known if len(word) <= CACHE_WORD_CHARS else long)[word] = len(ids)
            known = known | long | {w: 1 for w in set(new).difference(plain)} if long or len(plain) < len(new) else known
            yield from (sum(map(known.__getitem__, words)) for words in cut)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """The worker's encoder of a vocabulary file."""
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _extend(docs: DataFrame, added: list[tuple[str, T.DataType]], make, text_column: str) -> DataFrame:
    """Append columns that make(texts) gives as arrays; columns of those names are replaced."""
    small_batches(docs.sparkSession)
    new = [name for name, _ in added]
    names = [c for c in docs.columns if c not in new]
    schema = T.StructType([*docs.select(*names).schema.fields, *[T.StructField(n, t) for n, t in added]])
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, n in text_runs(batch.column(at), BLOCK_CHARS):  # ids and decoded texts take many times the texts' memory
                part = batch.slice(low, n)
                yield pa.RecordBatch.from_arrays([*part.columns, *make(part.column(at).to_pylist())], names=[*names, *new])

    return docs.select(*names).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: str, text_column: str = "text") -> DataFrame:
    """All columns of docs, with n_tokens, token_ids (array<int>) and decoded (the ids decoded again)."""

    def make(texts):
        rows = list(encoder(vocabulary).encode(texts))
        ids = np.fromstring(" ".join([r[1] for r in rows if r[1]]), np.int32, sep=" ")
        counts = np.array([r[0] for r in rows], np.int64)
        offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
        return [pa.array(counts), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array([r[2] for r in rows], pa.string())]

    return _extend(docs, [("n_tokens", T.LongType()), ("token_ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType())], make, text_column)


def digests(docs: DataFrame, vocabulary: str, text_column: str = "text") -> DataFrame:
    """All columns of docs, with n_tokens, ids_sha256 and decoded_sha256: what encode() gives, digested
    where it is made so that ids and decoded texts do not travel."""

    def make(texts):
        rows = [(n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for n, ids, text in encoder(vocabulary).encode(texts)]
        counts, ids, decoded = zip(*rows, strict=True) if rows else ((), (), ())
        return [pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return _extend(docs, [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())], make, text_column)


def lengths(docs: DataFrame, vocabulary: str, text_column: str = "text") -> DataFrame:
    """All columns of docs, with n_tokens."""
    return _extend(docs, [("n_tokens", T.LongType())], lambda texts: [pa.array(list(encoder(vocabulary).count(texts)), pa.int64())], text_column)


def decode(ids: list[int], vocabulary: str) -> str:
    """The text that a list of ids stands for; ids that the vocabulary does not have stand for nothing."""
    own = encoder(vocabulary)
    return own.decode(" ".join(str(i) for i in ids if i in own.names))
