"""Personal data: patterns propose spans, validators confirm them, context words adjust the score.

Base kinds, leftmost and without overlap within a kind, a failing match being dropped and not retried:
email; ip (four parts, each at most 255); card (13 to 19 digits, Luhn); phone (9 to 15 digits after +).
Kinds that this method adds: iban (mod-97), secret (a named token, password or key), access_key (a cloud
key id), and, where a base match fails because it runs on into its neighbour, card_run (an unbroken run of
13 to 19 digits, Luhn) and phone_form (country code, area code in brackets, number). Every span has a score: its kind's prior, raised or lowered by words within
CONTEXT characters before or after it. Base spans always stay; added ones need MIN_SCORE.

Offsets are code points, the end exclusive. Cases: a null or empty text has no spans; texts of any length
are searched whole, in time that grows with their length; rows are searched one by one, so repeated rows
repeat the answer; an empty table gives no rows; other columns pass through, and of those named like a result the new
ones replace the old.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from canopy.llm.common import small_batches

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "access_key", "card_run", "phone_form")
CONTEXT = 48
MIN_SCORE = 0.5
#: What a kind is worth by itself, and the words near it that speak for or against it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "secret": 0.8, "access_key": 0.9, "card_run": 0.7, "phone_form": 0.7}
FOR = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "secret": ("secret", "token", "password", "key"),
    "access_key": ("aws", "key", "access", "secret"),
    "card_run": ("card", "visa", "credit", "payment", "pay"),
    "phone_form": ("phone", "call", "tel", "mobile", "fax"),
}
AGAINST = {
    "email": ("example",),
    "ip": ("version", "release", "section"),
    "card": ("isbn", "serial", "order", "invoice"),
    "phone": ("ratio", "score", "total"),
    "iban": ("sample", "serial"),
    "secret": ("example", "placeholder"),
    "access_key": ("example", "placeholder"),
    "card_run": ("isbn", "serial", "order", "invoice"),
    "phone_form": ("ratio", "score", "total"),
}

_WORDS = re.compile(r"[^\W\d_]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_WORD_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
_SECRET_NAME = re.compile(r"(?i:\b(?:token|secret|password|passwd|api[_-]?key))(?: ?[=:] ?(\")|=)")
_QUOTED = re.compile(r"[^\"\s]{8,}+(?=\")")
_UNQUOTED = re.compile(r"[^\s\",;]{8,}+")
_RUN = re.compile(r"[^\s\"]*+")
_CARD_RUN = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_PHONE_FORM = re.compile(r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ -][0-9]{3,4}(?![0-9])")
_ACCESS_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number's check digits hold: moved to the end, letters as numbers from 10, it is 1 modulo 97."""
    rest = 0
    for c in code[4:] + code[:4]:
        value = int(c, 36)
        rest = (rest * (100 if value > 9 else 10) + value) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The local part can only be the run of its letters that ends at an @, so look around each @."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = max(free, at + 1)  # nothing that starts before this @ can match any more
            at = text.find("@", at + 1)


def _digits_of(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in m[0].split("."))):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 13 <= len(digits := _digits_of(m[0])) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits_of(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest run of whole words from each start whose check digits hold."""
    at = 0
    while m := _IBAN.search(text, at):
        at = m.start() + 1
        for end in range(m.end(), m.start() + 14, -1):
            if _WORD_END.match(text, end) and 15 <= len(code := text[m.start() : end].replace(" ", "")) <= 34 and mod97(code):
                yield m.start(), end
                at = end
                break


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Values of any length; one without quotes needs a digit in the run up to the next space or quote."""
    at = run_end = last_digit = 0
    while m := _SECRET_NAME.search(text, at):
        at = m.end()
        if m[1]:
            value = _QUOTED.match(text, at)
        else:
            if at >= run_end:  # a run of many names is measured once
                run_end = _RUN.match(text, at).end()
                last_digit = max(text.rfind(d, at, run_end) for d in "0123456789")
            value = _UNQUOTED.match(text, at) if at <= last_digit else None
        if value:
            yield value.span()
            at = value.end()


_FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": emails,
    "ip": _ips,
    "card": _cards,
    "phone": _phones,
    "iban": _ibans,
    "secret": _secrets,
    "access_key": lambda text: (m.span() for m in _ACCESS_KEY.finditer(text)),
    "card_run": lambda text: (m.span() for m in _CARD_RUN.finditer(text) if luhn(m[0])),
    "phone_form": lambda text: (m.span() for m in _PHONE_FORM.finditer(text)),
}
#: Added kinds that only count outside the spans of a base kind.
_BEYOND = {"card_run": "card", "phone_form": "phone"}


def _near(text: str, start: int, end: int) -> set[str]:
    """Whole words within CONTEXT characters before and after a span."""
    low, high = max(0, start - CONTEXT), min(len(text), end + CONTEXT)
    while low and low < start and text[low - 1].isalpha():
        low += 1  # not a word that begins further off
    while high < len(text) and high > end and text[high].isalpha():
        high -= 1
    return {w.lower() for w in [*_WORDS.findall(text, low, start), *_WORDS.findall(text, end, high)]}


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = _near(text, start, end)
    raised = any(w in near for w in FOR[kind])
    lowered = any(w in near for w in AGAINST[kind])
    return min(1.0, max(0.0, PRIOR[kind] + 0.1 * raised - 0.3 * lowered))


def find(text: str | None) -> list[Span]:
    """All spans of a whole text, by kind (base kinds first) and start."""
    if not text:
        return []
    numbers = _DIGIT.search(text) is not None
    wanted = []
    if "@" in text:
        wanted.append("email")
    if numbers:
        wanted += ["ip", "card"]
        if "+" in text:
            wanted.append("phone")
        wanted.append("iban")
    if "=" in text or '"' in text:
        wanted.append("secret")
    if "AKIA" in text:
        wanted.append("access_key")
    if numbers:
        wanted += ["card_run", "phone_form"] if "+" in text else ["card_run"]
    out: list[Span] = []
    for kind in wanted:
        held = [(s.start, s.end) for s in out if s.kind == _BEYOND.get(kind)]
        for start, end in _FINDERS[kind](text):
            at = bisect_left(held, (end, 0))  # spans of a kind come in order and do not overlap
            if at and held[at - 1][1] > start:
                continue
            score = _score(text, kind, start, end)
            if kind in BASE or score >= MIN_SCORE:
                out.append(Span(kind, start, end, score))
    return out


def join(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None, spans: list[Span] | None = None) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the outer union
    takes the name of the first."""
    if not text:
        return text
    parts, at = [], 0
    for s in sorted(find(text) if spans is None else spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            parts += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    parts.append(text[at:])
    return "".join(parts)


_SPAN_TYPE = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
)
_SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of docs, with spans: array of kind, start, end, score."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array([[vars(s) for s in find(t)] for t in texts], _SPAN_ARROW)]

    return _map_texts(docs, text_column, [("spans", _SPAN_TYPE)], make)


def digests(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """All columns of docs, with counts of the base kinds, a digest of the base spans, all spans joined, their number, and
    their scores in the same order."""

    def make(texts: list[str | None]) -> list[pa.Array]:
        counts, base_sha, spans, every, scores = {k: [] for k in BASE}, [], [], [], []
        for found in map(find, texts):
            for kind in BASE:
                counts[kind].append(sum(s.kind == kind for s in found))
            base_sha.append(hashlib.sha256(join([s for s in found if s.kind in BASE]).encode()).hexdigest())
            spans.append(join(found))
            every.append(len(found))
            scores.append(",".join(f"{s.score:.2f}" for s in found))
        return [*(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(base_sha, pa.string()), pa.array(spans, pa.string()), pa.array(every, pa.int64()), pa.array(scores, pa.string())]

    added = [*((f"n_{k}", T.LongType()) for k in BASE), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("n_spans", T.LongType()), ("scores", T.StringType())]
    return _map_texts(docs, text_column, added, make)


def redacted(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The same columns, the text with its spans replaced and, if docs counts characters, n_chars anew."""
    small_batches(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [redact(t) for t in columns[at].to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names and text_column == "text":
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)


def _map_texts(docs: DataFrame, text_column: str, added: list[tuple[str, T.DataType]], make: Callable[[list[str | None]], list[pa.Array]]) -> DataFrame:
    small_batches(docs.sparkSession)
    new = [name for name, _ in added]
    names = [c for c in docs.columns if c not in new]
    schema = T.StructType([*docs.select(*names).schema.fields, *[T.StructField(n, t) for n, t in added]])
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make(batch.column(at).to_pylist())], names=[*names, *new])

    return docs.select(*names).mapInArrow(run, schema)
