"""Globs from a table, of any number: which of them match a part of a path.

Patterns are globs of one path component (functions.globs). They become a trie over their tokens, so that patterns which begin
alike are followed together; the distinct components of all paths, which are far fewer than paths, go through it, and what they
match is joined back. Tries are built for blocks of TRIE_BYTES of patterns, so that what tasks hold has a bound; no
component is compared with every pattern, and no table is crossed with another.

Cases: malformed patterns match nothing; null patterns and paths match nothing; patterns that are given twice count once; the
empty pattern matches the empty component; repeated paths are rows of their own; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.globs import glob_pattern
from canopy.operators.ordered import small
from canopy.plans.lineage import checkpointed

#: Bytes of the patterns of a trie.
TRIE_BYTES = 8 << 20
_STAR, _ANY, _END = "*", "?", ""


def tokens(glob: str) -> list[str] | None:
    """Stars, single characters (`?` for any, literals quoted by a backslash) and classes; None if malformed."""
    if glob_pattern(glob) is None:
        return None
    out, i = [], 0
    while i < len(glob):
        j = i + 1
        if glob[i] == "\\":
            j = i + 2
        elif glob[i] == "[":
            j = next(k + 1 for k in range(i + 2, len(glob)) if glob[k] == "]" and glob_pattern(glob[i : k + 1]) is not None)
        token = glob[i:j]
        if token in (_STAR, _ANY) or token[0] == "[":
            if token != _STAR or not out or out[-1] != _STAR:
                out.append(token)
        else:
            out.append("\\" + token[-1])
        i = j
    return out


class Trie:
    """Patterns by token. Node: literal -> node, and apart the edges of `?`, `*` and classes."""

    def __init__(self, patterns: list[str]):
        self.nodes: list[dict[str, int]] = [{}]
        self.special: list[list[tuple[str, re.Pattern | None, int]]] = [[]]
        self.ends: list[list[int]] = [[]]
        self.loops: list[bool] = [False]
        for number, glob in enumerate(patterns):
            at = 0
            parsed = tokens(glob)
            if parsed is None:
                continue
            for token in parsed:
                following = self.nodes[at].get(token)
                if following is None:
                    following = self.nodes[at][token] = len(self.nodes)
                    self.nodes.append({})
                    self.special.append([])
                    self.ends.append([])
                    self.loops.append(token == _STAR)
                    if token[0] != "\\":
                        self.special[at].append((token, re.compile(glob_pattern(token), re.DOTALL) if token[0] == "[" else None, following))
                at = following
            self.ends[at].append(number)

    def _closed(self, states: set[int]) -> set[int]:
        """With the states behind stars, which match nothing too."""
        todo, out = list(states), set(states)
        while todo:
            star = self.nodes[todo.pop()].get(_STAR)
            if star is not None and star not in out:
                out.add(star)
                todo.append(star)
        return out

    def match(self, name: str) -> list[int]:
        """Numbers of the patterns that match a whole name."""
        states = self._closed({0})
        for c in name:
            following = set()
            for s in states:
                if self.loops[s]:
                    following.add(s)
                literal = self.nodes[s].get("\\" + c)
                if literal is not None:
                    following.add(literal)
                for token, kind, to in self.special[s]:
                    if token == _ANY or (kind is not None and kind.fullmatch(c)):
                        following.add(to)
            states = self._closed(following)
            if not states:
                break
        return sorted(n for s in states for n in self.ends[s])


def matched_names(names: DataFrame, patterns: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """name, pattern of every distinct name (column name) and pattern (column pattern) that match."""
    spark = names.sparkSession
    patterns = checkpointed(patterns.where("pattern is not null").select("pattern").distinct())
    blocks = 1 + patterns.agg(F.coalesce(F.sum(F.octet_length("pattern") + 8), F.lit(0))).first()[0] // trie_bytes
    names = checkpointed(names.where("name is not null").select("name").distinct())
    found = None
    for block in range(blocks):
        own = [r["pattern"] for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).collect()]  # about trie_bytes
        shared = spark.sparkContext.broadcast((own, Trie(own)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            texts, trie = shared.value
            for batch in batches:
                pairs = [(name, texts[n]) for name in batch.column(0).to_pylist() for n in trie.match(name)]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["name", "pattern"])

        part = names.mapInArrow(run, "name string, pattern string")
        found = part if found is None else found.unionByName(part)
    return checkpointed(found)


def matching(paths: DataFrame, path: str, patterns: DataFrame, trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """All columns of paths, with patterns: those that match any part of the path, sorted."""
    names = [c for c in paths.columns if c != "patterns"]
    rows = checkpointed(paths.select(*names).withColumn("__row", F.monotonically_increasing_id()))
    parts = rows.select("__row", F.explode(F.array_distinct(F.split(path, "/"))).alias("name"))
    found = matched_names(parts, patterns, trie_bytes).groupBy("name").agg(F.collect_list("pattern").alias("own"))  # of one name
    hits = parts.join(small(checkpointed(found)), "name").groupBy("__row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("own")))).alias("patterns"))
    return rows.join(hits, "__row", "left").select(*names, F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"))
