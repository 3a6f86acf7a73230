"""Spliced files against a sequential replay."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from canopy.operators import splices


def replay(files, edits):
    """(changed, outcome) of edits made one by one."""
    texts, changed, outcome = {}, set(), {}
    for plan, file, content in files:
        texts.setdefault((plan, file), []).append(content)
    for plan in {e[0] for e in edits}:
        done, error = {}, (None, None)
        for _, file, seq, start, removed, inserted in sorted((e for e in edits if e[0] == plan), key=lambda e: (e[2], e[3], e[4], e[5] or "")):
            have = [t for t in texts.get((plan, file), []) if t is not None]
            if len(have) != 1:
                error = seq, "AMBIGUOUS" if have else "NOT_FOUND"
            elif start < 0 or removed < 0 or start + removed > len(have[0]):
                error = seq, "OUT_OF_RANGE"
            else:
                texts[plan, file] = [have[0][:start] + (inserted or have[0][:0]) + have[0][start + removed :]]
                done[file] = done.get(file, 0) + 1
                changed.add((plan, file))
                continue
            break
        hot = max(((n, f) for f, n in done.items()), default=(0, None), key=lambda x: (x[0], str(x[1])))
        outcome[plan] = (sum(done.values()), len(done), hot[1], hot[0], *error)
    return {k: texts[k][0] for k in changed}, outcome


def random_case(seed, errors):
    rng = random.Random(seed)
    plans = ["a", "b", None]
    files = [(p, f"f{i}", "".join(rng.choices("abcdé日🙂\n", k=rng.randint(0, 30)))) for p in plans for i in range(4)]
    sizes, edits = {(p, f): len(t) for p, f, t in files}, []
    for seq in range(400):
        plan = rng.choice(plans)
        file = "f0" if rng.random() < 0.5 else f"f{rng.randrange(4)}"
        size = sizes[plan, file]
        start = rng.randint(0, size)
        removed, inserted = rng.randint(0, min(6, size - start)), "".join(rng.choices("xyzü🙂", k=rng.randint(0, 4))) or None
        if errors and rng.random() < 0.004:
            start = size + 5
        else:
            sizes[plan, file] += len(inserted or "") - removed
        edits.append((plan, file, seq, start, removed, inserted))
    return files, edits


FILES, EDITS = "plan string, file string, content string", "plan string, file string, seq long, start long, removed long, inserted string"


def got(spark, files, edits, run=splices.RUN):
    changed, outcome = splices.splice(spark.createDataFrame(files, FILES).withColumn("rank", F.lit("clash")), spark.createDataFrame(edits, EDITS).withColumn("size", F.lit("clash")), run)
    return {(r["plan"], r["file"]): r["content"] for r in changed.collect()}, {r["plan"]: tuple(r)[1:] for r in outcome.collect()}


@pytest.mark.parametrize(("seed", "errors", "run"), [(1, False, 64), (2, True, 7), (3, True, 1)])
def test_splices_equal_a_sequential_replay(spark, seed, errors, run):
    files, edits = random_case(seed, errors)
    assert got(spark, files, edits, run) == replay(files, edits)


def test_a_hot_file_is_named_and_spread(spark):
    rng = random.Random(4)
    edits = [("p", "hot", i, rng.randint(0, 40), rng.randint(0, 3), "ab"[: rng.randint(1, 2)]) for i in range(3000)] + [("p", "cold", 5000, 0, 0, "x")]
    files = [("p", "hot", "z" * 6000), ("p", "cold", "")]
    changed, outcome = got(spark, files, edits)
    assert (changed, outcome) == replay(files, edits) and outcome["p"][2:4] == ("hot", 3000)


def test_splice_cases(spark):
    files = [("a", "x", "abc"), ("a", "x", "abc"), ("b", "n", None), ("c", None, "q"), (None, "y", ""), ("d", "k", "word")]
    edits = [("a", "x", 1, 0, 0, "!"), ("b", "n", 1, 0, 0, "!"), ("c", None, 1, 1, 0, "!"), (None, "y", 1, 0, 0, "new"), ("d", "k", 1, 0, 4, None), ("d", "none", 2, 0, 0, "x"), ("d", "k", 3, 0, 0, "never")]
    assert got(spark, files, edits) == replay(files, edits)
    assert got(spark, files, []) == ({}, {}) and got(spark, [], edits[:1]) == ({}, {"a": (0, 0, None, 0, 1, "NOT_FOUND")})
    raw = spark.createDataFrame([("p", "f", bytearray(b"\xff\x00abc"))], "plan string, file string, content binary")
    cut = spark.createDataFrame([("p", "f", 1, 1, 1, bytearray(b"\xfe\xe9")), ("p", "f", 2, 0, 1, None)], "plan string, file string, seq long, start long, removed long, inserted binary")
    assert bytes(splices.splice(raw, cut)[0].first()["content"]) == b"\xfe\xe9abc"
