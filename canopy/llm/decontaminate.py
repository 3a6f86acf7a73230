"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words of digits, letters a-z and anything beyond ASCII. A window
is WINDOW consecutive words of a benchmark item; an item with fewer words, but not none, is one window.
The hashed windows of the benchmark are broadcast as a hash set while they are at most BROADCAST_BYTES
large, and joined by a salted shuffle beyond that. Every window of every document is hashed in its row, and
what is probed is (document, place, hash) alone, so that work and exchange grow with the words of a text.
The few documents with matches are then read again and verified word for word.

Cases: null or wordless texts have no words, windows or hits and are clean; null item ids count as the
empty id; equal items count once per id; a document is identified by its id and text, so repeated rows and
repeated or null ids each get their row; texts of any length are searched whole; an empty table on either
side gives no hits; other columns are not looked at, and remove() keeps them whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm.common import checkpointed, unused

WINDOW = 10
#: Bytes of windows, or of matches, with their item ids, that are broadcast; more are shuffled, windows to SALTS places each.
BROADCAST_BYTES, SALTS = 64 << 20, 8
#: What separates words once A-Z are lower-cased.
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE_ROW = 0


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _SEPARATORS), "")


def _composed(rows: DataFrame, first: Column, lengths: list[int], joined: Callable[[Column, Column], Column], name: str) -> DataFrame:
    """rows (with words w) and for each length n a column name+n: what each run of n neighbours in `first` gives.

    Runs of 2, 4, 8 ... come from two runs of half the length, any other from those, so that a text costs a few
    passes. (A slice inside a lambda would copy the whole array for each element.)
    """
    rows, size = rows.withColumn(f"{name}_1", first), F.greatest(F.size("w"), F.lit(1))
    half = 1
    while 2 * half <= max(lengths, default=1):
        rows = rows.withColumn(f"{name}_{2 * half}", F.zip_with(f"{name}_{half}", F.slice(f"{name}_{half}", half + 1, size), joined))
        half *= 2
    for n in lengths:
        run, taken = None, 0
        for power in (p for p in (1 << k for k in range(n.bit_length(), -1, -1)) if n & p):
            run = F.col(f"{name}_{power}") if run is None else F.zip_with(run, F.slice(f"{name}_{power}", taken + 1, size), joined)
            taken += power
        rows = rows.withColumn(f"{name}{n}", F.slice(run, 1, F.greatest(F.size("w") - n + 1, F.lit(0))))
    return rows


def _hashed(rows: DataFrame, lengths: list[int]) -> DataFrame:
    return _composed(rows, F.transform("w", lambda x: F.xxhash64(x)), lengths, lambda a, b: F.xxhash64(a, b), "hash")


def _spelled(rows: DataFrame, lengths: list[int]) -> DataFrame:
    return _composed(rows, F.col("w"), lengths, lambda a, b: F.concat(a, F.lit(" "), b), "run")


def benchmark_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """win_hash, win_length, win_text and item_ids of each distinct window."""
    items = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("item"), words(F.col(text_column)).alias("w"))
    items = items.withColumn("length", F.least(F.lit(window), F.size("w")))
    lengths = [r["length"] for r in items.select("length").distinct().collect() if r["length"]]  # at most `window` rows
    runs = [items.where(F.lit(False)).select("item", "length", F.lit(0).cast("long").alias("win_hash"), F.lit("").alias("run"))]
    for n in lengths:
        both = _spelled(_hashed(items.where(F.col("length") == n), [n]), [n])
        each = both.select("item", "length", F.arrays_zip(F.col(f"hash{n}").alias("win_hash"), F.col(f"run{n}").alias("run")).alias("runs"))
        runs.append(each.select("item", "length", F.explode_outer("runs").alias("r")).select("item", "length", "r.win_hash", "r.run"))
    grouped = reduce(DataFrame.unionByName, runs).groupBy("length", "run").agg(F.first("win_hash").alias("win_hash"), F.collect_set("item").alias("item_ids"))
    return grouped.select("win_hash", F.col("length").alias("win_length"), F.col("run").alias("win_text"), "item_ids")


def _probed(rows: DataFrame, probes: DataFrame, lengths: list[int], small: bool, clean: bool) -> DataFrame:
    """Of rows (doc_id, doc_key, w): doc_id, doc_key, n_words, and of each window whose hash is among the probes start,
    win_length, win_text, item_ids; with `clean` also a row without them for every row."""
    hashed = _hashed(rows.withColumn("n_words", F.size("w")), lengths)
    hashes = F.concat(F.array(F.lit(_BASE_ROW).cast("long")), *[F.col(f"hash{n}") for n in lengths])
    hashed = hashed.select("doc_id", "doc_key", "n_words", hashes.alias("hashes"))
    # without `outer`, a filter would be inferred that computes all hashes once more
    placed = hashed.select("doc_id", "doc_key", "n_words", F.posexplode_outer("hashes").alias("place", "win_hash"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in probes.dtypes if c != "win_hash"]
    itself = probes.sparkSession.range(1).select(F.lit(_BASE_ROW).cast("long").alias("win_hash"), *nothing)
    # the place among all windows, less the windows of shorter lengths, is the position of the first word
    shift: Column = F.lit(1)
    start: Column = F.lit(None).cast("int")
    for n in lengths:
        start = F.when(F.col("win_length") == n, F.col("place") - shift).otherwise(start)
        shift = shift + F.greatest(F.col("n_words") - n + 1, F.lit(0))
    if small:
        met = placed.join(F.broadcast(probes.unionByName(itself) if clean else probes), "win_hash").where((F.col("place") == 0) == F.col("win_length").isNull())
    else:
        salt = F.pmod(F.xxhash64("doc_key", "place"), F.lit(SALTS)).cast("int")
        spread = probes.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        met = placed.where("place > 0").withColumn("salt", salt).join(spread, ["win_hash", "salt"]).drop("salt")
        if clean:
            met = met.unionByName(rows.select("doc_id", "doc_key", F.size("w").alias("n_words"), F.lit(0).alias("place"), F.lit(_BASE_ROW).cast("long").alias("win_hash"), *nothing))
    met = met.withColumn("start", start).where("win_length is null or (start >= 0 and start + win_length <= n_words)")
    return met.select("doc_id", "doc_key", "n_words", "start", "win_length", "win_text", "item_ids")


def _placed(runs: str, length: int) -> Column:
    return F.transform(runs, lambda x, i: F.struct(i.alias("start"), F.lit(length).alias("win_length"), x.alias("win_text")))


def _found(docs: DataFrame, benchmark: DataFrame, id_column: str, text_column: str, window: int, clean: bool) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, doc_key, n_words of every row if `clean`; doc_id, doc_key, hits, item_ids of each different document
    with hits; whether the latter are few enough to be broadcast)."""
    probes = checkpointed(benchmark_windows(benchmark, text_column=text_column, window=window))
    ids = F.aggregate("item_ids", F.lit(0), lambda n, x: n + F.octet_length(x) + 8)
    sizes = {r["win_length"]: r["n"] for r in probes.groupBy("win_length").agg(F.sum(F.octet_length("win_text") + ids + 40).alias("n")).collect()}  # at most `window` rows
    texts = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text_column).alias("doc_key"), F.col(text_column).alias("text"))
    rows = texts.select("doc_id", "doc_key", words(F.col("text")).alias("w"))
    met = checkpointed(_probed(rows, probes, sorted(sizes), sum(sizes.values()) <= BROADCAST_BYTES, clean))
    matches = met.where("start is not null").select(F.col("doc_id").alias("want_id"), F.col("doc_key").alias("want_key"), "start", "win_length", "win_text", "item_ids").distinct()
    few = matches.agg(F.coalesce(F.sum(F.octet_length("win_text") + ids + 64), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_BYTES
    share = F.broadcast if few else lambda df: df
    # the documents with matches are read again, and their runs compared with the windows as text
    keys = share(matches.select("want_id", "want_key").distinct())
    matched = texts.join(keys, texts["doc_id"].eqNullSafe(keys["want_id"]) & (texts["doc_key"] == keys["want_key"]), "left_semi")
    spelled = _spelled(matched.select("doc_id", "doc_key", words(F.col("text")).alias("w")), sorted(sizes))
    runs = [_placed(f"run{n}", n) for n in sizes]
    runs = F.concat(*runs) if runs else F.array().cast("array<struct<start:int,win_length:int,win_text:string>>")
    spelled = spelled.select("doc_id", "doc_key", F.explode_outer(runs).alias("r")).select("doc_id", "doc_key", "r.*")
    same = F.col("doc_id").eqNullSafe(F.col("want_id")) & (F.col("doc_key") == F.col("want_key"))
    real = spelled.join(share(matches.withColumnsRenamed({c: f"want_{c}" for c in ("start", "win_length", "win_text")})), same & (F.col("start") == F.col("want_start")) & (F.col("win_length") == F.col("want_win_length")) & (F.col("win_text") == F.col("want_win_text")))
    found = real.groupBy("doc_id", "doc_key").agg(F.collect_set(F.struct("start", "win_length")).alias("found"), F.collect_set("item_ids").alias("ids"))
    covered = F.flatten(F.transform("found", lambda m: F.sequence(m["start"], m["start"] + m["win_length"] - 1)))
    hit = found.select("doc_id", "doc_key", F.array_sort(F.array_distinct(covered)).alias("hits"), F.array_sort(F.array_distinct(F.flatten("ids"))).alias("item_ids"))
    return met.where("start is null").select("doc_id", "doc_key", F.col("n_words").cast("long").alias("n_words")), hit, few


def report(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, doc_key (hash of the text), n_words, hits (positions of hit words,
    ascending), item_ids (sorted as strings)."""
    base, hit, few = _found(docs, benchmark, id_column, text_column, window, True)
    hit = hit.withColumnsRenamed({"doc_id": "want_id", "doc_key": "want_key"})
    hit = F.broadcast(hit) if few else hit
    rows = base.join(hit, base["doc_id"].eqNullSafe(hit["want_id"]) & (base["doc_key"] == hit["want_key"]), "left")
    return rows.select("doc_id", "doc_key", "n_words", F.coalesce("hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def remove(docs: DataFrame, benchmark: DataFrame, policy: str = "document", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without their contamination, in the same columns: policy `document` drops contaminated
    documents, `span` cuts the hit words (with what separates them) out of the text."""
    if policy not in ("document", "span"):
        raise ValueError(f"unknown policy {policy!r}")
    _, hit, few = _found(docs, benchmark, id_column, text_column, WINDOW, False)
    own_id, own_key, runs = (unused(docs, c) for c in ("hit_id", "hit_key", "hit_runs"))
    firsts = F.filter("hits", lambda p, i: (i == 0) | (F.element_at("hits", F.greatest(i, F.lit(1))) != p - 1))
    lasts = F.filter("hits", lambda p, i: (i == F.size("hits") - 1) | (F.element_at("hits", F.least(i + 2, F.size("hits"))) != p + 1))
    edges = F.zip_with(firsts, lasts, lambda low, high: F.struct(low.alias("low"), high.alias("high")))
    bad = hit.select(F.col("doc_id").alias(own_id), F.col("doc_key").alias(own_key), *([edges.alias(runs)] if policy == "span" else []))
    bad = F.broadcast(bad) if few else bad
    same = docs[id_column].eqNullSafe(bad[own_id]) & (F.xxhash64(docs[text_column]) == bad[own_key])
    if policy == "document":
        return docs.join(bad, same, "left_anti")
    joined = docs.join(bad, same, "left")
    # words and separators alternate, so word w is part 2 w, and what follows it the next; one more if a separator leads
    parts, lead = (unused(joined, c) for c in ("hit_parts", "hit_lead"))
    cut_up = F.regexp_extract_all(F.col(text_column), F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    led = F.col(text_column).rlike(r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").cast("int")
    joined = joined.withColumns({parts: F.when(F.col(runs).isNotNull(), cut_up), lead: F.when(F.col(runs).isNotNull(), led)})
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: 2 * r["high"] + 2 + F.col(lead)))
    ends = F.concat(F.transform(runs, lambda r: 2 * r["low"] + F.col(lead)), F.array(F.size(parts)))
    kept = F.zip_with(begins, ends, lambda low, high: F.array_join(F.slice(parts, low + 1, F.greatest(high - low, F.lit(0))), ""))
    return joined.select(*[F.when(F.col(runs).isNotNull(), F.array_join(kept, "")).otherwise(F.col(c)).alias(c) if c == text_column else docs[c] for c in docs.columns])
