"""Ordered edits of many files: grouped by file, with offsets rebased, as piece tables in expressions.

An edit replaces `removed` units from `start` on by `inserted`, in what the edits before it have left of its file (units are
code points of a string, bytes of binary content). A plan is a list of edits by seq over any of its files; it stops
at its first edit that cannot be made, and what came before stays.

Only offsets make edits of one file depend on each other, and lengths are enough for them: running sums by blocks
(operators.ordered) tell how long a file is at every edit, so every edit is checked without any text and a plan's first error
is a minimum. The edits that remain are cut into runs of RUN edits of one file; each run by itself becomes a piece table,
that is ranges of the text before the run and of what it inserts. Runs are spread over all tasks, whatever the file is. Only
then do the texts come in: the tables of a file are laid over its content, one after the other, each in time that
is linear in the text. So files and not plans are the groups, and the outcome names the file of a plan with most edits.

Cases: null plans and files are values like others; a file that is not there, or there twice, null numbers, and ranges that
reach outside are errors; edits of equal seq go by start, removed, inserted; a null insertion is empty; null contents are files
that are not there; files without edits have no row in the result; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.operators.ordered import joined, running_sums, small
from canopy.plans.lineage import checkpointed

#: Edits of a file that become one piece table.
RUN = 64
FILE, ORDER = ["plan", "file"], ["seq", "start", "removed", "inserted"]


def _checked(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with size (of their file), files (that have their name), before (units gained by earlier edits), rank, error."""
    sizes = files.groupBy(*FILE).agg(F.max(F.length("content")).alias("size"), F.count("*").alias("files"))
    gain = F.length("inserted") - F.col("removed")
    rows = running_sums(edits, FILE, ORDER, {"gained": F.coalesce(gain, F.lit(0)), "rank": F.lit(1)})
    rows = joined(rows, sizes, FILE, "left").withColumn("before", F.col("gained") - F.coalesce(gain, F.lit(0)))
    fits = (F.col("start") >= 0) & (F.col("removed") >= 0) & (F.col("start") + F.col("removed") <= F.col("size") + F.col("before"))
    error = F.when(F.col("size").isNull(), "NOT_FOUND").when(F.col("files") > 1, "AMBIGUOUS").when(~F.coalesce(fits, F.lit(False)) | F.col("seq").isNull(), "OUT_OF_RANGE")
    return checkpointed(rows.withColumn("error", error))


def pieces(edits: Column, size: Column) -> Column:
    """The piece table of edits (start, removed, inserted; in order) over a text of a size: ranges (at: where it goes, start,
    n) of the text before, or of `text` if that is not null."""
    kind = "array<struct<at:bigint,start:bigint,n:bigint,text:string>>"

    def split(table: Column, e: Column) -> Column:
        added, stop = F.length(e["inserted"]).cast("long"), e["start"] + e["removed"]
        left = F.transform(
            F.filter(table, lambda p: p["at"] < e["start"]),
            lambda p: F.struct(p["at"].alias("at"), p["start"].alias("start"), F.least(p["n"], e["start"] - p["at"]).alias("n"), p["text"].alias("text")),
        )
        new = F.filter(F.array(F.struct(e["start"].alias("at"), F.lit(0).cast("long").alias("start"), added.alias("n"), e["inserted"].alias("text"))), lambda p: p["n"] > 0)

        def later(p: Column) -> Column:
            cut = F.greatest(stop - p["at"], F.lit(0).cast("long"))
            return F.struct((p["at"] + cut - e["removed"] + added).alias("at"), (p["start"] + cut).alias("start"), (p["n"] - cut).alias("n"), p["text"].alias("text"))

        right = F.transform(F.filter(table, lambda p: p["at"] + p["n"] > stop), later)
        return F.concat(left, new, right).cast(kind)

    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("start"), size.cast("long").alias("n"), F.lit(None).cast("string").alias("text")))
    return F.aggregate(edits, whole.cast(kind), split)


def _laid(content: Column, tables: Column, kind: T.DataType) -> Column:
    """Content with piece tables laid over it in order. Texts are cut as bytes of one width, where cutting takes no search."""
    text = isinstance(kind, T.StringType)
    width, bytes_of = (4, lambda c: F.encode(c, "UTF-32")) if text else (1, lambda c: F.encode(c, "ISO-8859-1"))

    def lay(done: Column, table: Column) -> Column:
        part = lambda p: F.substring(F.coalesce(bytes_of(p["text"]), done), (p["start"] * width + 1).cast("int"), (p["n"] * width).cast("int"))
        return F.encode(F.array_join(F.transform(table["pieces"], lambda p: F.decode(part(p), "ISO-8859-1")), ""), "ISO-8859-1")

    out = F.aggregate(tables, F.encode(content, "UTF-32") if text else content, lay)
    return F.decode(out, "UTF-32") if text else out


def splice(files: DataFrame, edits: DataFrame, run: int = RUN) -> tuple[DataFrame, DataFrame]:
    """(plan, file, content of the changed files; outcome of each plan: n_edits and n_files that were made, hot_file and hot_edits,
    failed_seq and error of the edit at which it stopped). files: plan, file, content (string or binary); edits: plan, file,
    seq, start, removed, inserted (of the content's type)."""
    kind = files.schema["content"].dataType
    inserted = F.coalesce(F.col("inserted"), F.lit("")) if isinstance(kind, T.StringType) else F.decode(F.coalesce(F.col("inserted"), F.lit(b"")), "ISO-8859-1")
    files = files.select(*FILE, "content").where(F.col("content").isNotNull())
    edits = edits.select(*FILE, *[F.col(c).cast("long").alias(c) for c in ORDER[:3]], inserted.alias("inserted"))
    checked = _checked(files, edits)
    place = F.struct(*ORDER)
    stops = checkpointed(checked.where("error is not null").groupBy("plan").agg(F.min(place).alias("stop"), F.min_by("error", place).alias("error")))
    made = joined(checked.drop("error"), small(stops.drop("error")), ["plan"], "left").where(F.col("stop").isNull() | (place < F.col("stop")))
    made = made.withColumn("run", F.floor((F.col("rank") - 1) / run))
    step = F.struct("rank", "start", "removed", "inserted")
    runs = made.groupBy(*FILE, "run").agg(F.array_sort(F.collect_list(step)).alias("edits"), F.min_by(F.col("size") + F.col("before"), "rank").alias("size"))  # at most `run` edits
    runs = checkpointed(runs.select(*FILE, "run", pieces(F.col("edits"), F.col("size")).alias("pieces"), F.size("edits").alias("n")))
    tables = runs.groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("run", "pieces"))).alias("tables"))
    changed = joined(files, tables, FILE).select(*FILE, _laid(F.col("content"), F.col("tables"), kind).alias("content"))
    counts = runs.groupBy(*FILE).agg(F.sum("n").alias("n"))
    done = counts.groupBy("plan").agg(F.sum("n").alias("n_edits"), F.count("*").alias("n_files"), F.max_by("file", F.struct("n", "file")).alias("hot_file"), F.max("n").alias("hot_edits"))
    plans = edits.select("plan").distinct()
    outcome = joined(joined(plans, done, ["plan"], "left"), stops, ["plan"], "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("long").alias(name)
    return changed, outcome.select("plan", zero("n_edits"), zero("n_files"), "hot_file", zero("hot_edits"), F.col("stop.seq").alias("failed_seq"), "error")
