"""Delete later copies of repeated line runs, by a suffix array over line ids.

Documents in order of doc_id are sequences of their lines that aren't blank. A run of consecutive lines with ``min_words``
words or more is repeated if it also occurs at an earlier place; every line of such a later copy is deleted, the first
copy stays. Words are runs of anything but white space (Unicode's: tabs and no-break spaces too), however wide the gaps
between them. Blank lines, those without a word, belong to no run and stay.

Lines that occur once cut every run, so only stretches of repeated lines of enough words become suffixes. Prefix doubling
ranks them by their first 1, 2, 4, ... lines: a round sorts the distinct pairs of ranks and numbers them in order. From a
line on, the shortest run of enough words spans at most ``min_words`` lines, so doubling ends there: order further on
can't change what repeats. Suffixes whose longest common prefix reaches that run form one interval of the suffix array
(told by the two ranks that together cover the run); all but its first suffix are later copies. Runs are taken forwards
from every line and backwards from every line, so that they cover a maximal repeated run up to both ends.

Rows: a null or empty text has no lines and comes back as it is. Rows that repeat doc_id and text are one document, with
one result; rows that repeat a doc_id only are ordered by a hash of the text. A null doc_id sorts first. An empty table
gives no rows. Other columns stay. All work is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import text as tx

MIN_WORDS = 50
DOC = ["d", "t"]  # the document: its id and a hash of its text
WORD = r"[^\x09-\x0D\x85\p{Z}]+"


def _key(docs: DataFrame) -> tuple[Column, Column]:
    return docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string"))


def _lines(docs: DataFrame) -> DataFrame:
    """Every line that isn't blank: its document, place, two hashes and number of words."""
    d, t = _key(docs)
    split = docs.select(d.alias("d"), t.alias("t"), F.posexplode(F.split(docs["text"].cast("string"), "\n", -1)).alias("i", "line"))
    words = F.regexp_count("line", F.lit(WORD))
    lines = split.select("d", "t", "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), words.alias("words"))
    return lines.where("words > 0")


def numbered(keys: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct rows with their place in sorted order, from 1 on: ranges are numbered on their own and then shifted by
    the rows before them (one row per range)."""
    dealt = materialise(keys.repartitionByRange(*columns).withColumn("_range", F.spark_partition_id()))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*columns))
    return materialise(dealt.withColumn(name, inside).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before"))


def _stretches(lines: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines in stretches of enough words: d, t, n (place among the document's lines), i, words, s (stretch), r0."""
    # Rows that repeat a document give each line twice; one goes before lines are numbered.
    within = Window.partitionBy(*DOC).orderBy("i")
    lines = lines.withColumn("_before", F.lag("i").over(within)).where("_before is null or _before < i").drop("_before")
    lines = materialise(lines.withColumn("n", F.row_number().over(within)))
    counts = materialise(lines.groupBy("h1", "h2").agg(F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    ids = numbered(counts, ["h1", "h2"], "r0")
    rows = lines.join(ids, ["h1", "h2"]).drop("h1", "h2")
    inside = Window.partitionBy(*DOC)
    rows = rows.withColumn("s", F.col("n") - F.row_number().over(inside.orderBy("n")))
    rows = rows.withColumn("_all", F.sum("words").over(Window.partitionBy(*DOC, "s")))
    return materialise(rows.where(F.col("_all") >= min_words).drop("_all"))


def _ranked(rows: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """Ranks r0, r1, ... of the suffix from each line by its first 1, 2, 4, ... lines, while 2^k <= depth."""
    along, k = Window.partitionBy(*DOC, "s").orderBy("n"), 0
    while 2 << k <= depth:
        pair = materialise(rows.withColumn("_next", F.coalesce(F.lead(f"r{k}", 1 << k).over(along), F.lit(0))))
        ranks = numbered(pair.select(f"r{k}", "_next").distinct(), [f"r{k}", "_next"], f"r{k + 1}")
        rows = materialise(pair.join(ranks, [f"r{k}", "_next"]).drop("_next"))
        k += 1
    return rows, k


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines to delete: d, t, i, distinct."""
    rows = _stretches(_lines(docs), min_words)
    rows, top = _ranked(rows, min_words)
    along = Window.partitionBy(*DOC, "s").orderBy("n")
    total = rows.withColumn("to", F.sum("words").over(along)).withColumn("from", F.col("to") - F.col("words"))
    ahead = F.collect_list("to").over(along.rowsBetween(0, min_words - 1))
    back = F.collect_list("from").over(along.rowsBetween(1 - min_words, 0))
    total = total.withColumn("ahead", ahead).withColumn("back", back)
    short_ahead = F.filter("ahead", lambda x: x - F.col("from") < min_words)
    short_back = F.filter("back", lambda x: F.col("to") - x < min_words)
    spans = F.array(
        F.when(F.size(short_ahead) < F.size("ahead"), F.struct(F.col("n").alias("n"), (F.size(short_ahead) + 1).alias("m"))),
        F.when(F.size(short_back) < F.size("back"), F.struct((F.col("n") - F.size(short_back)).alias("n"), (F.size(short_back) + 1).alias("m"))),
    )
    runs = total.select(*DOC, F.explode(F.array_distinct(F.array_compact(spans))).alias("run")).select(*DOC, "run.n", "run.m").distinct()
    level = F.least(F.floor(F.log2("m") + 1e-9).cast("int"), F.lit(top))
    runs = materialise(runs.withColumn("k", level))

    rank = F.array(*(F.col(f"r{k}").cast("long") for k in range(top + 1)))
    ranks = materialise(rows.select(*DOC, F.col("n").alias("place"), "i", rank.alias("ranks")))
    # The run's first and last 2^k lines together cover it.
    first = ranks.select(F.col("d").alias("d1"), F.col("t").alias("t1"), F.col("place").alias("p1"), F.col("i").alias("i1"), F.col("ranks").alias("ranks1"))
    runs = runs.join(first, F.col("d").eqNullSafe(F.col("d1")) & (F.col("t") == F.col("t1")) & (F.col("n") == F.col("p1"))).drop("d1", "t1", "p1")
    runs = runs.withColumn("a", F.col("ranks1")[F.col("k")]).drop("ranks1").withColumn("end", F.expr("n + m - shiftleft(1, k)"))
    last = ranks.select(F.col("d").alias("d1"), F.col("t").alias("t1"), F.col("place").alias("p1"), F.col("ranks").alias("ranks1"))
    runs = runs.join(last, F.col("d").eqNullSafe(F.col("d1")) & (F.col("t") == F.col("t1")) & (F.col("end") == F.col("p1"))).drop("d1", "t1", "p1")
    runs = materialise(runs.withColumn("b", F.col("ranks1")[F.col("k")]).select(*DOC, "n", "m", "a", "b"))
    place = F.struct(*DOC, "n")
    intervals = materialise(runs.groupBy("m", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("size")).where("size > 1").drop("size"))
    copies = runs.join(intervals, ["m", "a", "b"]).where(~place.eqNullSafe(F.col("first")))
    gone = copies.select(*DOC, F.explode(F.sequence(F.col("n"), F.col("n") + F.col("m") - 1)).alias("place")).distinct()
    at = ranks.select(F.col("d").alias("d1"), F.col("t").alias("t1"), F.col("place").alias("p1"), "i")
    gone = gone.join(at, F.col("d").eqNullSafe(F.col("d1")) & (F.col("t") == F.col("t1")) & (F.col("place") == F.col("p1")))
    return materialise(gone.select(*DOC, "i"))


def without_later_copies(docs: DataFrame, min_words: int = MIN_WORDS, deleted: str = "_deleted") -> DataFrame:
    """``docs`` with the later copies cut out of ``text``, and the number of lines deleted in column ``deleted``, which
    replaces one of that name."""
    cut_d, cut_t, cut_, cut_lines = (tx.spare(docs, name) for name in ("_cut_d", "_cut_t", "_cut", "_cut_lines"))
    cut = later_copies(docs, min_words).groupBy(F.col("d").alias(cut_d), F.col("t").alias(cut_t))
    cut = materialise(cut.agg(F.sort_array(F.collect_set("i")).alias(cut_)))
    d, t = _key(docs)
    # A merge join at every size: whether the table of cuts happens to fit a broadcast doesn't change the plan.
    out = docs.join(cut.hint("merge"), d.eqNullSafe(F.col(cut_d)) & (t == F.col(cut_t)), "left")
    # Split once per row: the generator keeps the lines out of the lambda below.
    split = F.when(F.col(cut_).isNotNull(), F.split(docs["text"].cast("string"), "\n", -1))
    out = out.select(*(docs[c] for c in docs.columns), cut_, F.explode(F.array(split)).alias(cut_lines))
    ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), cut_).alias("a"), F.concat(cut_, F.array(F.size(cut_lines))).alias("b"))
    stay = F.flatten(F.transform(ends, lambda z: F.slice(cut_lines, z["a"] + 2, z["b"] - z["a"] - 1)))
    text = F.when(F.col(cut_).isNull(), F.col("text").cast("string")).otherwise(F.array_join(stay, "\n"))
    kept = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c.lower() != deleted.lower()]
    return out.select(*kept, F.when(F.col(cut_).isNull(), 0).otherwise(F.size(cut_)).cast("long").alias(deleted))


def line_deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """As above; documents that lose all their lines go too."""
    name = tx.spare(docs, "_deleted")
    out = without_later_copies(docs, min_words, name)
    return out.where((F.col(name) == 0) | F.col("text").rlike(WORD)).drop(name)
