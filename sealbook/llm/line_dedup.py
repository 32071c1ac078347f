"""Line dedup by winnowing over line hashes, with DataFrame functions only.

A document is the sequence of its lines that hold a word. Of every window of ``min_lines`` lines the line with the
smallest hash (the last of equals) is selected; neighbouring windows mostly select the same line, and a position
selected several times is one row. Equal windows select the same line of theirs, so what repeats is found where selected
lines meet: positions whose line hash is selected nowhere else go no further. The others are extended by their
neighbouring lines to the left and to the right, as far as the windows that selected them reach. Equal extensions of all
documents meet under a 128-bit hash, the earliest stays and later ones are deleted; overlapping ones make up a run
of any length, which goes as a whole. On request a line of many words is a window by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealbook.llm.common import WORD, ids, outer_id
from sealbook.operators.durable import Scratch, durable
from sealbook.operators.skew import join_hot

#: A line counts when it holds more than separators.
HAS_WORD = r"[^\x20\x09-\x0D]"


def _many_words(line: Column, least: int) -> Column:
    """By a search that ends at that word; words have separators between them, so a short line is not searched."""
    return (F.length(line) >= 2 * least - 1) & line.rlike(rf"^(?:[\x20\x09-\x0D]*+{WORD}+){{{least}}}")


def _none() -> Column:
    return F.array().cast("array<int>")


def _lines(text: str) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _selected(docs: DataFrame, n: int, lone_words: int | None) -> DataFrame:
    """One row per selected position: ``first`` and ``last`` start of the windows that select it, their ``size``, where
    the position lies after ``first`` (``seat``), and the hashes of all lines of these windows (``around``)."""
    line = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))
    texts = docs.select(*ids(docs)).select("id", F.xxhash64("text").alias("h"), _lines("text").alias("lines"))
    counted = texts.select("id", "h", F.filter("lines", lambda x: x.rlike(HAS_WORD)).alias("lines"))
    lone = _none() if lone_words is None else F.filter(F.transform("lines", lambda x, k: F.when(_many_words(x, lone_words), k)), lambda k: k.isNotNull())
    hashed = counted.select("id", "h", F.transform("lines", line).alias("hashed"), lone.alias("lone"))
    starts = F.when(F.size("hashed") >= n, F.sequence(F.lit(0), F.size("hashed") - n)).otherwise(_none())

    def smallest(s: Column) -> Column:
        # Element by element: a slice within a lambda would copy the whole array each time.
        window = F.array(*(F.get("hashed", s + i)["a"] for i in range(n)))
        return s + n - F.array_position(F.reverse(window), F.array_min(window)).cast("int")

    # Windows that select one position follow each other, so each such stretch begins where the choice changes.
    chosen = hashed.withColumn("starts", starts).withColumn("chosen", F.transform("starts", smallest))
    stretches = chosen.withColumn("fresh", F.filter("starts", lambda s: (s == 0) | (F.get("chosen", s) != F.get("chosen", s - 1))))
    seeds = F.transform("fresh", lambda s, k: F.struct(
        s.alias("first"), (F.coalesce(F.get("fresh", k + 1), F.size("starts")) - 1).alias("last"), F.lit(n).alias("size"), (F.get("chosen", s) - s).alias("seat")))
    if lone_words is not None:
        seeds = F.concat(seeds, F.transform("lone", lambda k: F.struct(k.alias("first"), k.alias("last"), F.lit(1).alias("size"), F.lit(0).alias("seat"))))
    length = F.col("seed.last") - F.col("seed.first") + F.col("seed.size")
    # For an inner explode the optimizer would infer a filter on the array's size and compute all of the above in it once more.
    return (
        stretches.select("id", "h", "hashed", seeds.alias("seeds")).select("id", "h", "hashed", F.explode_outer("seeds").alias("seed")).filter("seed is not null")
        .select("id", "h", "seed.*", F.slice("hashed", F.col("seed.first") + 1, length).alias("around"))
    )


def _extended(seeds: DataFrame) -> DataFrame:
    """``place`` and ``window`` (size and 128-bit hash) of the selected lines taken with their neighbours on both sides."""
    one = F.slice("around", F.col("start") - F.col("first") + 1, F.col("size"))
    return (
        seeds.withColumn("start", F.explode(F.sequence("first", "last"))).select("id", "h", "start", "size", one.alias("w"))
        .select(F.struct("id", "h", "start").alias("place"), F.struct("size", F.xxhash64("w.a").alias("w1"), F.xxhash64(F.lit(7), "w.b").alias("w2")).alias("window"))
    )


def _deletions(docs: DataFrame, min_lines: int, lone_words: int | None) -> DataFrame:
    """``id``, ``h``, ``places``: start and size of the windows of each text that occur earlier."""
    with Scratch(docs.sparkSession) as scratch:
        seeds = scratch.keep(_selected(docs, min_lines, lone_words)).withColumn("fingerprint", F.get("around.a", F.col("seat")))
        met = seeds.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").withColumn("met", F.lit(True))
        common = join_hot(seeds, met, "fingerprint", F.struct("id", "h", "first"), "n").filter("met")
        windows = scratch.keep(_extended(common))
        first = windows.groupBy("window").agg(F.min("place").alias("earliest"), F.count("*").alias("n")).filter("n > 1")
        later = join_hot(windows, first, "window", F.col("place"), "n").filter("place > earliest")
        gone = F.sort_array(F.collect_set(F.struct("place.start", "window.size")))
        return durable(later.groupBy("place.id", "place.h").agg(gone.alias("places")))


def _cleaned(docs: DataFrame, min_lines: int, lone_words: int | None) -> DataFrame:
    """Every row with its positions of lines, those that go, and the text that stays. Lines are cut anew after the join.

    The deletions grow with the texts, so they are never broadcast, not even where they still happen to be few.
    """
    # Columns used within a lambda are named once more outside it, so that they are computed once per row and not per element.
    covered = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p["start"], p["start"] + p["size"] - 1))))
    gone = F.when(F.size("at") > 0, F.transform("covered", lambda k: F.get("at", k)))
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    left = F.transform(F.array_except(every, "gone"), lambda i: F.get("lines", i))
    return (
        docs.select(F.struct("*").alias("row"), *ids(docs)).select("row", "id", F.xxhash64("text").alias("h"))
        .join(_deletions(docs, min_lines, lone_words).hint("merge"), ["id", "h"], "left")
        .withColumn("text", F.col("row.text").cast("string"))
        .withColumn("lines", _lines("text"))
        .withColumn("marked", F.transform("lines", lambda x, i: F.when(x.rlike(HAS_WORD), i)))
        .withColumn("at", F.filter("marked", lambda i: i.isNotNull()))
        .withColumn("covered", covered)
        .withColumn("gone", F.coalesce(gone, _none()))
        .withColumn("clean", F.when(F.size("gone") > 0, F.array_join(left, "\n")).otherwise(F.col("text")))
    )


def without_repeated_runs(docs: DataFrame, min_lines: int = 2, lone_words: int | None = None) -> DataFrame:
    """The rows of ``docs`` with ``text`` rid of runs of lines that occur earlier.

    A line goes if a window of ``min_lines`` consecutive lines around it also starts earlier: in a document
    of smaller doc_id, or earlier in the same one. With ``lone_words`` a line of at least so many words also
    goes if that line alone occurs earlier, whatever its neighbours. Lines without a word are not part of windows and stay.
    Windows are judged on the input, not on what is left. Further columns are passed through.

    Null texts stay null; a text of one line, or fewer lines than a window, is unchanged. A null doc_id
    comes before all others. Identical rows are one place and lose the same lines; rows with one doc_id and
    different texts are ordered by a hash of the text. An empty table gives no rows.
    """
    columns = [F.col("clean").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return _cleaned(docs, min_lines, lone_words).select(*columns)


def line_dedup(docs: DataFrame, min_lines: int = 2, lone_words: int | None = None) -> DataFrame:
    """``doc_id``, ``n_lines`` (with a word), ``n_removed``, ``kept_text`` of every row; see `without_repeated_runs`."""
    return _cleaned(docs, min_lines, lone_words).select(
        outer_id(F.col("id")).alias("doc_id"), F.size("at").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"), F.col("clean").alias("kept_text"),
    )
