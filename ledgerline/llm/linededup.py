"""Removal of repeated line runs, in DataFrame operations only.

The corpus is a sequence of line numbers, broken where documents end. Distributed prefix doubling ranks its suffixes by
their first 1, 2, 4, ... lines: a round looks a power of two ahead inside the document, sorts the distinct pairs of
ranks by range partitioning, and numbers them in that order. Ranks of two overlapping powers of two name the interval
of suffixes with a common prefix of any length between, so each interval deep enough to hold ``min_words`` words shows
its earliest suffix, and the same run at every later place is deleted. Suffixes that share nothing drop out at once:
lines that occur once, stretches too short, pairs that occur once.

What is deleted: a line goes if, and only if, it lies in a run of whole lines with at least ``min_words`` words that
also starts at an earlier place of the corpus, places being ordered by document and line. Lines without words don't
count, and go where the lines with words on both sides of them go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, quoted, table, without

WORD = "[^ \\t\\n\\x0B\\f\\r]+"
PLACE = ("d", "th")


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line with words: document (key and hash of its text), j among such lines, i among all, two hashes, words."""
    numbered = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line"), F.regexp_count(line, F.lit(WORD)).cast("long").alias("w")))
    rows = docs.select(F.col(key).alias("d"), F.xxhash64(text).alias("th"), F.posexplode(F.filter(numbered, lambda x: x["w"] > 0)).alias("j", "x"))
    return rows.select(*PLACE, "j", "x.i", F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(7), "x.line").alias("h2"), "x.w")


def _numbered(pairs: DataFrame, first: str, second: str, rank: str) -> DataFrame:
    """Distinct pairs with numbers that have their order.

    Sorted distinct pairs are numbered alike when a task runs again. Range partitioning also keeps the join that follows
    apart from what made the pairs, so a line or pair that is very common is a skewed partition that AQE can split.
    """
    return pairs.repartitionByRange(first, second).sortWithinPartitions(first, second).select(first, second, F.monotonically_increasing_id().alias(rank))


def _ranked(rows: DataFrame, first: str, second: str, rank: str) -> DataFrame:
    """``rows`` with the rank of (first, second) among all such pairs; null where second is null or the pair occurs once."""
    pairs = rows.where(F.col(second).isNotNull()).groupBy(first, second).agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(_numbered(pairs, first, second, rank), [first, second], "left")


def suffix_ranks(lines: DataFrame, min_words: int, levels: int) -> DataFrame:
    """Places of repeated lines in stretches of ``min_words`` words or more, with ranks r0, r1, ... by 1, 2, 4, ... lines.

    Each round is written to the shared folder, so its numbers are fixed before the next builds on them.
    """
    repeated = _numbered(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"), "h1", "h2", "r0")
    document = Window.partitionBy(*PLACE)
    rows = lines.join(repeated, ["h1", "h2"]).drop("h1", "h2").dropDuplicates([*PLACE, "j"])  # rows that repeat are one document, however many they are
    rows = rows.withColumn("seg", F.col("j") - F.row_number().over(document.orderBy("j")))
    rows = rows.withColumn("all", F.sum("w").over(Window.partitionBy(*PLACE, "seg"))).where(F.col("all") >= min_words).drop("all")
    rows = checkpoint(rows)
    for k in range(levels):
        ahead = F.lead(f"r{k}", 2**k).over(Window.partitionBy(*PLACE, "seg").orderBy("j"))
        rows = checkpoint(_ranked(rows.withColumn("ahead", ahead), f"r{k}", "ahead", f"r{k + 1}").drop("ahead"))
    return rows


def _runs(rows: DataFrame, min_words: int, levels: int) -> DataFrame:
    """The shortest runs of ``min_words`` words from each place on and up to each place: their name (length and two ranks), place and lines."""
    segment = Window.partitionBy(*PLACE, "seg")
    starts = F.struct(*(F.col(f"r{k}") for k in range(levels + 1)))
    ends = F.struct(*(F.lag(f"r{k}", 2**k - 1).over(segment.orderBy("j")).alias(f"r{k}") for k in range(levels + 1)))
    upto = F.sum("w").over(segment.orderBy("j"))
    rows = rows.select(*PLACE, "seg", "j", "i", starts.alias("starts"), ends.alias("ends"), upto.alias("upto"), (upto - F.col("w")).alias("before"))
    onward, back = segment.orderBy("before").rangeBetween(0, min_words - 1), segment.orderBy("upto").rangeBetween(1 - min_words, 0)
    here = F.struct("j", "i", "upto", "before", "starts", "ends")
    rows = rows.select(*PLACE, here.alias("here"), F.last(here).over(onward).alias("last"), F.first(here).over(back).alias("first"))

    def named(a: str, b: str) -> DataFrame:
        length = F.col(f"{b}.j") - F.col(f"{a}.j") + 1
        level = F.floor(F.log2(length)).cast("int")

        def at(side: str) -> Column:
            return F.coalesce(*(F.when(level == k, F.col(f"{side}.r{k}")) for k in range(levels + 1)))

        out = rows.where(F.col(f"{b}.upto") - F.col(f"{a}.before") >= min_words)
        return out.select(length.alias("length"), at(f"{a}.starts").alias("x"), at(f"{b}.ends").alias("y"), *PLACE, F.struct(f"{a}.j", f"{a}.i").alias("start"), F.struct(f"{b}.j", f"{b}.i").alias("end"))

    return named("here", "last").union(named("first", "here")).where("x is not null and y is not null")


def deletions(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text") -> DataFrame:
    """d, th (a document's key and xxhash64 of its text) and ``spans``: the disjoint line spans to delete, ends inclusive."""
    levels = max(0, min_words.bit_length() - 1)
    lines = checkpoint(_lines(docs, key, text))
    runs = checkpoint(_runs(suffix_ranks(lines, min_words, levels), min_words, levels))
    name = ["length", "x", "y"]
    first = checkpoint(runs.groupBy(*name).agg(F.min(F.struct(*PLACE, "start")).alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n"))  # so that AQE can split a run that most documents have
    later = runs.join(first, name).where(F.struct(*PLACE, "start") > F.col("earliest")).select(*PLACE, "start", "end").distinct()
    order = Window.partitionBy(*PLACE).orderBy("start", "end")
    reach = F.max("end.j").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("new", F.coalesce((F.col("start.j") > reach + 1).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(order))
    spans = islands.groupBy(*PLACE, "island").agg(F.min("start.i").alias("start"), F.max("end.i").alias("end"))
    return spans.groupBy(*PLACE).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = 50, key: str = "doc_id", text: str = "text", into: str = "removed_lines") -> DataFrame:
    """All columns, ``text`` without later copies of line runs, and ``into`` (long), the number of lines removed.

    Null and empty texts stay as they are. Rows that repeat both key and text are one document and are all treated
    alike; rows that share only the key are documents ordered by the hash of their text; a null key comes first.
    A text that loses all its lines becomes empty. Empty tables give empty tables. The corpus order decides which copy
    is the first, so the result does not depend on partitioning. A column that has the name ``into`` already, in any
    case, is replaced; names of other columns don't matter.
    """
    docs = without(docs, into)
    found = deletions(docs, min_words, key, text)
    d, th, spans, own = (fresh(docs, n) for n in ("__d", "__th", "__spans", "__hash"))
    gone = found.select(F.col("d").alias(d), F.col("th").alias(th), F.col("spans").alias(spans))
    joined = docs.withColumn(own, F.xxhash64(text)).join(gone.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col(d)) & (F.col(own) == F.col(th)), "left")
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("i"), line.alias("line")))
    kept = F.filter(lines, lambda x: ~F.exists(spans, lambda s: x["i"].between(s["start"], s["end"])))
    texts = F.when(F.col(spans).isNull(), F.col(text)).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    removed = F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"] + 1), F.lit(0).cast("long"))
    return joined.select(*(texts.alias(text) if c == text else F.col(quoted(c)) for c in docs.columns), removed.alias(into))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of line runs of 50 words or more: doc_id, text and removed_lines."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
ORACLE_SQL: dict[str, str] = {}
