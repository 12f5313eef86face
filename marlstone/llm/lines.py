"""Line dedup by content-defined chunks of lines.

Lines are hashed, and a rolling hash over the last ``WIDTH`` line hashes ends a
chunk where it falls on a multiple of ``DIVISOR`` (never twice in a row, nor at
the first or last line of a run).  A chunk also ends where lines that occur once
in the corpus meet lines that occur again, so that a repeated passage isn't
fused with lines that don't.  No boundary depends on a line's place, so an
inserted line shifts no later one.  Chunks of several lines that occur again
with the same bytes are removed everywhere but at their first place.  A passage
may also be a single line, and beside other recurring lines it fuses with
different ones in each document: so lines of ``LONG_WORDS`` words or more are
judged in the same way by themselves.

Lines without words are no lines of a run: boundaries, line counts and word
counts come from the others alone.  Those inside a chunk are part of its bytes,
and those between two chunks of a run of recurring lines go with the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpointed, small_batches

#: The rolling hash of two lines: (hash + BASE * hash of the line before) mod PRIME.
WIDTH, DIVISOR, BASE, PRIME = 2, 4, 31, 1_000_003
#: A chunk is removable from this many lines and words on, or as one line of LONG_WORDS words.
MIN_LINES, MIN_WORDS, LONG_WORDS = 2, 12, 40


def chunk_verdicts(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """k, h and the sorted array ``gone`` of (first, n) runs of lines to remove, for documents that lose any.

    ``docs`` are (row: other columns, k: key, h: hash of the text, t: text), none of them null.
    """
    # Lines go on as hashes and word counts.  (key, text) names a document, so repeated rows are one.
    facts = F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.cast("int").alias("pos"), F.conv(F.substring(F.md5(x), 1, 12), 16, 10).cast("long").alias("l"), F.regexp_count(x, F.lit("[^ \\t\\r]+")).alias("w")))
    own = docs.select("k", "h", F.filter(facts, lambda f: f["w"] > 0).alias("facts")).groupBy("k", "h").agg(F.first("facts").alias("facts"))
    # Written once: it is counted and cut.
    lines = checkpointed(own.select("k", "h", F.inline("facts")))
    # Hot keys' own tables are materialised, so that each join below is a plain one, whose skewed partitions Spark splits.
    again = checkpointed(lines.groupBy("l").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("l", F.lit(True).alias("again")))
    flagged = lines.join(again, "l", "left").withColumn("again", F.coalesce("again", F.lit(False)))
    doc = Window.partitionBy("k", "h").orderBy("pos")
    before = F.coalesce(F.lag("l").over(doc), F.lit(0))
    rolled = (F.col("l") + before * F.lit(BASE)) % F.lit(PRIME) % F.lit(DIVISOR) == 0
    # A cut needs a line of its own kind before it, two after it, and no cut candidate just before in its run.
    near = lambda f, n=1: F.coalesce(f("again", n).over(doc) == F.col("again"), F.lit(False))
    rolls = flagged.withColumn("roll", rolled & near(F.lag))
    ends = rolls.withColumn("cut", F.col("roll") & ~F.coalesce(F.lag("roll").over(doc), F.lit(False)) & near(F.lead) & near(F.lead, 2))
    starts = F.coalesce(F.lag("cut").over(doc), F.lit(True)) | (F.lag("again").over(doc) != F.col("again"))
    # Where removal ends: before the run's next line, so that lines without words go too, or after the run's last line.
    until = F.when(near(F.lead), F.lead("pos").over(doc)).otherwise(F.col("pos") + 1)
    numbered = ends.withColumns({"chunk": F.sum(starts.cast("int")).over(doc), "until": until})
    # A document's lines are already together, so this aggregation moves nothing.
    chunks = numbered.where("again").groupBy("k", "h", "chunk").agg(F.min("pos").alias("c"), F.sum("w").alias("w"), F.sort_array(F.collect_list(F.struct("pos", "l", "w", "until"))).alias("ls"))
    several = (F.size("ls") >= min_lines) & (F.col("w") >= min_words) | (F.col("w") >= long_words)
    unit = lambda ls, whole: F.struct(ls[0]["pos"].alias("first"), (F.element_at(ls, -1)["until"] - ls[0]["pos"]).alias("n"), (F.element_at(ls, -1)["pos"] - ls[0]["pos"] + 1).alias("size"), F.xxhash64(F.transform(ls, lambda x: x["l"])).alias("ch"), F.lit(whole).alias("whole"))
    wholes = F.when(several, F.array(unit(F.col("ls"), True))).otherwise(F.array().cast("array<struct<first:int,n:int,size:int,ch:bigint,whole:boolean>>"))
    longs = F.transform(F.filter("ls", lambda x: (x["w"] >= long_words) & (F.size("ls") > 1)), lambda x: unit(F.array(x), False))
    able = checkpointed(chunks.select("k", "h", "c", F.inline(F.concat(wholes, longs))))
    twice = checkpointed(able.groupBy("ch").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("ch"))
    runs = able.join(twice, "ch", "left_semi").groupBy("k", "h").agg(F.collect_list(F.struct("first", "n", "size", "c", "whole")).alias("runs"))
    # Byte comparison: units meet on their bytes, and the least (key, place) owns each text.
    # ``row`` is read too, so that this read of the texts and the one that removes lines need the same columns, and Spark
    # exchanges the texts once for both.
    met = docs.join(runs, ["k", "h"]).withColumn("row", F.xxhash64("row"))
    bodies = met.select("row", "k", "h", F.explode("runs").alias("r"), F.split("t", "\n").alias("ls")).select("row", "k", "h", "r.first", "r.n", "r.c", "r.whole", F.array_join(F.slice("ls", F.col("r.first") + 1, F.col("r.size")), "\n").alias("body"))
    places = bodies.groupBy("row", "k", "h", "first", "n", "c", "whole").agg(F.first("body").alias("body")).withColumn("d", F.sha2("body", 256))
    # Bodies meet to be compared byte for byte; then digests stand for them.  A digest of two different bodies, should there ever be one, removes nothing.
    equal = places.groupBy("d", "body").agg(F.min(F.struct("k", "h", "first")).alias("o"), F.count(F.lit(1)).alias("m"))
    # Joined by the digest's reverse, owners are dealt anew for the join, which is then a plain one: Spark splits a hot unit's places.
    owner = equal.groupBy("d").agg(F.min("o").alias("o"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("bodies")).where("m > 1 AND bodies = 1").select(F.reverse("d").alias("e"), "o")
    lost = places.withColumn("e", F.reverse("d")).drop("body", "d").join(owner, "e").where(F.struct("k", "h", "first") != F.col("o"))
    # A chunk that goes takes its long lines along.
    of = lambda whole: F.collect_set(F.when(F.col("whole") == whole, F.struct("first", "n")))
    by_chunk = lost.groupBy("k", "h", "c").agg(of(True).alias("all"), of(False).alias("some")).select("k", "h", F.when(F.size("all") > 0, F.col("all")).otherwise(F.col("some")).alias("runs"))
    return by_chunk.groupBy("k", "h").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("gone"))


def line_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> DataFrame:
    """``docs`` with the text that is left, and n_lines, n_removed_lines, n_removed_chunks.

    Null and empty texts stay as they are (null has 0 lines).  A text that loses
    all its lines becomes empty.  Rows that repeat key and text count as one
    document and lose the same lines; of equal chunks the place of the least key
    stays.  Documents of a null key are compared with none.  Texts are cut
    whole, whatever their length; an empty table gives none.  Other columns pass
    through, whatever their names; columns of the names added are replaced.
    """
    small_batches(docs.sparkSession)
    base = docs.drop("n_lines", "n_removed_lines", "n_removed_chunks")
    # The caller's columns travel as one, so none of their names can clash.
    rest = [c for c in base.columns if c != text]
    rows = base.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(key).alias("k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("t"))
    judged = F.col("k").isNotNull() & F.col("t").isNotNull()
    # The same exchange of (key, text, hash) serves the byte comparison and the removal.
    some = rows.where(judged)
    verdicts = chunk_verdicts(some, min_lines, min_words, long_words)
    out = some.join(verdicts, ["k", "h"], "left").select("row", "t", "gone")
    out = out.union(rows.where(~judged).select("row", "t", F.lit(None).cast(out.schema["gone"].dataType).alias("gone")))
    ls = F.split("t", "\n")
    inside = lambda i: F.exists("gone", lambda r: (i >= r["first"]) & (i < r["first"] + r["n"]))
    left = F.when(F.col("gone").isNull(), F.col("t")).otherwise(F.array_join(F.filter(ls, lambda x, i: ~inside(i)), "\n"))
    lost = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, r: a + r["n"]), F.lit(0))
    return out.select(
        *[left.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in base.columns],
        F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size(ls)).cast("long").alias("n_lines"),
        lost.cast("long").alias("n_removed_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"),
    )
