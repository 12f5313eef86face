"""Multi-party perspective rotation of dialogues.

For every participant a dialogue is rendered with that speaker as assistant, all
others as named users, and spans that mask in what the assistant says.

A dialogue is rendered in parts of ``PART`` turns by their rank, so neither a
task nor a row has to hold a dialogue of any length.  Every later part opens
with the context it needs, unmasked: the scene-setting turn in force, and the
``CARRY`` turns before it.  Ranks come from counts of cells of turn numbers, so no
dialogue meets in one task for them either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Turns of a part, turns that the next part repeats, and turn numbers of one cell.
PART, CARRY, CELL = 1024, 32, 256
#: Roles that set the scene and speak for nobody.
CONTEXT_ROLES = ("system",)


def _ranked(turns: DataFrame) -> DataFrame:
    """(c, n, r, t) with the rank ``q`` of each turn in its dialogue and the dialogue's ``total``."""
    celled = turns.withColumn("cell", F.expr(f"floor(n / {CELL})"))
    sizes = celled.groupBy("c", "cell").agg(F.count(F.lit(1)).alias("m"))
    dialogue = Window.partitionBy("c")
    before = dialogue.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("c").alias("sc"), F.col("cell").alias("scell"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), F.sum("m").over(dialogue).alias("total"))
    own = Window.partitionBy("c", "cell").orderBy("n", "r", "t")
    placed = celled.withColumn("rn", F.row_number().over(own) - 1)
    met = placed.join(starts, F.col("c").eqNullSafe(F.col("sc")) & (F.col("cell") == F.col("scell")))
    return met.select("c", "r", "t", (F.col("start") + F.col("rn")).alias("q"), "total")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part: int = PART, carry: int = CARRY, context_roles: tuple[str, ...] = CONTEXT_ROLES) -> DataFrame:
    """One row per (conversation, part, participant who speaks in it): n_turns, n_assistant, n_carried, text, mask_spans.

    Each turn reads ``<|assistant|>``, ``<|user name=NAME|>``, ``<|user|>`` for a
    null role or, for context roles, ``<|NAME|>``, a line feed, the text,
    ``<|end|>`` and a line feed; ``<|`` inside a text or name becomes ``< |``, and
    ``|>`` inside a name ``| >``, line breaks inside it one space, so that neither
    can end a header.  ``mask_spans`` are "start:end" code-point spans of the
    assistant's texts and end marks in this part, carried turns left out, joined
    by ";".  Turns are ordered by (turn, role, text), nulls first; a null turn
    counts as turn 0, null text as empty; a null role is a participant without a
    name.  Repeated rows are repeated turns.  A dialogue of context roles alone
    has no participant and gives no row; a null conversation id is a
    conversation; an empty table gives none; other columns are left out,
    whatever their names.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    name = F.regexp_replace(F.replace(safe(F.col(role)), F.lit("|>"), F.lit("| >")), "[\\r\\n]+", " ")
    rows = _ranked(turns.select(F.col(conv).alias("c"), F.coalesce(F.col(turn).cast("long"), F.lit(0).cast("long")).alias("n"), name.alias("r"), safe(F.coalesce(F.col(text), F.lit(""))).alias("t")))
    scene: Column = F.coalesce(F.col("r").isin(*context_roles), F.lit(False)) if context_roles else F.lit(False)
    own_part = F.expr(f"q div {part}")
    also = (F.col("q") % part >= part - carry) & (F.col("total") > (own_part + 1) * part)
    placed = F.struct(own_part.alias("p"), F.lit(False).alias("carried"))
    repeated = F.struct((own_part + 1).alias("p"), F.lit(True).alias("carried"))
    dealt = rows.select("c", "r", "t", "q", F.explode(F.when(also, F.array(placed, repeated)).otherwise(F.array(placed))).alias("to")).select("c", "to.p", "q", "r", "t", "to.carried")
    # The scene in force: of the scene-setting turns ahead of a part's carried ones, the last.
    long = rows.where(F.col("total") > part)
    set_ = long.where(scene).groupBy("c", F.expr(f"(q + {carry}) div {part} + 1").alias("p")).agg(F.max(F.struct("q", "r", "t")).alias("s"))
    later = long.groupBy("c").agg(F.max("total").alias("total")).select("c", F.explode(F.expr(f"sequence(1L, (total - 1) div {part})")).alias("p"), F.lit(None).cast(set_.schema["s"].dataType).alias("s"), F.lit(True).alias("is_part"))
    line = Window.partitionBy("c").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    forced = set_.select("c", "p", "s", F.lit(False).alias("is_part")).union(later).withColumn("s", F.max("s").over(line)).where(F.col("is_part") & F.col("s").isNotNull())
    dealt = dealt.union(forced.select("c", "p", "s.q", "s.r", "s.t", F.lit(True)))
    parts = dealt.groupBy("c", "p").agg(F.sort_array(F.collect_list(F.struct("q", "r", "t", "carried"))).alias("turns"))
    context = F.array(*[F.lit(x) for x in context_roles]) if context_roles else F.expr("cast(array() as array<string>)")
    sets_scene = lambda r: F.coalesce(F.array_contains(context, r), F.lit(False))
    speakers = F.array_distinct(F.transform(F.filter("turns", lambda x: ~x["carried"] & ~sets_scene(x["r"])), lambda x: x["r"]))
    pairs = parts.select("c", "p", "turns", F.explode(speakers).alias("participant"))

    def piece(x):
        own = x["r"].eqNullSafe(F.col("participant"))
        header = lambda *inside: F.concat(F.lit("<|"), *inside, F.lit("|>\n"))
        head = F.when(own, header(F.lit("assistant"))).when(sets_scene(x["r"]), header(x["r"])).when(x["r"].isNull(), header(F.lit("user"))).otherwise(header(F.lit("user name="), x["r"]))
        return F.struct((own & ~x["carried"]).alias("own"), x["carried"].alias("carried"), head.alias("head"), F.concat(x["t"], F.lit("<|end|>")).alias("body"))

    rendered = pairs.withColumn("said", F.transform("turns", piece))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))

    def step(a, x):
        start = a["at"] + F.length(x["head"])
        end = start + F.length(x["body"])
        span = F.concat(start.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 1).cast("long").alias("at"), F.when(x["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

    count = lambda f: F.size(F.filter("said", f)).cast("long")
    return rendered.select(
        F.col("c").alias(conv), F.col("p").cast("long").alias("part"), "participant",
        count(lambda x: ~x["carried"]).alias("n_turns"), count(lambda x: x["own"]).alias("n_assistant"), count(lambda x: x["carried"]).alias("n_carried"),
        F.array_join(F.transform("said", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
        F.array_join(F.aggregate("said", zero, step)["spans"], ";").alias("mask_spans"),
    )
