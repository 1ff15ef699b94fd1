"""Chat formatting: multi-party perspective rotation, in DataFrame functions only."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns in a part at most, and parts that meet a conversation's people in one task.
PART_TURNS, PARTS = 128, 16
START, END = "<|im_start|>", "<|im_end|>\n"


def _safe(text):
    """A text in which no marker can be forged: a space parts ``<`` and ``|``."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", system: tuple[str, ...] = ("system",), part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, perspective, part, piece, n_turns, rendered, spans, n_masked): the dialogue as each participant would speak it.

    For every speaker of a conversation other than ``system`` the whole dialogue is rendered
    with that speaker as ``assistant``, all others as ``user`` with their name, and system turns as
    they are. ``spans`` holds (first, end) character places in ``rendered`` of what the assistant
    says, its closing marker included: the tokens to train on; ``n_masked`` is their total.

    Turns are ordered by number, then speaker and text. A dialogue of up to ``part_turns`` turns is one
    row per perspective. A longer one comes in rows by ``part``, of ``part_turns`` turn
    numbers each, and by ``piece`` where numbers repeat, of ``part_turns`` turns each: their ``rendered``
    joined in that order is the whole. So no row and no task holds more, however long one
    conversation is. Turns without number form a part of their own, which is null. A null or
    empty speaker is a user without a name and takes no perspective; line ends in a name are
    spaces; null texts are empty; repeated rows are repeated turns. A conversation of system
    turns only, and an empty table, give no rows. A null conversation is one like others.
    """
    speaker, text = F.trim(F.translate(F.coalesce(F.col(speaker_col), F.lit("")), "\r\n", "  ")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), speaker.alias("speaker"), text.alias("text"))
    # a conversation's parts are dealt in groups of PARTS, and its people go to every group
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("~"))).withColumn("part", F.floor(F.col("turn") / part_turns))
    rows = rows.withColumn("deal", F.coalesce(F.floor(F.col("part") / PARTS), F.lit(-1)))
    people = rows.where((F.col("speaker") != "") & ~F.col("speaker").isin(*system)).select("key", F.col("speaker").alias("perspective")).distinct()
    deals = rows.select("key", "deal").distinct().join(people, "key")
    dealt = rows.repartition("key", "deal")
    nth = F.row_number().over(Window.partitionBy("key", "deal", "part").orderBy("turn", "speaker", "text"))
    parts = dealt.withColumn("piece", F.floor((nth - 1) / part_turns))
    parts = parts.groupBy("key", "deal", "part", "piece").agg(F.first("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    both = parts.join(deals, ["key", "deal"])

    def piece(t):
        own = t["speaker"] == F.col("perspective")
        other = F.when(t["speaker"].isin(*system), F.concat(F.lit("system\n"))).otherwise(F.concat(F.lit("user"), F.when(t["speaker"] == "", F.lit("")).otherwise(F.concat(F.lit(" name="), _safe(t["speaker"]))), F.lit("\n")))
        head = F.concat(F.lit(START), F.when(own, F.lit("assistant\n")).otherwise(other))
        body = F.concat(_safe(t["text"]), F.lit(END))
        return F.struct(own.alias("own"), F.concat(head, body).alias("piece"), F.length(head).alias("head"), F.length(body).alias("body"))

    empty = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<first:int,end:int>>").alias("spans"))
    grow = lambda acc, p: F.struct(
        (acc["at"] + p["head"] + p["body"]).alias("at"),
        F.when(p["own"], F.concat(F.coalesce(acc["spans"], F.array().cast("array<struct<first:int,end:int>>")), F.array(F.struct((acc["at"] + p["head"]).alias("first"), (acc["at"] + p["head"] + p["body"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
    )
    made = both.select("conv", "perspective", "part", F.col("piece").cast("int").alias("nth"), F.transform("turns", piece).alias("pieces"))
    spans = F.coalesce(F.aggregate("pieces", empty, grow, lambda acc: acc["spans"]), F.array().cast("array<struct<first:int,end:int>>"))
    out = made.select(F.col("conv").alias(conv_col), "perspective", "part", F.col("nth").alias("piece"), F.size("pieces").alias("n_turns"), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered"), spans.alias("spans"))
    return out.withColumn("n_masked", F.aggregate("spans", F.lit(0), lambda a, s: a + s["end"] - s["first"]))
