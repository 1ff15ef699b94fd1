"""Numbers for texts: equal texts have one, different texts different ones, verified."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def text_hash(text: Column, turn: int) -> Column:
    """The 64-bit number of a text in the given turn."""
    return F.xxhash64(text) if turn == 0 else F.xxhash64(F.sha2(text, 256), F.lit(turn))


class TextNodes:
    """``rows`` (id, node), ``groups`` (node, least, most, members) of all rows of ``docs``, and ``node``, the number of a text as a column.

    Numbers have 64 bits, so two of n texts meet with odds of about n * n / 2 ** 65. Each row's
    SHA-256 is written beside its number, and every number's least digest is compared with its greatest. Numbers that
    stand for two texts, of which next to none are expected, come to the driver, and their texts are numbered anew, until none is left.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, scratch: Scratch):
        self.text = F.coalesce(F.col(text_col), F.lit(""))
        self.clashes: list[list[int]] = []
        while True:
            rows = docs.select(F.col(id_col).cast("long").alias("id"), self.node.alias("node"), F.unhex(F.sha2(self.text, 256)).alias("digest"))
            self.rows = scratch.table(rows, "rows").select("id", "node")
            digests = scratch.spark.read.schema(rows.schema).parquet(scratch.path("rows"))
            groups = digests.groupBy("node").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count(F.lit(1)).alias("members"), (F.min("digest") != F.max("digest")).alias("clash"))
            self.groups = scratch.table(groups, "groups")
            found = [r[0] for r in self.groups.where("clash").select("node").collect()]
            self.groups = self.groups.drop("clash")
            if not found:
                return
            self.clashes.append(found)

    @property
    def node(self) -> Column:
        value = text_hash(self.text, 0)
        for turn, clashes in enumerate(self.clashes, 1):
            value = F.when(value.isin(clashes), text_hash(self.text, turn)).otherwise(value)
        return value
