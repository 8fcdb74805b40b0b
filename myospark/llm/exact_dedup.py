"""Exact deduplication by a tree-merge of sorted digest runs, with DataFrame operations alone.

Every partition of the input makes one run: an entry for each of its digests, sorted by a 64-bit hash of the text and, as
what verifies that equal hashes are equal texts, the text's length in bytes and its SHA-256. An entry holds the identifier
that stays and the number of rows. Runs meet in binomial rounds: each merges ``fan_in`` neighbours in one sorted sweep
(a sort aggregate) and keeps, for each verified digest, the smallest (or largest) identifier. A merged run is spread over
tasks by digest, so no task holds a whole run, and a digest brings at most ``fan_in`` entries to a merge, however many
copies there are. The outcome goes back down to the leaves, where the rows of one digest are dealt by run as well: no
group of copies meets in one task, and a larger input has more runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, materialize

FAN_IN = 8
#: Rows that go are broadcast up to this number (an id and 32 bytes each), to spare the texts a shuffle.
BROADCAST_GONE = 250_000


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Pure ASCII texts take the faster general function."""
    known = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(known) == F.char_length(known)
    return F.when(ascii_only, F.lower(known)).otherwise(F.translate(known, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = FAN_IN) -> DataFrame:
    """Group equal texts and name the row of each group that stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256. ``keep`` is "min" or "max".
    Null texts are empty and all empty texts are one group. Null ids never stay while their group has another; a group of
    null ids only has a null keep_id and keeps its rows. Repeated rows with the same id and text count in group_size and
    share the verdict. An empty table gives an empty result; other columns are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep must be 'min' or 'max'")
    pick = F.min if keep == "min" else F.max
    low, run, digest = F.col(P + "low"), F.col(P + "run"), [P + "key", P + "size", P + "sha"]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.encode(lower_ascii(F.col(text_col)), "UTF-8").alias(P + "low"))
    rows = materialize(
        texts.select("doc_id", F.xxhash64(low).alias(P + "key"), F.octet_length(low).alias(P + "size"), F.unhex(F.sha2(low, 256)).alias(P + "sha"), F.spark_partition_id().alias(P + "run"))
    )
    # An identifier inside a struct cannot be updated in place in a hash table, so Spark aggregates over sorted rows.
    best = F.struct("doc_id")
    level = rows.groupBy(P + "run", *digest).agg(pick(F.when(F.col("doc_id").isNotNull(), best)).alias("best"), F.count(F.lit(1)).alias("group_size"))
    leaves, width = level, (rows.agg(F.max(P + "run")).first()[0] or 0) + 1
    while width > 1:
        width = -(-width // fan_in)
        level = level.groupBy(F.floor(run / fan_in).cast("int").alias(P + "run"), *digest).agg(pick("best").alias("best"), F.sum("group_size").alias("group_size"))
    winners = level.select(*digest, F.col("best.doc_id").alias("keep_id"), "group_size")
    down = leaves.select(P + "run", *digest).join(winners, digest)
    return rows.join(down, [*digest, P + "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex(P + "sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", **options) -> DataFrame:
    """The rows that stay, with all their columns; see ``exact_groups`` for what stays.

    Texts stay where they are as long as the rows that go are at most BROADCAST_GONE, and only texts with the id of such a
    row are digested again; beyond, both sides are shuffled by id and digest.
    """
    names = [id_col, text_col]
    if docs.columns.count(id_col) != 1 or docs.columns.count(text_col) != 1:
        raise ValueError(f"the table needs one column each of {names}")
    groups = exact_groups(docs, id_col, text_col, keep, **options)
    gone = materialize(groups.where("not kept").select(F.col("doc_id").alias(P + "id"), F.unhex("text_sha256").alias(P + "sha")).distinct())
    same_id = F.col(id_col).eqNullSafe(F.col(P + "id"))
    sha = F.unhex(F.sha2(F.encode(lower_ascii(F.col(text_col)), "UTF-8"), 256))
    if gone.count() <= BROADCAST_GONE:  # as an array's member the digest is no key of the join: it is made for equal ids only
        return docs.join(F.broadcast(gone), same_id & F.array_contains(F.array(P + "sha"), sha), "left_anti")
    return docs.join(gone, same_id & (sha == F.col(P + "sha")), "left_anti")
