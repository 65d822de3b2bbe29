"""Ticket trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.status import linked_item

PAID = "Paid"


def trade_links(trades: DataFrame) -> DataFrame:
    """Paid trades as (original ticket, ticket of the new owner)."""
    return trades.where(F.col("status") == PAID).select(
        F.col("originalParticipantId").alias("original_item_id"),
        F.col("participantId").alias("new_owner_item_id"),
    )


def attach_links(participants: DataFrame, trades: DataFrame) -> DataFrame:
    """Add ``linked_item_id``: for an original ticket its new owner's ticket, for a new owner's
    ticket the original. A ticket in several paid trades yields a row per trade (J17 x J18)."""
    links = trade_links(trades)
    gave = links.select(F.col("original_item_id").alias("gave_item"), F.col("new_owner_item_id").alias("gave_to"))
    got = links.select(F.col("new_owner_item_id").alias("got_item"), F.col("original_item_id").alias("got_from"))
    c = F.col
    return (
        participants.join(gave, c("item_id") == c("gave_item"), "left")
        .join(got, c("item_id") == c("got_item"), "left")
        .withColumn("linked_item_id", linked_item(c("gave_to"), c("got_from")))
        .drop("gave_item", "gave_to", "got_item", "got_from")
    )
