"""Item status (R17-R19) and which cancelled items still count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: cancel reasons and item states -----------------------------------------
OWNER_CHANGE = "Troca de Titularidade"
PAYABLE_TICKET_REASONS = ("Troca de Titularidade", "Cancelamento Reembolsável")
PAYABLE_EXTRA_REASONS = ("another option",)
APPROVED = "aprovado"
CANCELLED = "cancelado"
TRANSFERRED = "transferido"
RECEIVED = "recebido"
GIVEN_AWAY = "Troca de Titularidade (de)"
TAKEN_OVER = "Troca de Titularidade (para)"
# --------------------------------------------------------------------------------------------


def payable(reason: Column, allowed: Sequence[str]) -> Column:
    """an item counts when it was not cancelled or cancelled for an allowed reason."""
    return reason.isNull() | reason.isin(list(allowed))


def ticket_status(reason: Column, transfer: Column) -> Column:
    """R17 for a ticket; ``transfer`` is the raw summary transfer value."""
    return (
        F.when(reason == OWNER_CHANGE, F.lit(TRANSFERRED))
        .when(transfer > 0, F.lit(RECEIVED))
        .when(reason.isNull(), F.lit(APPROVED))
        .otherwise(F.lit(CANCELLED))
    )


def ticket_status_detail(reason: Column, transfer: Column) -> Column:
    """R18 for a ticket."""
    return (
        F.when(reason == OWNER_CHANGE, F.lit(GIVEN_AWAY))
        .when(transfer > 0, F.lit(TAKEN_OVER))
        .when(reason.isNull(), F.lit(APPROVED))
        .otherwise(reason)
    )


def extra_status(reason: Column) -> Column:
    """R17 for an extra: an owner change keeps the extra approved."""
    return F.when((reason == OWNER_CHANGE) | reason.isNull(), F.lit(APPROVED)).otherwise(F.lit(CANCELLED))


def extra_status_detail(reason: Column) -> Column:
    """R18 for an extra."""
    return F.when((reason == OWNER_CHANGE) | reason.isNull(), F.lit(APPROVED)).otherwise(reason)


def linked_item(new_owner_item: Column, old_owner_item: Column) -> Column:
    """The other side of a paid ticket trade."""
    return F.coalesce(new_owner_item, old_owner_item)
