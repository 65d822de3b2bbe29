"""Schemas of the 28 checkout tables the ledger reads.

Column names are those of the operational database (case-insensitive in Spark, as in the
source). Types are inferred from how each column is used: ids are ``long``, instalment counts
``int``, money and percentages ``double`` (percentages stored 0-100), timestamps zone-less.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "long": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "string": StringType(),
    "timestamp": TimestampNTZType(),
    "date": DateType(),
}


def _schema(spec: str) -> StructType:
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(StructField(name, _TYPES[kind], True))
    return StructType(fields)


SCHEMAS: dict[str, StructType] = {
    # facts: one row per checkout, participant, product line, payment, ...
    "checkoutsession": _schema(
        "id long, createdat timestamp, status string, providerOrderId string, providerCardId string"
    ),
    "checkoutsummary": _schema(
        "sessionid long, totalAmount double, ticketsValue double, productsValue double,"
        " discount double, interest double, freight double, tax double, ticketInsurance double,"
        " ticketTransfer double"
    ),
    "checkoutpayment": _schema(
        "sessionid long, paymentOption string, installments int, paymentProviderId long,"
        " cardBrand string, cardFirstSixDigits string"
    ),
    "checkoutpaypaldetails": _schema("sessionId long, captureId string"),
    "customerpaymentprovidercard": _schema("cardId string, first_six_digits string, brand string"),
    "checkoutbuyer": _schema("sessionId long"),
    "checkoutparticipant": _schema("id long, sessionid long, checkoutEventTicketBatchPriceId long"),
    "checkoutorderticketpartialcancel": _schema("participantId long, reason string"),
    "tradecheckoutsession": _schema(
        "originalParticipantId long, participantId long, transferValue double, status string"
    ),
    "checkouteventticketbatchprice": _schema("id long, eventTicketBatchPriceId long"),
    "checkoutproductcomplement": _schema(
        "id long, sessionId long, productId long, modelId long, sizeId long"
    ),
    "checkoutorderproductpartialcancel": _schema("checkoutProductComplementId long, reason string"),
    "checkoutproductcomplementanswer": _schema("checkoutProductComplementId long"),
    # dimensions: catalogue of events, tickets and products
    "eventticketbatchprice": _schema("id long, price double, typeid long, ticketBatchId long"),
    "eventticketbatchpricetype": _schema("id long, name string"),
    "eventticketbatch": _schema("id long, ticketId long"),
    "eventticket": _schema("id long, name string, eventid long"),
    "eventticketcomplement": _schema(
        "ticketid long, category string, nameparsed string, emissionChargePercent double,"
        " emissionChargeFixed double, comissionSecurityPerc double, transferPercent double"
    ),
    "event": _schema("id long, title string, taxaevent double, ticketTransferValue double"),
    "eventcomplement": _schema(
        "eventid long, globalevent string, emissionChargePercent double,"
        " emissionChargeFixed double, comissionSecurityPerc double, transferPercent double,"
        " rebateTax double, taxRate double, productChargePercent double, productChargeFixed double"
    ),
    "product": _schema("id long, title string, eventId long"),
    "productmodel": _schema("id long, name string"),
    "productsize": _schema("id long, price double"),
    "productcomplementmanual": _schema(
        "productId long, category string, productChargePercent double, productChargeFixed double"
    ),
    # parameter tables: instalment plans, gateways, their charges, the week calendar
    "installmentsrange": _schema("installments int, installmentsArray string"),
    "paymentprovider": _schema("id long, name string"),
    "gatecharges": _schema(
        "gateway string, negotiationNumber int, chargeOn string, cardBrand string,"
        " installments int, chargeType string, chargeAmount double"
    ),
    "weeksarrange": _schema("data date, semana string"),
}

TABLE_NAMES: tuple[str, ...] = tuple(SCHEMAS)
