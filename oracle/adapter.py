"""The fixture adapter (FIXTURES.md §0-1) as DuckDB common table expressions.

The driver registers ``lineitem orders part customer nation region ...`` as views; these CTEs
derive the 28 checkout tables from them with the same rules the Spark adapter applies.
"""

ADAPTER_CTES = r"""
-- copies(x): one row, or two where a key repeats
item AS (
  SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_extendedprice, l.l_returnflag,
         p.p_retailprice AS price,
         l.l_orderkey * 100 + row_number() OVER (
           PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice
         ) AS item_id,
         CASE WHEN l.l_linenumber % 4 = 0 THEN 'extra' ELSE 'ticket' END AS kind
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
),
ord AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderdate,
         coalesce(v.tv, 0.0E0) AS tv, coalesce(v.pv, 0.0E0) AS pv,
         CASE WHEN o.o_orderpriority = '5-LOW' AND o.o_orderkey % 3 = 0 THEN NULL
              WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'CreditCard'
              WHEN o.o_orderpriority = '4-NOT SPECIFIED' THEN 'Pix'
              WHEN o.o_orderkey % 3 = 1 THEN 'PayPal' ELSE 'boleto' END AS opt
  FROM orders o LEFT JOIN (
    SELECT l_orderkey AS ok,
           round(sum(CASE WHEN kind = 'ticket' THEN price ELSE 0.0E0 END), 2) AS tv,
           round(sum(CASE WHEN kind = 'extra' THEN price ELSE 0.0E0 END), 2) AS pv
    FROM item GROUP BY l_orderkey
  ) v ON v.ok = o.o_orderkey
),
summ AS (
  SELECT o_orderkey AS sid, opt, tv, pv,
         CASE WHEN o_orderkey % 101 = 0 THEN tv + 1000.0E0
              WHEN o_orderkey % 53 = 0 THEN tv + 1.0E0
              WHEN o_orderkey % 4 = 0 THEN floor(10.0E0 * tv + 0.5E0) / 100.0E0 ELSE 0.0E0 END AS discount,
         CASE WHEN opt = 'CreditCard' THEN floor(2.0E0 * tv + 0.5E0) / 100.0E0 ELSE 0.0E0 END AS interest,
         CASE WHEN pv > 0 THEN 15.0E0 ELSE 0.0E0 END AS freight,
         floor(8.0E0 * tv + 0.5E0) / 100.0E0 AS tax,
         CASE WHEN o_orderkey % 6 = 0 THEN floor(5.0E0 * tv + 0.5E0) / 100.0E0 ELSE 0.0E0 END AS insurance,
         CASE WHEN o_orderkey % 43 = 0 THEN NULL WHEN o_orderkey % 41 = 5 THEN 25.0E0 ELSE 0.0E0 END AS transfer
  FROM ord
),
checkoutsession AS (
  SELECT CAST(o_orderkey AS BIGINT) AS id,
         CAST(o_orderdate + to_hours(CAST(o_orderkey % 24 AS BIGINT)) AS TIMESTAMP) AS createdat,
         CASE WHEN o_orderstatus = 'P' THEN 'Pending' ELSE 'Paid' END AS status,
         'or_' || CAST(o_orderkey AS VARCHAR) AS providerOrderId,
         CASE WHEN opt = 'CreditCard' THEN 'card_' || CAST(o_custkey AS VARCHAR) END AS providerCardId
  FROM ord
),
checkoutsummary AS (
  SELECT CAST(sid AS BIGINT) AS sessionid,
         CASE WHEN sid % 67 = 0 THEN NULL
              ELSE tv + pv + tax + interest + freight + insurance - discount END AS totalAmount,
         tv AS ticketsValue, pv AS productsValue, discount, interest, freight, tax,
         insurance AS ticketInsurance, transfer AS ticketTransfer
  FROM summ, unnest(range(if(sid % 211 = 0, 2, 1))) AS copies(c)
),
checkoutpayment AS (
  SELECT CAST(o_orderkey AS BIGINT) AS sessionid, opt AS paymentOption,
         CAST(CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 109 = 0 THEN 0
                   WHEN opt = 'CreditCard' THEN 1 + o_orderkey % 12
                   WHEN o_orderkey % 71 = 0 THEN 2 ELSE 1 END AS INTEGER) AS installments,
         CAST(CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE 1 + o_orderkey % 2 END AS BIGINT) AS paymentProviderId,
         CASE WHEN o_orderkey % 5 = 0 THEN 'visa' WHEN o_orderkey % 5 = 1 THEN 'elo' END AS cardBrand,
         CASE WHEN o_orderkey % 8 = 0 THEN '******' WHEN o_orderkey % 8 = 1 THEN '411111'
              WHEN o_orderkey % 8 = 2 THEN '222100' WHEN o_orderkey % 8 = 3 THEN '506700'
              WHEN o_orderkey % 8 = 4 THEN '606282' WHEN o_orderkey % 8 = 5 THEN '371449'
              WHEN o_orderkey % 8 = 6 THEN '981234' END AS cardFirstSixDigits
  FROM ord, unnest(range(if(o_orderkey % 223 = 0, 2, 1))) AS copies(c) WHERE opt IS NOT NULL
),
checkoutpaypaldetails AS (
  SELECT CAST(o_orderkey AS BIGINT) AS sessionId, 'cap_' || CAST(o_orderkey AS VARCHAR) AS captureId
  FROM ord, unnest(range(if(o_orderkey % 10 = 0, 2, 1))) AS copies(c) WHERE opt = 'PayPal'
),
customerpaymentprovidercard AS (
  SELECT 'card_' || CAST(c_custkey AS VARCHAR) AS cardId,
         CASE WHEN dup = 1 THEN '555555' WHEN c_custkey % 7 = 0 THEN '******'
              WHEN c_custkey % 7 = 1 THEN '411111' WHEN c_custkey % 7 = 2 THEN '545454'
              WHEN c_custkey % 7 = 3 THEN '636368' WHEN c_custkey % 7 = 4 THEN '384100'
              WHEN c_custkey % 7 = 5 THEN '341111' END AS first_six_digits,
         CASE WHEN c_custkey % 8 = 0 THEN 'mastercard' WHEN c_custkey % 8 = 1 THEN 'visa'
              WHEN c_custkey % 8 = 2 THEN 'elo' WHEN c_custkey % 8 = 4 THEN 'hipercard'
              WHEN c_custkey % 8 = 5 THEN 'amex' WHEN c_custkey % 8 = 7 THEN 'diners' END AS brand
  FROM (SELECT c_custkey, 0 AS dup FROM customer WHERE c_custkey % 9 <> 7
        UNION ALL SELECT c_custkey, 1 AS dup FROM customer WHERE c_custkey % 10 = 0) c
),
checkoutbuyer AS (
  SELECT CAST(o_orderkey AS BIGINT) AS sessionId FROM ord, unnest(range(if(o_orderkey % 7 = 0, 2, 1))) AS copies(c)
),
checkoutparticipant AS (
  SELECT CAST(item_id AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS sessionid,
         CAST(l_partkey + 1000000 AS BIGINT) AS checkoutEventTicketBatchPriceId
  FROM item WHERE kind = 'ticket'
),
checkoutorderticketpartialcancel AS (
  SELECT CAST(item_id AS BIGINT) AS participantId,
         CASE WHEN item_id % 5 = 0 THEN 'Troca de Titularidade'
              WHEN item_id % 5 = 1 THEN 'Cancelamento Reembolsável' ELSE 'Desistência' END AS reason
  FROM item, unnest(range(if(item_id % 11 = 0, 2, 1))) AS copies(c) WHERE kind = 'ticket' AND l_returnflag = 'R' AND item_id % 5 < 3
),
tradecheckoutsession AS (
  SELECT CAST(item_id AS BIGINT) AS originalParticipantId, CAST(item_id + 1 AS BIGINT) AS participantId,
         25.0E0 AS transferValue,
         CASE WHEN l_linenumber % 2 = 0 THEN 'Pending' ELSE 'Paid' END AS status
  FROM item, unnest(range(if(item_id % 3 = 0, 2, 1))) AS copies(c) WHERE kind = 'ticket' AND l_returnflag = 'R' AND item_id % 5 = 0
),
checkouteventticketbatchprice AS (
  SELECT CAST(p_partkey + 1000000 AS BIGINT) AS id, CAST(p_partkey AS BIGINT) AS eventTicketBatchPriceId FROM part
),
eventticketbatchprice AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, p_retailprice AS price, CAST(p_size % 4 AS BIGINT) AS typeid,
         CAST(p_partkey AS BIGINT) AS ticketBatchId
  FROM part
),
eventticketbatchpricetype AS (
  SELECT CAST(id AS BIGINT) AS id, name
  FROM (VALUES (0, 'inteira'), (1, 'meia'), (2, 'idoso'), (3, 'assessoria')) t(id, name)
),
eventticketbatch AS (SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_partkey % 200 AS BIGINT) AS ticketId FROM part),
ticket_ids AS (SELECT DISTINCT p_partkey % 200 AS id FROM part),
eventticket AS (
  SELECT CAST(id AS BIGINT) AS id, 'ticket ' || CAST(id AS VARCHAR) AS name, CAST(id % 25 AS BIGINT) AS eventid
  FROM ticket_ids
),
eventticketcomplement AS (
  SELECT CAST(id AS BIGINT) AS ticketid,
         CASE WHEN id % 13 = 0 THEN 'extra' WHEN id % 29 = 1 THEN 'servico' ELSE 'ticket' END AS category,
         CAST(5 * (1 + id % 4) AS VARCHAR) || 'k' AS nameparsed,
         CASE WHEN id % 3 = 0 THEN 0.0E0 WHEN id % 3 = 1 THEN 7.0E0 END AS emissionChargePercent,
         CASE WHEN id % 4 = 0 THEN 0.0E0 WHEN id % 4 = 1 THEN 3.5E0 END AS emissionChargeFixed,
         CASE WHEN id % 5 = 0 THEN 0.0E0 WHEN id % 5 = 1 THEN 40.0E0 END AS comissionSecurityPerc,
         CASE WHEN id % 6 = 0 THEN 0.0E0 WHEN id % 6 = 1 THEN 60.0E0 END AS transferPercent
  FROM ticket_ids, unnest(range(if(id = 5, 2, 1))) AS copies(c)
),
event AS (
  SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS title, 8.0E0 + n_nationkey % 5 AS taxaevent,
         25.0E0 AS ticketTransferValue
  FROM nation
),
eventcomplement AS (
  SELECT CAST(n_nationkey AS BIGINT) AS eventid, r_name AS globalevent,
         5.0E0 AS emissionChargePercent, 2.0E0 AS emissionChargeFixed, 30.0E0 AS comissionSecurityPerc,
         50.0E0 AS transferPercent, 1.0E0 AS rebateTax, 6.0E0 AS taxRate,
         4.0E0 AS productChargePercent, 1.0E0 AS productChargeFixed
  FROM nation JOIN region ON r_regionkey = n_regionkey, unnest(range(if(n_nationkey = 3, 2, 1))) AS copies(c) WHERE n_nationkey <> 24
),
installmentsrange AS (
  SELECT CAST(n AS INTEGER) AS installments, a AS installmentsArray
  FROM (VALUES (1, '[1]'), (2, '[1,2]'), (3, '[1,2,3]'), (4, '[1,2,3,4]'), (5, '[1,2,3,4,5]'),
               (6, '[1,2,3,4,5,6]'), (7, '[1,2,null,4,5,6,7]'), (8, '[1,2,3,4,5,6,7,8]'),
               (9, '[1,2,3,4,5,6,7,8,9]'), (10, '[1,2,3,4,5,6,7,8,9,10]'),
               (12, '[1,2,3,4,5,6,7,8,9,10,11,12]')) t(n, a)
),
paymentprovider AS (
  SELECT CAST(id AS BIGINT) AS id, name FROM (VALUES (1, 'Pagarme'), (2, 'Stone')) t(id, name)
),
gatecharges AS (
  SELECT gateway, CAST(neg AS INTEGER) AS negotiationNumber, charge_on AS chargeOn, brand AS cardBrand,
         CAST(n AS INTEGER) AS installments, ctype AS chargeType, CAST(amount AS DOUBLE) AS chargeAmount
  FROM (
    SELECT g.gateway, 1 AS neg, 'CreditCard' AS charge_on, b.brand, k.n, 'percent' AS ctype,
           0.02E0 + 0.001E0 * k.n AS amount
    FROM (VALUES ('Pagarme'), ('Stone')) g(gateway)
    CROSS JOIN (VALUES ('visa'), ('Master'), ('elo'), ('hipercard'), ('Amex')) b(brand)
    CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) k(n)
    UNION ALL
    SELECT g.gateway, 1, m.m, m.m, 1, 'percent', 0.01E0
    FROM (VALUES ('Pagarme'), ('Stone')) g(gateway) CROSS JOIN (VALUES ('Pix'), ('boleto')) m(m)
    UNION ALL
    SELECT * FROM (VALUES ('PayPal', 1, 'PayPal', 'PayPal', 1, 'percent', 0.045E0),
                          ('Pagarme', 0, 'CreditCard', 'all', 0, 'fixed', 0.5E0),
                          ('Pagarme', 0, 'antifraude', 'all', 0, 'fixed', 0.4E0),
                          ('Pagarme', 0, 'boleto', 'all', 0, 'fixed', 3.0E0),
                          ('PayPal', 0, 'PayPal', 'all', 0, 'fixed', 0.6E0),
                          ('pagarme', 1, 'CREDITCARD', 'VISA', 3, 'percent', 0.05E0),
                          ('PAGARME', 0, 'Antifraude', 'all', 0, 'FIXED', 0.1E0)) f(gateway, neg, charge_on, brand, n, ctype, amount)
  ) t
),
checkoutproductcomplement AS (
  SELECT CAST(item_id AS BIGINT) AS id, CAST(l_orderkey AS BIGINT) AS sessionId,
         CAST(l_partkey AS BIGINT) AS productId, CAST(l_partkey % 50 AS BIGINT) AS modelId,
         CAST(l_partkey AS BIGINT) AS sizeId
  FROM item WHERE kind = 'extra'
),
product AS (
  SELECT CAST(p_partkey AS BIGINT) AS id, p_name AS title, CAST(p_partkey % 25 AS BIGINT) AS eventId FROM part
),
productmodel AS (
  SELECT CAST(id AS BIGINT) AS id, 'model ' || CAST(id AS VARCHAR) AS name
  FROM (SELECT DISTINCT p_partkey % 50 AS id FROM part) t
),
productsize AS (SELECT CAST(p_partkey AS BIGINT) AS id, p_retailprice AS price FROM part),
productcomplementmanual AS (
  SELECT CAST(p_partkey AS BIGINT) AS productId,
         CASE WHEN p_partkey % 20 = 0 THEN 'ticket' ELSE 'extra' END AS category,
         CASE WHEN p_partkey % 3 = 0 THEN 0.0E0 WHEN p_partkey % 3 = 1 THEN 10.0E0 END AS productChargePercent,
         CASE WHEN p_partkey % 4 = 0 THEN 0.0E0 WHEN p_partkey % 4 = 1 THEN 1.5E0 END AS productChargeFixed
  FROM part, unnest(range(if(p_partkey % 50 = 7, 2, 1))) AS copies(c)
),
checkoutorderproductpartialcancel AS (
  SELECT CAST(item_id AS BIGINT) AS checkoutProductComplementId,
         CASE WHEN item_id % 5 = 0 THEN 'Troca de Titularidade'
              WHEN item_id % 5 = 1 THEN 'another option' ELSE 'Desistência' END AS reason
  FROM item, unnest(range(if(item_id % 11 = 0, 2, 1))) AS copies(c) WHERE kind = 'extra' AND l_returnflag = 'R' AND item_id % 5 < 3
),
checkoutproductcomplementanswer AS (
  SELECT CAST(item_id AS BIGINT) AS checkoutProductComplementId FROM item WHERE kind = 'extra'
  UNION ALL
  SELECT CAST(item_id AS BIGINT) FROM item WHERE kind = 'extra' AND l_returnflag = 'A'
),
weeksarrange AS (
  SELECT d AS data, CAST(CAST(date_trunc('week', d) AS DATE) AS VARCHAR) AS semana
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) t, unnest(range(if(day(d) = 15, 2, 1))) AS copies(c)
)"""

TABLES = [
    "checkoutsession", "checkoutsummary", "checkoutpayment", "checkoutpaypaldetails",
    "customerpaymentprovidercard", "checkoutbuyer", "checkoutparticipant",
    "checkoutorderticketpartialcancel", "tradecheckoutsession", "checkouteventticketbatchprice",
    "checkoutproductcomplement", "checkoutorderproductpartialcancel",
    "checkoutproductcomplementanswer", "eventticketbatchprice", "eventticketbatchpricetype",
    "eventticketbatch", "eventticket", "eventticketcomplement", "event", "eventcomplement",
    "product", "productmodel", "productsize", "productcomplementmanual", "installmentsrange",
    "paymentprovider", "gatecharges", "weeksarrange",
]
