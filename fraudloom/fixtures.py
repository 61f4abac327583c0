"""Surveillance tables derived from the generated star-schema tables.

Each view is plain SQL that Spark and the checking engine both read, so a query and
its check start from the same rows. Every view grows with the base tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("events", "customer", "nation", "orders", "part")

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "dim_country": ((), """
        SELECT * FROM (VALUES (0,'US'),(1,'GB'),(2,'CA'),(3,'DE'),(4,'FR'),(5,'AU'),(6,'JP'),
        (7,'SG'),(8,'NL'),(9,'CH'),(10,'BR'),(11,'IN'),(12,'MX'),(13,'ZA'),(14,'NG'),(15,'RU'),
        (16,'KP'),(17,'IR'),(18,'SY'),(19,'MM'),(20,'US'),(21,'GB'),(22,'CA'),(23,'DE'),(24,'FR')
        ) AS v(k, cc)"""),
    "dim_category": ((), """
        SELECT * FROM (VALUES (0,'groceries'),(1,'supermarket'),(2,'electronics'),
        (3,'restaurants'),(4,'clothing_retail'),(5,'gas_station'),(6,'digital_services'),
        (7,'airline_tickets'),(8,'hotel_lodging'),(9,'gambling'),(10,'cryptocurrency_exchange'),
        (11,'wire_transfer'),(12,'crypto'),(13,'jewelry'),(14,'travel'),(15,'pharmacy')
        ) AS v(k, cat)"""),
    "users_fx": (("dim_country",), """
        SELECT c.c_custkey AS id, c.c_name AS full_name,
          concat('u', CAST(CASE WHEN c.c_custkey % 211 = 0 THEN c.c_custkey + 1
                                ELSE c.c_custkey END AS STRING), '@example.com') AS email,
          d.cc AS country, (c.c_custkey % 2 = 0) AS is_seed_data,
          TIMESTAMP '2023-06-01 00:00:00' + c.c_custkey * INTERVAL 1 MINUTE AS created_at
        FROM customer c JOIN dim_country d ON d.k = c.c_nationkey"""),
    "txn": (("dim_country", "dim_category"), """
        SELECT e.event_id AS transaction_id, e.user_id,
          CAST(CAST(e.value AS DECIMAL(14,2)) * (CASE WHEN e.k % 10 = 0 THEN 200 ELSE 1 END)
               AS DECIMAL(14,2)) AS amount,
          CASE WHEN d.cc = 'US' THEN 'USD' WHEN d.cc IN ('DE','FR','NL') THEN 'EUR'
               WHEN d.cc = 'GB' THEN 'GBP' WHEN d.cc = 'CA' THEN 'CAD'
               WHEN d.cc = 'JP' THEN 'JPY' WHEN d.cc = 'AU' THEN 'AUD' ELSE 'USD' END AS currency,
          d.cc AS country, m.cat AS merchant_category, e.ts AS created_at,
          'SUBMITTED' AS status, concat('idem-', CAST(e.event_id AS STRING)) AS idempotency_key,
          CASE WHEN e.event_id % 500 = 1 THEN '{"demo_scenario": "velocity_burst"}' ELSE '{}' END
            AS metadata,
          concat('corr-', CAST(e.event_id AS STRING)) AS correlation_id
        FROM (SELECT event_id, user_id, ts, value,
                CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events) e
        JOIN customer c ON c.c_custkey = e.user_id
        JOIN dim_country d
          ON d.k = (CASE WHEN e.event_id % 20 = 7 THEN e.k % 25 ELSE c.c_nationkey END)
        JOIN dim_category m ON m.k = e.k % 16"""),
    "txn_submissions": (("txn",), """
        SELECT * FROM txn
        UNION ALL
        SELECT transaction_id + 100000000 AS transaction_id, user_id, amount, currency, country,
          merchant_category, created_at + INTERVAL 5 SECOND AS created_at, status,
          idempotency_key, metadata, correlation_id
        FROM txn WHERE transaction_id % 50 = 0"""),
    "risk_profiles_fx": ((), """
        SELECT c_custkey AS user_id,
          CAST(0.05 + (c_custkey % 31) * 0.03 AS DECIMAL(5,4)) AS risk_score,
          CAST(c_custkey % 6 AS INT) AS total_alerts,
          CAST(c_custkey % 3 AS INT) AS false_positive_count,
          TIMESTAMP '2024-01-01 00:00:00' + c_custkey * INTERVAL 1 MINUTE AS last_recalculated_at
        FROM customer WHERE c_custkey % 7 <> 0"""),
    "alerts_fx": (("txn",), """
        SELECT transaction_id AS id, transaction_id, user_id, 'PENDING' AS status,
          CASE WHEN amount >= 30000 THEN 'CRITICAL' WHEN amount >= 10000 THEN 'HIGH'
               WHEN amount >= 5000 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
          CAST(CASE WHEN amount >= 30000 THEN 0.9 WHEN amount >= 10000 THEN 0.75
               WHEN amount >= 5000 THEN 0.6 ELSE 0.3 END AS DECIMAL(5,4)) AS composite_risk_score,
          correlation_id, created_at + INTERVAL 1 SECOND AS created_at
        FROM txn WHERE amount >= 1000"""),
    "alerts_mix": (("alerts_fx",), """
        SELECT id, transaction_id, user_id,
          CASE id % 6 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'ESCALATED_EMAIL'
               WHEN 2 THEN 'ESCALATED_SLACK' WHEN 3 THEN 'APPROVED' WHEN 4 THEN 'BLOCKED'
               ELSE 'FALSE_POSITIVE' END AS status,
          severity, composite_risk_score, CAST(id % 97 AS DECIMAL(5,4)) / 100 AS ml_raw,
          CASE WHEN id % 11 = 0 THEN CAST(NULL AS STRING)
               ELSE concat('[{"rule_id":"r', CAST(id % 9 AS STRING), '"}]') END AS rule_matches,
          CASE WHEN id % 13 = 0 THEN CAST(NULL AS STRING)
               ELSE '{"total_alerts":1}' END AS risk_profile_snapshot,
          (id % 50 = 1) AS is_demo,
          CASE WHEN id % 6 >= 3 THEN concat('analyst_', CAST(id % 5 AS STRING)) END AS resolved_by,
          CASE WHEN id % 6 >= 3 THEN created_at + INTERVAL 20 MINUTE END AS resolved_at,
          CASE WHEN id % 6 = 5 THEN 'known customer' END AS resolution_reason,
          CASE WHEN id % 6 IN (1, 2) THEN created_at + INTERVAL 5 MINUTE END AS escalated_email_at,
          CASE WHEN id % 6 = 2 THEN created_at + INTERVAL 15 MINUTE END AS escalated_slack_at,
          correlation_id, created_at
        FROM alerts_fx"""),
    "actions_fx": (("alerts_fx",), """
        SELECT a.id * 10 + n.n AS action_id,
          CASE WHEN a.id % 41 = 0 THEN a.id + 900000000 ELSE a.id END AS alert_id,
          CASE WHEN (a.id + n.n) % 4 = 0 THEN 'APPROVED' WHEN (a.id + n.n) % 4 = 1 THEN 'BLOCKED'
               WHEN (a.id + n.n) % 4 = 2 THEN 'FALSE_POSITIVE' ELSE 'PENDING' END AS target_status,
          concat('analyst_', CAST(a.id % 5 AS STRING)) AS actor,
          CASE WHEN a.id % 3 = 0 THEN a.created_at + INTERVAL 3 MINUTE
               WHEN a.id % 3 = 1 THEN a.created_at + INTERVAL 9 MINUTE
               ELSE a.created_at + INTERVAL 40 MINUTE END AS acted_at,
          CASE WHEN a.id % 2 = 0 THEN concat('seen by ', CAST(a.id % 5 AS STRING)) END AS resolution_reason
        FROM alerts_fx a CROSS JOIN (VALUES (0),(1)) AS n(n) WHERE a.id % 7 <> 0"""),
    "fp_fx": (("alerts_mix",), """
        SELECT id AS event_id, id AS alert_id, user_id, resolved_at
        FROM alerts_mix WHERE status = 'FALSE_POSITIVE'"""),
    "history_fx": ((), """
        SELECT event_id AS change_id, user_id, ts + (event_id % 7) * INTERVAL 1 HOUR AS changed_at,
          CAST((event_id % 101) * 0.0099 AS DECIMAL(5,4)) AS risk_score
        FROM events"""),
    "rules_tab": ((), """
        SELECT concat('r', CAST(c_custkey AS STRING)) AS id, concat('Rule ', CAST(c_custkey AS STRING)) AS name,
          CASE WHEN c_custkey % 23 = 0 THEN 'UNKNOWN_TYPE' WHEN c_custkey % 5 = 0 THEN 'AMOUNT_THRESHOLD'
               WHEN c_custkey % 5 = 1 THEN 'HIGH_RISK_COUNTRY' WHEN c_custkey % 5 = 2 THEN 'VELOCITY'
               WHEN c_custkey % 5 = 3 THEN 'USER_RISK_LEVEL' ELSE 'MERCHANT_CATEGORY' END AS rule_type,
          CASE WHEN c_custkey % 29 = 0 THEN 'SEVERE' WHEN c_custkey % 4 = 0 THEN 'LOW'
               WHEN c_custkey % 4 = 1 THEN 'MEDIUM' WHEN c_custkey % 4 = 2 THEN 'HIGH'
               ELSE 'CRITICAL' END AS severity,
          (c_custkey % 4 <> 3) AS enabled,
          CASE c_custkey % 12
            WHEN 0 THEN concat('{"threshold":', CAST(1000 + c_custkey AS STRING), ',"currency":"usd"}')
            WHEN 1 THEN '{"threshold":0,"amount_threshold":"2500","operator":">"}'
            WHEN 2 THEN '{"threshold":"invalid_num"}'
            WHEN 3 THEN '{"countries":["ru"," kp "],"categories":["Gambling"]}'
            WHEN 4 THEN '{"countries":12345,"categories":"not-a-list"}'
            WHEN 5 THEN '{"countries":[],"country_codes":["IR","SY"],"blocked_categories":["crypto"]}'
            WHEN 6 THEN concat('{"max_count":', CAST(c_custkey % 9 AS STRING), ',"window_minutes":15}')
            WHEN 7 THEN '{"max_count":0,"count_threshold":4,"max_amount":"25000.5"}'
            WHEN 8 THEN '{"min_risk_score":0.35}'
            WHEN 9 THEN '{"risk_threshold":"0.5","limit":0}'
            WHEN 10 THEN '{}'
            ELSE concat('{"limit":', CAST(c_custkey AS STRING), '.75}') END AS parameters,
          TIMESTAMP '2023-06-01 00:00:00' + c_custkey * INTERVAL 1 MINUTE AS created_at
        FROM customer"""),
    "rules_next": (("rules_tab",), """
        SELECT id, name, rule_type,
          CASE WHEN CAST(substring(id, 2) AS BIGINT) % 10 = 2 THEN 'LOW' ELSE severity END AS severity,
          CASE WHEN CAST(substring(id, 2) AS BIGINT) % 10 = 3 THEN NOT enabled ELSE enabled END AS enabled,
          parameters, created_at
        FROM rules_tab WHERE CAST(substring(id, 2) AS BIGINT) % 10 <> 1
        UNION ALL
        SELECT concat(id, '-new') AS id, name, rule_type, severity, enabled, parameters, created_at
        FROM rules_tab WHERE CAST(substring(id, 2) AS BIGINT) % 10 = 4"""),
    "raw_submissions": (("txn",), """
        SELECT transaction_id AS submission_id,
          CASE WHEN transaction_id % 17 IN (1, 6) THEN '0'
               WHEN transaction_id % 34 = 2 THEN 'ten' WHEN transaction_id % 34 = 19 THEN '-1'
               ELSE CAST(amount AS STRING) END AS amount,
          CASE WHEN transaction_id % 17 IN (3, 6) THEN 'US1'
               WHEN transaction_id % 17 = 8 THEN CAST(NULL AS STRING)
               WHEN transaction_id % 17 = 9 THEN lower(currency) ELSE currency END AS currency,
          CASE WHEN transaction_id % 17 IN (4, 6) THEN 'USA'
               WHEN transaction_id % 17 = 9 THEN lower(country)
               ELSE country END AS country,
          CASE WHEN transaction_id % 17 IN (5, 6) THEN '' ELSE merchant_category END
            AS merchant_category,
          CASE WHEN transaction_id % 17 = 6 THEN CAST(NULL AS STRING)
               WHEN transaction_id % 17 = 7 THEN 'nobody'
               ELSE CAST(user_id AS STRING) END AS user_id,
          CASE WHEN transaction_id % 17 = 10 THEN repeat('k', 300)
               WHEN transaction_id % 17 = 11 THEN CAST(NULL AS STRING)
               ELSE idempotency_key END AS idempotency_key,
          CASE WHEN transaction_id % 17 = 12 THEN CAST(NULL AS STRING) ELSE metadata END AS metadata,
          CASE WHEN transaction_id % 17 = 13 THEN 'amount,country,merchant_category,user_id,note,channel'
               ELSE 'amount,currency,country,merchant_category,user_id,idempotency_key,metadata' END
            AS field_names,
          created_at
        FROM txn"""),
    "raw_messages": (("txn",), """
        SELECT transaction_id AS message_id,
          CASE WHEN transaction_id % 4 = 0 THEN body END AS event,
          CASE WHEN transaction_id % 4 = 1 THEN body END AS envelope,
          CASE WHEN transaction_id % 4 = 2 THEN body END AS data,
          CASE WHEN transaction_id % 4 = 3 THEN body END AS flat,
          created_at
        FROM (
          SELECT transaction_id, created_at,
            CASE WHEN transaction_id % 37 = 0 THEN '{"event_id": broken'
                 WHEN transaction_id % 43 = 0 THEN '{"event_id":"only"}'
                 ELSE concat('{"event_id":"e', CAST(transaction_id AS STRING),
                   '","correlation_id":"', correlation_id, '","event_type":"transaction.created"',
                   CASE WHEN transaction_id % 5 = 0 THEN '' ELSE ',"event_version":"1.0"' END,
                   ',"occurred_at":"2024-01-01T00:00:00","producer_service":"gateway"',
                   CASE WHEN transaction_id % 41 = 0 THEN ',"extra":1' ELSE '' END,
                   ',"payload":{"transaction_id":"', CAST(transaction_id AS STRING),
                   '","user_id":"', CAST(user_id AS STRING), '","amount":"', CAST(amount AS STRING),
                   '","country":"', country, '"}}') END AS body
          FROM txn) b"""),
    "outbox_fx": (("txn",), """
        SELECT transaction_id AS id,
          CASE transaction_id % 9 WHEN 0 THEN 'transaction.created' WHEN 1 THEN 'alert.created'
            WHEN 2 THEN 'alert.approved' WHEN 3 THEN 'alert.blocked'
            WHEN 4 THEN 'alert.false_positive' WHEN 5 THEN 'escalation.email.requested'
            WHEN 6 THEN 'escalation.slack.requested' WHEN 7 THEN 'risk_profile.recalculate'
            ELSE 'custom.event' END AS event_type,
          '1.0' AS event_version,
          CASE WHEN transaction_id % 9 = 8 THEN '"plain"'
               ELSE concat('{"', CASE WHEN transaction_id % 2 = 0 THEN 'alert_id' ELSE 'id' END,
                 '":"', CAST(transaction_id AS STRING), '"',
                 CASE WHEN transaction_id % 3 = 0 THEN ',"status":"BLOCKED"' ELSE '' END,
                 CASE WHEN transaction_id % 7 = 0 THEN ',"target_status":"APPROVED"' ELSE '' END,
                 ',"transaction_id":"', CAST(transaction_id AS STRING), '","severity":"HIGH"}') END
            AS payload,
          correlation_id, 'gateway' AS producer_service,
          CASE WHEN transaction_id % 5 = 0 THEN 'PENDING'
               WHEN transaction_id % 53 = 1 THEN 'DEAD_LETTERED' ELSE 'PUBLISHED' END AS status,
          CAST(transaction_id % 4 AS INT) AS retry_count, created_at
        FROM txn"""),
    "inbox_fx": (("txn",), """
        SELECT transaction_id AS event_id, 'processor-group' AS consumer_group, created_at AS processed_at
        FROM txn WHERE transaction_id % 3 = 0
        UNION ALL
        SELECT transaction_id AS event_id, 'gateway-notify-group' AS consumer_group, created_at AS processed_at
        FROM txn WHERE transaction_id % 4 = 0"""),
    "attempts_fx": (("txn", ), """
        SELECT t.transaction_id AS event_id, n.n AS attempt_no, 'alert.created' AS event_type,
          (n.n > t.transaction_id % 10) AS succeeded,
          t.created_at + n.n * INTERVAL 1 SECOND AS attempted_at
        FROM txn t JOIN (VALUES (1),(2),(3),(4),(5),(6),(7),(8)) AS n(n)
          ON n.n <= (t.transaction_id % 10) + CASE WHEN t.transaction_id % 3 = 0 THEN 0 ELSE 1 END"""),
    "deliveries_fx": (("txn",), """
        SELECT transaction_id AS message_id, 'stream:transactions' AS stream, 'processor-group' AS consumer_group,
          created_at AS delivered_at
        FROM txn
        UNION ALL
        SELECT transaction_id AS message_id, 'stream:transactions' AS stream, 'processor-group' AS consumer_group,
          created_at + INTERVAL 40 SECOND AS delivered_at
        FROM txn WHERE transaction_id % 8 = 0"""),
    "acks_fx": (("txn",), """
        SELECT transaction_id AS message_id, 'stream:transactions' AS stream, 'processor-group' AS consumer_group
        FROM txn WHERE transaction_id % 5 <> 0"""),
    "audit_fx": (("alerts_mix",), """
        SELECT concat('a', CAST(id AS STRING)) AS id,
          COALESCE(resolved_by, 'system:escalation_scheduler') AS actor,
          concat('alert.', lower(status)) AS action, 'Alert' AS entity_type,
          CAST(id AS STRING) AS entity_id, correlation_id, created_at + INTERVAL 30 MINUTE AS created_at
        FROM alerts_mix WHERE status <> 'PENDING'"""),
    "processed_fx": (("txn",), """
        SELECT transaction_id, user_id,
          CASE WHEN transaction_id % 31 = 0 THEN 'PROCESSING_FAILED'
               WHEN transaction_id % 9 = 0 THEN 'PROCESSING' ELSE 'PROCESSED' END AS status,
          CASE WHEN transaction_id % 3 = 0 THEN 'db_commit' WHEN transaction_id % 3 = 1
               THEN 'ml_inference' ELSE CAST(NULL AS STRING) END AS stage,
          created_at,
          CASE WHEN transaction_id % 9 <> 0
               THEN created_at + (transaction_id % 12007) * INTERVAL 1 MILLISECOND END AS processed_at
        FROM txn"""),
}


def with_views(*names: str) -> str:
    """A WITH clause defining the views and everything they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for dep in VIEWS[name][0]:
            add(dep)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in ordered)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the base tables of `sf_dir`."""
    text = with_views(name)
    for base in BASE_TABLES:
        if f" {base}" in text:
            table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(f"{text} SELECT * FROM {name}")


# Seeded rules (fixed values).
SEEDED_RULES = [
    ("11111111-1111-1111-1111-111111111101", "OFAC Embargoed / High Risk Countries",
     "HIGH_RISK_COUNTRY", "CRITICAL", '{"countries": ["RU", "KP", "IR", "SY", "MM"]}'),
    ("11111111-1111-1111-1111-111111111102", "Extreme Value Wire Transfer",
     "AMOUNT_THRESHOLD", "CRITICAL", '{"threshold": 30000.00, "operator": ">="}'),
    ("11111111-1111-1111-1111-111111111103", "High Value Transfer Threshold",
     "AMOUNT_THRESHOLD", "HIGH", '{"threshold": 10000.00, "operator": ">="}'),
    ("11111111-1111-1111-1111-111111111104", "High-Risk Merchant Monitoring",
     "MERCHANT_CATEGORY", "HIGH",
     '{"categories": ["cryptocurrency_exchange", "wire_transfer", "gambling"]}'),
    ("11111111-1111-1111-1111-111111111105", "Rapid Burst Velocity Window",
     "VELOCITY", "HIGH", '{"count_threshold": 5, "window_minutes": 10}'),
    ("11111111-1111-1111-1111-111111111106", "Moderate Amount Surveillance",
     "AMOUNT_THRESHOLD", "MEDIUM", '{"threshold": 5000.00, "operator": ">="}'),
    ("11111111-1111-1111-1111-111111111107", "Digital Services / Electronics Burst",
     "MERCHANT_CATEGORY", "MEDIUM", '{"categories": ["digital_services", "electronics"]}'),
    ("11111111-1111-1111-1111-111111111108", "Elevated User Risk Profile Sentinel",
     "USER_RISK_LEVEL", "LOW", '{"min_risk_score": 0.35}'),
    ("11111111-1111-1111-1111-111111111109", "Minor Foreign Currency Transfer Notice",
     "AMOUNT_THRESHOLD", "LOW", '{"threshold": 1000.00, "operator": ">="}'),
]


def seeded_rules(spark: SparkSession) -> DataFrame:
    """The default rule set, in evaluation order."""
    rows = [(*rule, True, order) for order, rule in enumerate(SEEDED_RULES, start=1)]
    return spark.createDataFrame(
        rows,
        "id string, name string, rule_type string, severity string, parameters string,"
        " enabled boolean, rule_order int",
    )
