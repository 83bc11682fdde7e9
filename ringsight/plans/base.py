"""Registry and the SQL tables that the oracles share."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

DEV = "CASE WHEN device_info IS NOT NULL THEN device_info || '|' || browser END"
ADDR = "CASE WHEN addr1 IS NOT NULL AND email_domain IS NOT NULL THEN addr1 || '|' || addr2 || '|' || email_domain END"
SPEC = "coalesce(device_info NOT IN ('Windows','iOS Device','MacOS','Linux','Trident/7.0','other') AND regexp_matches(device_info, '[0-9 ]'), false)"
BUCKET = "CASE WHEN score >= 0.8::DOUBLE THEN 4 WHEN score >= 0.6::DOUBLE THEN 3 WHEN score >= 0.4::DOUBLE THEN 2 WHEN score >= 0.2::DOUBLE THEN 1 ELSE 0 END"


def hmac_sql(secret: bytes, value: str) -> str:
    key = secret.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({value}))))"


CTES = f"""WITH txn AS (
  SELECT event_id AS txn_id, CAST(floor(epoch(ts)) AS BIGINT) - 1704067200 AS t, value AS amount,
    CAST(floor(user_id / 2) AS BIGINT) + (k % 3) * 100000 AS card1, CAST(user_id AS BIGINT) AS account,
    CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(user_id % 40 AS BIGINT) END AS addr1, CAST(k % 4 AS BIGINT) AS addr2,
    CASE event_type WHEN 'view' THEN CASE WHEN k % 2 = 1 THEN 'mail.com' ELSE 'aim.com' END WHEN 'click' THEN CASE WHEN k % 2 = 1 THEN 'gmail.com' ELSE 'live.com.mx' END
      WHEN 'purchase' THEN CASE WHEN k % 2 = 1 THEN 'protonmail.com' ELSE 'outlook.es' END WHEN 'error' THEN CASE WHEN k % 2 = 1 THEN 'outlook.com' ELSE 'hotmail.es' END END AS email_domain,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN ['Windows','iOS Device','MacOS','Linux','Trident/7.0','other'][(k // 5) % 6 + 1] ELSE concat('D', k, ' ', event_type) END AS device_info,
    concat('browser ', k % 3) AS browser, least(value / 200.0, CAST(0.999 AS DOUBLE)) AS score,
    CASE WHEN (value > 100 AND event_id % 3 <> 0) OR event_id % 29 = 0 THEN 1 ELSE 0 END AS is_fraud, CAST(event_id % 6 AS BIGINT) AS shop
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
ident AS (SELECT txn_id, device_info, browser FROM txn WHERE txn_id % 4 = 0),
sp AS (SELECT txn.*, CASE WHEN t <= q[1] THEN 'train' WHEN t <= q[2] THEN 'val' ELSE 'test' END AS split
       FROM txn, (SELECT quantile_cont(t, [0.7, 0.85]) AS q FROM txn)),
rr AS (SELECT txn.*, t // 86400 AS day, card1 % 8 AS merchant, 'device' AS kind, {DEV} AS key, account AS member FROM txn WHERE {SPEC}
       UNION ALL SELECT txn.*, t // 86400, card1 % 8, 'address', {ADDR}, card1 FROM txn WHERE {ADDR} IS NOT NULL),
ring AS (SELECT kind, key, day, count(*) AS txns, count(DISTINCT member) AS members, count(DISTINCT card1) AS cards, count(DISTINCT account) AS accounts, count(DISTINCT merchant) AS merchants, avg(score) AS score_mean, max(score) AS score_max,
       avg(CASE WHEN score >= 0.5::DOUBLE THEN 1 ELSE 0 END) AS hot_share, sum(amount) AS amount, min(t) AS t0, max(t) AS t1, CAST(sum(is_fraud) AS BIGINT) AS frauds,
       greatest((max(t) - min(t)) / 3600, 1.0::DOUBLE / 60) AS span_h FROM rr GROUP BY ALL),
win AS (SELECT * FROM ring WHERE members BETWEEN 2 AND 25),
hist AS (SELECT merchant, kind, {hmac_sql(b"ring-salt", "kind || '|' || key || '|' || day")}[1:16] AS fp,
       {', '.join(f'CAST(count(*) FILTER (WHERE {BUCKET} = {i}) AS DOUBLE) AS b{i}' for i in range(5))} FROM rr GROUP BY ALL),
fsum AS (SELECT kind, fp, {', '.join(f'sum(b{i}) AS b{i}' for i in range(5))}, count(*) AS merchants, sum(b0 + b1 + b2 + b3 + b4) AS txns,
       sum(b0 + 3 * b1 + 5 * b2 + 7 * b3 + 9 * b4) / (10 * greatest(sum(b0 + b1 + b2 + b3 + b4), 1)) AS risk_est FROM hist GROUP BY ALL),
exact AS (SELECT kind, key, day, count(*) AS txns, count(DISTINCT merchant) AS merchants, CAST(sum(is_fraud) AS BIGINT) AS frauds, {', '.join(f'CAST(count(*) FILTER (WHERE {BUCKET} = {i}) AS DOUBLE) AS b{i}' for i in range(5))},
       sum(CASE {BUCKET} WHEN 0 THEN 0.1::DOUBLE WHEN 1 THEN 0.3::DOUBLE WHEN 2 THEN 0.5::DOUBLE WHEN 3 THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END) / count(*) AS risk_est FROM rr GROUP BY ALL)
"""


def query(sql: str | None = None, extra: str = ""):
    """Register a function as a query under its name; ``sql`` follows the shared tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = CTES + (f", {extra} " if extra else "") + sql
        return f

    return add
