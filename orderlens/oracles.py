"""DuckDB SQL for the registered queries, written independently of the Spark plans.

The star schema is spelled out as common table expressions over the raw tables;
each oracle appends its own final query. The nearest-order rule is checked the
plain way: all pairs in reach, best one per mail.
"""

from __future__ import annotations

from .constants import (
    CATEGORICAL_FEATURES, COMPLAINT_KEYWORDS, NUMERIC_FEATURES, SPAM_KEYWORDS, TARGETS, THEME_KEYWORDS,
)

_SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\p{Z}]+"
_WORD = r"\p{L}\p{N}_"
_REFERENCE = rf"(?:^|[^{_WORD}])([0-9]{{10}})(?:$|[^{_WORD}])"


def _clean(expr: str) -> str:
    stripped = rf"regexp_replace({expr}::varchar, '^{_SPACE}|{_SPACE}$', '', 'g')"
    return f"CASE WHEN {stripped} NOT IN ('<NA>', 'nan', 'None', '') THEN {stripped} END"


def _key(prefix: str, *parts: str) -> str:
    joined = " || '||' || ".join([f"'{prefix}'", *[f"coalesce({p}::varchar, '')" for p in parts]])
    return f"left(sha1({joined}), 16)"


def _row_key(*parts: str) -> str:
    joined = " || '||' || ".join([f"coalesce({p}::varchar, '')" for p in parts])
    return f"left(sha1({joined}), 16)"


def _at(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def _days(later: str, earlier: str) -> str:
    return f"floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000)::bigint"


def _words(expr: str, words: list[str]) -> str:
    return f"regexp_matches(lower({expr}), '{'|'.join(words)}')"


_SEARCHABLE = " || ' ' || ".join(
    f"coalesce({c}, '')" for c in ["subject", "body", "vendor", "from_company"]
)
_ORDER_ID = "lpad({}::varchar, 10, '0')"
_NAME = "'Customer#' || lpad({}::varchar, 9, '0')"

CTES: dict[str, str] = {
    "communications": f"""
        SELECT CASE WHEN event_type = 'signup' THEN ' nan '
                    ELSE '<' || user_id || '-' || regexp_extract(props, '"k": *([0-9]+)', 1)
                         || '@mail>' END AS message_id,
               CASE WHEN event_type IN ('purchase', 'view') THEN 'desk@orders.example'
                    ELSE 'user' || user_id || '@client.example' END AS from_email,
               CASE WHEN event_type IN ('purchase', 'click')
                    THEN 'user' || user_id || '@client.example'
                    ELSE 'desk@orders.example' END AS to_email,
               CASE event_type
                    WHEN 'error' THEN 'Delivery issue on order ' || {_ORDER_ID.format('event_id')}
                    WHEN 'purchase' THEN 'Order ' || {_ORDER_ID.format('event_id')} || ' confirmed'
                    WHEN 'click' THEN 'Click here for a Special Offer'
                    WHEN 'view' THEN 'Status update' END AS subject,
               d.text AS body,
               ts - INTERVAL 25 YEAR AS timestamp,
               CASE WHEN event_type = 'signup' THEN 'NEW-' || user_id
                    WHEN event_type <> 'view' THEN '  ' || user_id || ' ' END AS customer_id,
               'Vendor' || event_id AS vendor,
               CASE WHEN event_type <> 'view' THEN 'Client' END AS from_company,
               CASE WHEN event_type = 'error' THEN 'User ' || user_id END AS from_name,
               NULL::varchar AS to_name,
               CASE WHEN event_type = 'purchase' THEN {_NAME.format('user_id')} END AS customer_name
        FROM events LEFT JOIN documents d
          ON d.doc_id = event_id % (SELECT count(*) FROM documents)""",
    "mail_base": rf"""
        SELECT *, {_clean('message_id')} AS source_message_id,
               {_clean('customer_id')} AS customer_id_clean,
               nullif(regexp_extract(coalesce(subject, '') || ' ' || coalesce(body, ''),
                                     '{_REFERENCE}', 1), '') AS linked_order_id,
               {_key('email', 'message_id', 'timestamp', 'from_email', 'to_email', 'subject')}
                   AS canonical_message_id,
               CASE WHEN from_email LIKE '%@orders.example' AND to_email LIKE '%@orders.example'
                    THEN 'internal'
                    WHEN to_email LIKE '%@orders.example' THEN 'external_inbound'
                    WHEN from_email LIKE '%@orders.example' THEN 'external_outbound'
                    ELSE 'mixed' END AS message_scope,
               {_words(_SEARCHABLE, SPAM_KEYWORDS)} AS is_spam_like,
               {_words(_SEARCHABLE, COMPLAINT_KEYWORDS)} AS is_complaint_like,
               timestamp::date::varchar AS event_date,
               left(regexp_replace(coalesce(body, ''), '{_SPACE}', ' ', 'g'), 280) AS body_preview
        FROM communications""",
    "fact_email": """
        SELECT *, count(*) OVER (PARTITION BY source_message_id) > 1 AS is_duplicate_source_id
        FROM mail_base""",
    "supporting": f"""
        SELECT 'LI-' || l_orderkey || '-' || l_linenumber AS document_id,
               CASE WHEN l_returnflag = 'R' THEN 'CREDIT_MEMO'
                    WHEN l_returnflag = 'A' THEN 'QUALITY_REPORT'
                    WHEN l_linestatus = 'F' THEN 'INVOICE' ELSE 'SHIPPING_NOTICE' END
                   AS document_type,
               {_ORDER_ID.format('l_orderkey')} AS order_number, ' ' || o_custkey AS customer_id,
               {_NAME.format('o_custkey')} AS customer_name, o_orderdate AS order_date,
               l_shipdate AS typed_date,
               CASE WHEN l_returnflag = 'N' AND l_linestatus <> 'F'
                    THEN o_orderdate + INTERVAL 30 DAY END AS expected_delivery,
               CASE WHEN l_returnflag = 'N' AND l_linestatus <> 'F' THEN l_shipdate END
                   AS actual_delivery,
               CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' AND l_linenumber <> 2
                    THEN l_extendedprice END AS billed,
               floor(round(l_extendedprice * 100)::bigint * round((1 - l_discount) * 100)::bigint / 100) / 100 AS total,
               CASE WHEN l_returnflag = 'R' 
                    THEN floor(round(l_extendedprice * 100)::bigint * round(l_tax * 100)::bigint / 100) / 100 END AS credit
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        UNION ALL
        SELECT 'PO-' || o_orderkey, 'PURCHASE_ORDER', {_ORDER_ID.format('o_orderkey')},
               o_custkey::varchar, {_NAME.format('o_custkey')}, o_orderdate, o_orderdate,
               NULL, NULL, o_totalprice, NULL, NULL
        FROM orders""",
    "fact_document": rf"""
        SELECT order_number AS order_id, {_clean('customer_id')} AS customer_id_clean,
               document_id AS source_document_id, 'supporting_documents' AS source_dataset,
               document_type,
               {_key('supporting', 'document_id', 'document_type', 'order_number', 'customer_id')}
                   AS canonical_document_id,
               count(*) OVER (PARTITION BY document_id) > 1 AS is_duplicate_source_id,
               CASE WHEN document_type = 'CREDIT_MEMO' THEN order_date ELSE typed_date END
                   AS event_timestamp,
               event_timestamp::date::varchar AS event_date,
               coalesce(billed, 0.0) AS revenue_amount, coalesce(total, 0.0) AS cost_amount,
               coalesce(credit, 0.0) AS refund_amount,
               {_days('actual_delivery', 'expected_delivery')} AS delivery_lag_days,
               document_type || ' for order ' || order_number || ', customer ' || customer_name
                   AS content_summary,
               customer_name, NULL::varchar AS content
        FROM supporting
        UNION ALL
        SELECT NULL, NULL, 'DOC-' || doc_id, 'business_documents', source,
               {_key('business', "chr(9) || 'DOC-' || doc_id || ' '", 'source', 'NULL')},
               count(*) OVER (PARTITION BY doc_id) > 1, NULL, NULL, 0.0, 0.0, 0.0, NULL,
               left(regexp_replace(text, '{_SPACE}', ' ', 'g'), 280), NULL, text
        FROM documents""",
    "lines": f"""
        SELECT {_ORDER_ID.format('l_orderkey')} AS order_id, o_orderdate AS created,
               CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey::varchar END AS customer, lpad(l_linenumber::varchar, 4, '0') AS item,
               lpad(l_partkey::varchar, 6, '0') AS product, 'PL' || l_suppkey AS plant,
               l_returnflag || l_linestatus AS point
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "heads": """
        SELECT order_id, customer AS customer_id_clean, plant AS primary_plant,
               product AS primary_product
        FROM lines
        QUALIFY row_number() OVER (PARTITION BY order_id
                                   ORDER BY created, item, product, plant, customer) = 1""",
    "order_rollup": """
        SELECT order_id, min(created) AS order_created_at,
               count(DISTINCT item) AS order_line_count,
               count(DISTINCT product) AS product_nunique, count(DISTINCT plant) AS plant_nunique,
               count(DISTINCT point) AS shipping_point_nunique,
               any_value(customer_id_clean) AS customer_id_clean,
               any_value(primary_plant) AS primary_plant,
               any_value(primary_product) AS primary_product
        FROM lines JOIN heads USING (order_id) GROUP BY order_id""",
    "complaints": f"""
        SELECT order_id, count(*) AS complaint_email_count, max(seen_at) AS latest_complaint_at
        FROM (SELECT m.n, m.seen_at, o.order_id
              FROM (SELECT row_number() OVER () AS n, customer_id_clean, timestamp AS seen_at
                    FROM fact_email
                    WHERE is_complaint_like AND customer_id_clean IS NOT NULL
                      AND message_scope IN ('external_inbound', 'mixed')) m
              JOIN order_rollup o USING (customer_id_clean)
              WHERE abs(epoch_us(m.seen_at) - epoch_us(o.order_created_at)) <= 60 * 86400000000
              QUALIFY row_number() OVER (
                  PARTITION BY m.n
                  ORDER BY abs(epoch_us(m.seen_at) - epoch_us(o.order_created_at)),
                           o.order_created_at <= m.seen_at DESC,
                           CASE WHEN o.order_created_at <= m.seen_at THEN order_id END DESC,
                           order_id) = 1)
        GROUP BY order_id""",
    "doc_totals": """
        SELECT order_id, count(*) AS document_count, sum(revenue_amount) AS revenue_total,
               sum(cost_amount) AS cost_total, sum(refund_amount) AS refund_total,
               count_if(document_type = 'SHIPPING_NOTICE') AS shipping_notice_count,
               count_if(document_type = 'INVOICE') AS invoice_count,
               count_if(document_type = 'QUALITY_REPORT') AS quality_report_count,
               count_if(document_type = 'CREDIT_MEMO') AS credit_memo_count,
               count_if(delivery_lag_days > 0) AS delayed_shipments,
               max(delivery_lag_days) AS max_delivery_lag_days,
               max(event_timestamp) AS latest_document_at
        FROM fact_document WHERE source_dataset = 'supporting_documents' GROUP BY order_id""",
    "mail_totals": """
        SELECT linked_order_id AS order_id, count(*) AS linked_email_count,
               count_if(is_spam_like) AS spam_email_count, max(timestamp) AS latest_email_at
        FROM fact_email WHERE linked_order_id IS NOT NULL GROUP BY linked_order_id""",
    "fact_order": f"""
        SELECT r.*, coalesce(d.document_count, 0)::bigint AS document_count,
               coalesce(d.revenue_total, 0) AS revenue_total,
               coalesce(d.cost_total, 0) AS cost_total, coalesce(d.refund_total, 0) AS refund_total,
               coalesce(d.shipping_notice_count, 0)::bigint AS shipping_notice_count,
               coalesce(d.invoice_count, 0)::bigint AS invoice_count,
               coalesce(d.quality_report_count, 0)::bigint AS quality_report_count,
               coalesce(d.credit_memo_count, 0)::bigint AS credit_memo_count,
               coalesce(d.delayed_shipments, 0)::bigint AS delayed_shipments,
               coalesce(d.max_delivery_lag_days, 0)::bigint AS max_delivery_lag_days,
               d.latest_document_at,
               coalesce(m.linked_email_count, 0)::bigint AS linked_email_count,
               coalesce(m.spam_email_count, 0)::bigint AS spam_email_count, m.latest_email_at,
               coalesce(c.complaint_email_count, 0)::bigint AS complaint_email_count,
               c.latest_complaint_at,
               coalesce(d.invoice_count, 0) > 0 AS has_invoice,
               coalesce(d.shipping_notice_count, 0) > 0 AS has_shipping_notice,
               coalesce(d.quality_report_count, 0) > 0 AS has_quality_report,
               coalesce(d.credit_memo_count, 0) > 0 AS has_credit_memo,
               coalesce(m.linked_email_count, 0) > 0 AS has_linked_email,
               coalesce(d.max_delivery_lag_days, 0) > 0 AS will_be_delayed,
               coalesce(d.credit_memo_count, 0) > 0 AS will_generate_credit_memo,
               coalesce(c.complaint_email_count, 0) > 0 AS will_generate_complaint,
               coalesce({_days('greatest(d.latest_document_at, m.latest_email_at)',
                               'r.order_created_at')}, 0) AS event_span_days,
               strftime(r.order_created_at, '%Y-%m') AS order_month
        FROM order_rollup r LEFT JOIN doc_totals d USING (order_id)
        LEFT JOIN mail_totals m USING (order_id) LEFT JOIN complaints c USING (order_id)""",
    "names": """
        SELECT customer_id_clean, min(customer_name) AS customer_name
        FROM (SELECT customer_id_clean, customer_name FROM fact_email
              UNION SELECT customer_id_clean, customer_name FROM fact_document)
        WHERE customer_id_clean IS NOT NULL AND customer_name IS NOT NULL
        GROUP BY customer_id_clean""",
    "dim_customer": """
        SELECT coalesce(o.customer_id_clean, e.customer_id_clean) AS customer_id_clean,
               coalesce(order_count, 0) AS order_count,
               coalesce(linked_order_count, 0)::bigint AS linked_order_count,
               coalesce(delayed_order_count, 0)::bigint AS delayed_order_count,
               coalesce(complaint_order_count, 0)::bigint AS complaint_order_count,
               coalesce(credit_order_count, 0)::bigint AS credit_order_count,
               coalesce(invoice_total, 0) AS invoice_total,
               coalesce(credit_total, 0) AS credit_total,
               coalesce(avg_line_count, 0) AS avg_line_count, latest_order_at,
               coalesce(email_count, 0) AS email_count,
               coalesce(complaint_email_count, 0)::bigint AS complaint_email_count,
               coalesce(spam_email_count, 0)::bigint AS spam_email_count, latest_email_at,
               coalesce(document_count, 0) AS document_count,
               coalesce(quality_report_count, 0)::bigint AS quality_report_count,
               customer_name,
               CASE WHEN order_count > 0
                    THEN (delayed_order_count + complaint_order_count + credit_order_count)
                         / order_count ELSE 0.0 END AS issue_rate,
               coalesce(customer_name, o.customer_id_clean, e.customer_id_clean, 'unlinked')
                   AS customer_label
        FROM (SELECT customer_id_clean, count(order_id) AS order_count,
                     count_if(has_linked_email) AS linked_order_count,
                     count_if(will_be_delayed) AS delayed_order_count,
                     count_if(will_generate_complaint) AS complaint_order_count,
                     count_if(will_generate_credit_memo) AS credit_order_count,
                     sum(revenue_total) AS invoice_total, sum(refund_total) AS credit_total,
                     avg(order_line_count) AS avg_line_count,
                     max(order_created_at) AS latest_order_at
              FROM fact_order GROUP BY customer_id_clean) o
        FULL JOIN (SELECT customer_id_clean, count(*) AS email_count,
                          count_if(is_complaint_like) AS complaint_email_count,
                          count_if(is_spam_like) AS spam_email_count,
                          max(timestamp) AS latest_email_at
                   FROM fact_email GROUP BY customer_id_clean) e
          ON o.customer_id_clean IS NOT DISTINCT FROM e.customer_id_clean
        LEFT JOIN (SELECT customer_id_clean, count(*) AS document_count,
                          count_if(document_type = 'QUALITY_REPORT') AS quality_report_count
                   FROM fact_document GROUP BY customer_id_clean) d
          ON d.customer_id_clean IS NOT DISTINCT FROM
             coalesce(o.customer_id_clean, e.customer_id_clean)
        LEFT JOIN names n
          ON n.customer_id_clean = coalesce(o.customer_id_clean, e.customer_id_clean)""",
    "timeline_rows": """
        SELECT order_id, customer_id_clean, order_created_at AS event_timestamp,
               'order_created' AS event_type, 'Order created' AS title,
               coalesce(order_id, 'unknown') AS detail, 'fact_order' AS source_table
        FROM fact_order
        UNION ALL
        SELECT linked_order_id, customer_id_clean, timestamp,
               CASE WHEN message_scope = 'internal' THEN 'internal_email' ELSE 'email' END,
               subject, body_preview, 'fact_email' FROM fact_email
        UNION ALL
        SELECT order_id, customer_id_clean, event_timestamp, 'document', document_type,
               content_summary, 'fact_document' FROM fact_document""",
    "fact_event_timeline": f"""
        SELECT *, event_timestamp::date::varchar AS event_date,
               {_row_key('order_id', 'customer_id_clean', 'event_timestamp', 'title')} AS event_id
        FROM timeline_rows""",
    "fact_customer_daily": """
        SELECT customer_id_clean, date_trunc('day', event_timestamp)::timestamp AS event_date,
               CASE source_table WHEN 'fact_order' THEN 'order' WHEN 'fact_email' THEN 'email'
                    ELSE 'document' END AS kind, count(*) AS event_count
        FROM timeline_rows WHERE event_timestamp IS NOT NULL GROUP BY ALL""",
    "features": """
        SELECT *, left(primary_product, 3) AS primary_product_family,
               year(order_created_at)::int AS order_year,
               month(order_created_at)::int AS order_month_num,
               quarter(order_created_at)::int AS order_quarter,
               row_number() OVER c - 1 AS customer_prior_orders,
               sum(will_generate_complaint::int) OVER c - will_generate_complaint::int AS pc,
               sum(will_be_delayed::int) OVER c - will_be_delayed::int AS pd,
               sum(will_generate_credit_memo::int) OVER c - will_generate_credit_memo::int AS pm,
               row_number() OVER p - 1 AS plant_prior_orders,
               sum(will_be_delayed::int) OVER p - will_be_delayed::int AS pp
        FROM fact_order
        WINDOW c AS (PARTITION BY customer_id_clean ORDER BY order_created_at, order_id
                     ROWS UNBOUNDED PRECEDING),
               p AS (PARTITION BY primary_plant ORDER BY order_created_at, order_id
                     ROWS UNBOUNDED PRECEDING)""",
    "scores": f"""
        SELECT {_ORDER_ID.format('o_orderkey')} AS order_id,
               CASE WHEN o_orderkey % 50 <> 0 THEN o_custkey::varchar END AS customer_id_clean,
               o_orderdate AS order_created_at, {', '.join(
                   f"((round(o_totalprice * 100)::bigint * {i + 3}) % 1000) / 1000 AS {t}_score"
                   for i, t in enumerate(TARGETS))}
        FROM orders""",
    "months": """
        SELECT m.month, coalesce(n, 0) AS complaint_orders,
               lag(coalesce(n, 0)) OVER (ORDER BY m.month) AS previous_orders
        FROM (SELECT unnest(generate_series(date_trunc('month', min(order_created_at))::timestamp,
                                            max(order_created_at), INTERVAL 1 MONTH)) AS month
              FROM fact_order) m
        LEFT JOIN (SELECT date_trunc('month', order_created_at)::timestamp AS month,
                          count_if(will_generate_complaint) AS n
                   FROM fact_order GROUP BY 1) c USING (month)""",
    "texts": """
        SELECT 'document:' || doc_id AS doc_id, text FROM documents
        UNION ALL SELECT 'turn:' || conv_id || ':' || turn, text FROM conversations""",
}


def star(final: str) -> str:
    """final with the expressions it (indirectly) names in front of it."""
    names = list(CTES)
    needed: list[str] = []
    wanted = final
    for name in reversed(names):
        if _mentions(wanted, name):
            needed.insert(0, name)
            wanted += CTES[name]
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + final


def _mentions(sql: str, name: str) -> bool:
    words = sql.replace("(", " ").replace(")", " ").replace(",", " ").split()
    return any(
        words[i] == name and words[i - 1].upper() in ("FROM", "JOIN") for i in range(1, len(words))
    )


_ORDER_COLUMNS = f"""
    order_id, {_at('order_created_at')} AS order_created_at, order_line_count, product_nunique,
    plant_nunique, shipping_point_nunique, customer_id_clean, primary_plant, primary_product"""

_RISK = [f"{t}_score" for t in TARGETS]
_MEAN_ALL = "(" + " + ".join(f"coalesce({c}, 0)" for c in _RISK) + ") / 3"
_SHARE = "count_if({})::double / count(*)"
_SAME_ORDER = " AND ".join(
    f"f.{k} IS NOT DISTINCT FROM s.{k}" for k in ["order_id", "customer_id_clean", "order_created_at"]
)
_BY_ISSUE = "ORDER BY issue_rate DESC, order_count DESC, customer_id_clean ASC NULLS LAST"

ORACLES: dict[str, str] = {
    "email_fact": star(f"""
        SELECT message_id, from_email, to_email, NULL::varchar AS cc_recipients,
               {_at('timestamp')} AS timestamp, source_message_id, customer_id_clean,
               linked_order_id, canonical_message_id, message_scope, is_spam_like,
               is_complaint_like, is_duplicate_source_id, event_date, body_preview
        FROM fact_email"""),
    "document_fact": star(f"""
        SELECT order_id, customer_id_clean, source_document_id, source_dataset, document_type,
               canonical_document_id, is_duplicate_source_id,
               {_at('event_timestamp')} AS event_timestamp, event_date,
               round(revenue_amount, 4) AS revenue_amount, round(cost_amount, 4) AS cost_amount,
               round(refund_amount, 4) AS refund_amount, delivery_lag_days, content_summary
        FROM fact_document"""),
    "order_rollup": star(f"SELECT {_ORDER_COLUMNS} FROM order_rollup"),
    "complaints_by_order": star(f"""
        SELECT order_id, complaint_email_count, {_at('latest_complaint_at')} AS latest_complaint_at
        FROM complaints"""),
    "nearest_purchase": f"""
        WITH probes AS (SELECT user_id, ts, count(*) AS probe_count FROM events
                        WHERE event_type = 'error' GROUP BY ALL)
        SELECT e.user_id AS user, {_at('e.ts')} AS seen_at, probe_count, p.event_id
        FROM probes e JOIN events p
          ON p.user_id = e.user_id AND p.event_type = 'purchase'
         AND abs(epoch_us(p.ts) - epoch_us(e.ts)) <= 12 * 3600000000
        QUALIFY row_number() OVER (
            PARTITION BY e.user_id, e.ts
            ORDER BY abs(epoch_us(p.ts) - epoch_us(e.ts)), p.ts <= e.ts DESC,
                     CASE WHEN p.ts <= e.ts THEN p.event_id END DESC, p.event_id) = 1""",
    "order_fact": star(f"""
        SELECT {_ORDER_COLUMNS}, document_count, round(revenue_total, 4) AS revenue_total,
               round(cost_total, 4) AS cost_total, round(refund_total, 4) AS refund_total,
               shipping_notice_count, invoice_count, quality_report_count, credit_memo_count,
               delayed_shipments, max_delivery_lag_days,
               {_at('latest_document_at')} AS latest_document_at, linked_email_count,
               spam_email_count, {_at('latest_email_at')} AS latest_email_at,
               complaint_email_count, {_at('latest_complaint_at')} AS latest_complaint_at,
               has_invoice, has_shipping_notice, has_quality_report, has_credit_memo,
               has_linked_email, will_be_delayed, will_generate_credit_memo,
               will_generate_complaint, event_span_days, order_month
        FROM fact_order"""),
    "customer_dim": star(f"""
        SELECT * REPLACE (round(invoice_total, 4) AS invoice_total,
                          round(credit_total, 4) AS credit_total,
                          round(avg_line_count, 4) AS avg_line_count,
                          round(issue_rate, 4) AS issue_rate,
                          {_at('latest_order_at')} AS latest_order_at,
                          {_at('latest_email_at')} AS latest_email_at)
        FROM dim_customer"""),
    "event_timeline": star(f"""
        SELECT * REPLACE ({_at('event_timestamp')} AS event_timestamp)
        FROM fact_event_timeline"""),
    "customer_daily": star(f"""
        SELECT customer_id_clean, {_at('event_date')} AS event_date, kind AS event_type,
               event_count FROM fact_customer_daily"""),
    "risk_features": star("""
        SELECT order_id, customer_id_clean, primary_plant, primary_product_family, order_year,
               order_month_num, order_quarter, customer_prior_orders,
               round(coalesce(pc / nullif(customer_prior_orders, 0), 0.0), 6)
                   AS customer_prior_will_generate_complaint_rate,
               round(coalesce(pd / nullif(customer_prior_orders, 0), 0.0), 6)
                   AS customer_prior_will_be_delayed_rate,
               round(coalesce(pm / nullif(customer_prior_orders, 0), 0.0), 6)
                   AS customer_prior_will_generate_credit_memo_rate,
               round(ln(1 + customer_prior_orders), 6) AS customer_prior_orders_log,
               plant_prior_orders,
               round(coalesce(pp / nullif(plant_prior_orders, 0), 0.0), 6)
                   AS plant_prior_delay_rate
        FROM features"""),
    "retrieval_corpus": star("""
        SELECT *, doc_id AS citation FROM (
        SELECT 'order:' || order_id AS doc_id, 'order' AS entity_type, order_id AS entity_id,
               customer_id_clean AS customer_id, order_id, 'order_summary' AS document_type,
               order_created_at::date::varchar AS event_date,
               'Order ' || order_id || ' summary' AS title,
               'Order ' || order_id || ' for customer ' || coalesce(customer_id_clean, '<NA>') || ' created on '
               || order_created_at::date || '. ' || order_line_count || ' lines, '
               || document_count || ' documents, ' || linked_email_count
               || ' emails, max delivery lag ' || max_delivery_lag_days || ' days, complaint='
               || CASE WHEN will_generate_complaint THEN 'True' ELSE 'False' END || ', credit='
               || CASE WHEN will_generate_credit_memo THEN 'True' ELSE 'False' END || '.' AS text
        FROM fact_order
        WHERE has_linked_email OR has_credit_memo OR has_quality_report OR will_be_delayed
        UNION ALL
        SELECT 'customer:' || coalesce(customer_id_clean, 'unlinked'), 'customer',
               customer_id_clean, customer_id_clean, NULL, 'customer_summary',
               latest_order_at::date::varchar, 'Customer ' || customer_label || ' summary',
               'Customer ' || customer_label || ' (' || coalesce(customer_id_clean, '<NA>')
               || ') has ' || order_count || ' orders, ' || email_count || ' emails, '
               || document_count || ' documents, issue rate '
               || printf('%.2f', issue_rate * 100) || '%, invoice total '
               || printf('%.2f', invoice_total::double) || ', credit total '
               || printf('%.2f', credit_total::double) || '.'
        FROM dim_customer
        UNION ALL
        SELECT 'email:' || canonical_message_id, 'email', canonical_message_id,
               customer_id_clean, linked_order_id, 'email', event_date,
               coalesce(subject, 'Email'),
               'From ' || coalesce(from_name, from_email, 'unknown') || ' to '
               || coalesce(to_name, to_email, 'unknown') || '. ' || coalesce(subject, '') || '. '
               || regexp_replace(coalesce(body, ''), '{_SPACE}', ' ', 'g')
        FROM fact_email WHERE is_complaint_like OR linked_order_id IS NOT NULL
        UNION ALL
        SELECT 'document:' || canonical_document_id, 'document', canonical_document_id,
               customer_id_clean, order_id, coalesce(document_type, 'document'), event_date,
               coalesce(document_type, 'Document') || ' ' || coalesce(source_document_id, ''),
               coalesce(regexp_replace(content, '{_SPACE}', ' ', 'g'), content_summary, '')
        FROM fact_document)""".replace("{_SPACE}", _SPACE)),
    "quality_metrics": star("""
        SELECT 'raw_counts' AS section, name, n::varchar AS value FROM (
            SELECT 'communications' AS name, count(*) AS n FROM communications
            UNION ALL SELECT 'erp_transactions', count(*) FROM lines
            UNION ALL SELECT 'sales_documents', count(*) FROM orders
            UNION ALL SELECT 'sales_items', count(*) FROM lineitem
            UNION ALL SELECT 'supporting_documents', count(*) FROM supporting
            UNION ALL SELECT 'business_documents', count(*) FROM documents
            UNION ALL SELECT 'sqlite_emails', count(*) FROM conversations
            UNION ALL SELECT 'sqlite_contacts', count(*) FROM customer)
        UNION ALL
        SELECT 'processed_counts', name, n::varchar FROM (
            SELECT 'fact_email' AS name, count(*) AS n FROM fact_email
            UNION ALL SELECT 'fact_document', count(*) FROM fact_document
            UNION ALL SELECT 'fact_order', count(*) FROM fact_order
            UNION ALL SELECT 'dim_customer', count(*) FROM dim_customer
            UNION ALL SELECT 'fact_event_timeline', count(*) FROM fact_event_timeline
            UNION ALL SELECT 'fact_customer_daily', count(*) FROM fact_customer_daily
            UNION ALL SELECT 'fact_order_risk_features', count(*) FROM features
            UNION ALL SELECT 'retrieval_corpus',
                (SELECT count(*) FROM fact_order WHERE has_linked_email OR has_credit_memo
                    OR has_quality_report OR will_be_delayed)
                + (SELECT count(*) FROM dim_customer) + (SELECT count(*) FROM fact_document)
                + (SELECT count(*) FROM fact_email
                   WHERE is_complaint_like OR linked_order_id IS NOT NULL))
        UNION ALL
        SELECT 'checks', name, value FROM (
            SELECT 'email_duplicate_source_ids' AS name,
                   count_if(is_duplicate_source_id)::varchar AS value FROM fact_email
            UNION ALL SELECT 'null_customer_ids_in_email_pct',
                   printf('%.2f', avg((customer_id_clean IS NULL)::int) * 100) FROM fact_email
            UNION ALL SELECT 'email_date_start', min(timestamp)::varchar FROM fact_email
            UNION ALL SELECT 'email_date_end', max(timestamp)::varchar FROM fact_email
            UNION ALL SELECT 'order_date_start', min(order_created_at)::varchar FROM fact_order
            UNION ALL SELECT 'order_date_end', max(order_created_at)::varchar FROM fact_order
            UNION ALL SELECT 'document_duplicate_source_ids',
                   count_if(is_duplicate_source_id)::varchar FROM fact_document
            UNION ALL SELECT 'document_date_start', min(event_timestamp)::varchar
                   FROM fact_document
            UNION ALL SELECT 'document_date_end', max(event_timestamp)::varchar FROM fact_document
            UNION ALL SELECT 'sqlite_vs_parquet_email_gap',
                   ((SELECT count(*) FROM communications)
                    - (SELECT count(*) FROM conversations))::varchar)"""),
    "order_references": star(f"""
        SELECT doc_id, nullif(regexp_extract(text, '{_REFERENCE}', 1), '') AS order_reference
        FROM texts"""),
    "keyword_counts": star("""
        SELECT doc_id, regexp_matches(lower(text), 'the|und|les|that') AS has_any,
               regexp_matches(lower(text), 'license|password|@') AS has_marker,
               ((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3)::bigint
                   AS the_count,
               ((length(lower(text)) - length(replace(lower(text), 'en', ''))) / 2)::bigint
                   AS en_count
        FROM texts"""),
    "text_previews": f"""
        SELECT kind, id, left(regexp_replace(body, '{_SPACE}', ' ', 'g'), 280) AS preview,
               {_row_key('kind', 'id', 'body')} AS key
        FROM (SELECT 'page' AS kind, page_id::varchar AS id, html AS body FROM pages
              UNION ALL SELECT 'turn', conv_id || '-' || turn, text FROM conversations)""",
    "calendar_parts": """
        SELECT o_orderkey AS order_key, year(o_orderdate)::int AS year,
               month(o_orderdate)::int AS month, quarter(o_orderdate)::int AS quarter,
               strftime(o_orderdate, '%Y-%m') AS month_text, o_orderdate::date::varchar AS day_text
        FROM orders""",
    "monthly_change_text": star("""
        SELECT strftime(month, '%Y-%m') AS month,
               CASE WHEN previous_orders IS NULL THEN NULL
                    WHEN previous_orders = 0 THEN 'n/a'
                    ELSE printf('%.1f', (complaint_orders - previous_orders)
                                        / previous_orders * 100) || '%' END AS change
        FROM months"""),
    "headline_kpis": star("""
        SELECT count(*) AS orders,
               (SELECT count(*) FROM dim_customer WHERE customer_id_clean IS NOT NULL) AS customers,
               round(avg(will_be_delayed::int), 6) AS delayed_rate,
               round(avg(will_generate_complaint::int), 6) AS complaint_rate
        FROM fact_order"""),
    "monthly_trend": star("""
        SELECT order_month, count(*) AS orders, count_if(will_be_delayed)::bigint AS delayed,
               count_if(will_generate_complaint)::bigint AS complaint,
               count_if(will_generate_credit_memo)::bigint AS credit,
               round(sum(revenue_total), 4) AS revenue
        FROM fact_order GROUP BY order_month"""),
    "issue_customer_zscores": star(f"""
        SELECT customer_label, round(issue_rate, 4) AS issue_rate, order_count, email_count,
               round(credit_total, 4) AS credit_total, {', '.join(
                   f"round(({m} - avg({m}) OVER ()) / (stddev_samp({m}) OVER () + 1e-9), 4) AS {m}_z"
                   for m in ['issue_rate', 'order_count', 'email_count', 'credit_total'])}
        FROM (SELECT * FROM dim_customer {_BY_ISSUE} LIMIT 20)"""),
    "top_issue_customers": star(f"""
        SELECT customer_label, order_count, email_count, round(issue_rate, 4) AS issue_rate,
               round(invoice_total, 4) AS invoice_total, round(credit_total, 4) AS credit_total
        FROM dim_customer {_BY_ISSUE} LIMIT 25"""),
    "overview_risk": star(f"""
        SELECT f.order_id, f.customer_id_clean, linked_email_count, max_delivery_lag_days,
               round({_MEAN_ALL}, 6) AS composite_risk
        FROM fact_order f LEFT JOIN scores s ON {_SAME_ORDER}
        ORDER BY {_MEAN_ALL} DESC, f.order_id LIMIT 1000"""),
    "risk_landscape": star(f"""
        SELECT f.order_id, f.customer_id_clean, linked_email_count, document_count,
               greatest(max_delivery_lag_days, 0) AS lag_size,
               round({_MEAN_ALL}, 6) AS composite_risk
        FROM fact_order f JOIN scores s ON {_SAME_ORDER}
        ORDER BY {_MEAN_ALL} DESC, f.order_id LIMIT 2000"""),
    "top_risk_orders": star(f"""
        SELECT f.order_id, f.customer_id_clean, linked_email_count, document_count,
               max_delivery_lag_days, {', '.join(f'round({c}, 6) AS {c}' for c in _RISK)},
               round({_MEAN_ALL}, 6) AS composite_risk
        FROM fact_order f JOIN scores s ON {_SAME_ORDER}
        ORDER BY {_MEAN_ALL} DESC, f.order_id LIMIT 100"""),
    "customer_options": star("""
        SELECT customer_id_clean, customer_label || ' (' || customer_id_clean || ')' AS label
        FROM dim_customer WHERE customer_id_clean IS NOT NULL"""),
    "customer_kpis": star("""
        SELECT customer_id_clean, order_count, email_count,
               printf('%.1f', issue_rate * 100) || '%' AS issue_rate_text,
               printf('%.2f', credit_total::double) AS credit_total_text FROM dim_customer"""),
    "customer_monthly_activity": star("""
        SELECT customer_id_clean, order_month AS month, count(*) AS orders,
               count_if(will_be_delayed)::bigint AS delayed,
               count_if(will_generate_complaint)::bigint AS complaint
        FROM fact_order GROUP BY ALL"""),
    "latest_orders": star(f"""
        SELECT customer_id_clean, order_id, {_at('order_created_at')} AS order_created_at,
               order_line_count, document_count, linked_email_count, max_delivery_lag_days,
               will_generate_complaint, will_generate_credit_memo,
               row_number() OVER (PARTITION BY customer_id_clean
                                  ORDER BY fact_order.order_created_at DESC, order_id)::int
                   AS position
        FROM fact_order
        QUALIFY position <= 50"""),
    "scope_mix": star(
        "SELECT message_scope, count(*) AS emails FROM fact_email GROUP BY message_scope"
    ),
    "customer_scope_mix": star(
        "SELECT customer_id_clean, message_scope, count(*) AS emails FROM fact_email GROUP BY ALL"
    ),
    "order_options": star("""
        SELECT order_id, order_id || ' | customer ' || coalesce(customer_id_clean, '<NA>') || ' | docs '
               || document_count || ' | emails ' || linked_email_count AS label
        FROM fact_order WHERE document_count > 0 OR linked_email_count > 0"""),
    "order_kpis": star(f"""
        SELECT order_id, order_line_count AS lines, max_delivery_lag_days || ' days' AS max_lag,
               CASE WHEN will_generate_complaint THEN 'True' ELSE 'False' END AS complaint_flag,
               CASE WHEN will_generate_credit_memo THEN 'True' ELSE 'False' END AS credit_flag,
               {', '.join(f"printf('%.1f', {c} * 100) || '%' AS {c}_text" for c in _RISK)}
        FROM fact_order LEFT JOIN (SELECT order_id, {', '.join(_RISK)} FROM scores)
        USING (order_id)"""),
    "linked_documents": star(f"""
        SELECT order_id, document_type, source_document_id,
               {_at('event_timestamp')} AS event_timestamp,
               round(revenue_amount, 4) AS revenue_amount, round(cost_amount, 4) AS cost_amount,
               round(refund_amount, 4) AS refund_amount, delivery_lag_days, content_summary
        FROM fact_document WHERE order_id IS NOT NULL"""),
    "linked_emails": star(f"""
        SELECT linked_order_id, {_at('timestamp')} AS timestamp, from_email, to_email, subject,
               message_scope, is_complaint_like, body_preview
        FROM fact_email WHERE linked_order_id IS NOT NULL"""),
    "customer_filter_options": star("""
        SELECT customer_id_clean AS option FROM dim_customer
        WHERE customer_id_clean IS NOT NULL"""),
    "order_filter_options": star("SELECT order_id AS option FROM fact_order"),
    "duplicate_emails": star(f"""
        SELECT source_message_id, {_at('timestamp')} AS timestamp, from_email, to_email, subject
        FROM fact_email WHERE is_duplicate_source_id"""),
    "duplicate_documents": star("""
        SELECT source_document_id, document_type, order_id, customer_id_clean
        FROM fact_document WHERE is_duplicate_source_id"""),
    "date_coverage": star(f"""
        SELECT 'emails' AS dataset, {_at('min(timestamp)')} AS start,
               {_at('max(timestamp)')} AS end FROM fact_email
        UNION ALL
        SELECT 'documents', {_at('min(event_timestamp)')}, {_at('max(event_timestamp)')}
        FROM fact_document"""),
    "kpi_measures": star(f"""
        SELECT count(*) AS total_orders,
               count(DISTINCT coalesce(customer_id_clean, '')) AS unique_customers,
               round({_SHARE.format('will_be_delayed')}, 6) AS delay_rate,
               round({_SHARE.format('will_generate_complaint')}, 6) AS complaint_rate,
               round({_SHARE.format('will_generate_credit_memo')}, 6) AS credit_memo_rate
        FROM fact_order"""),
    "risk_measures": star(f"""
        SELECT {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in _RISK)},
               count_if(will_be_delayed_score >= 0.7)::bigint AS high_risk_delay,
               count_if(will_generate_complaint_score >= 0.7)::bigint AS high_risk_complaint
        FROM scores"""),
    "month_to_date_orders": star("""
        SELECT day::varchar AS day, sum(n) OVER (PARTITION BY date_trunc('month', day)
                                                 ORDER BY day)::bigint AS month_to_date_orders
        FROM (SELECT order_created_at::date AS day, count(*) AS n FROM fact_order GROUP BY 1)"""),
    "complaint_change": star("""
        SELECT month::date::varchar AS month, complaint_orders::bigint AS complaint_orders,
               previous_orders::bigint AS previous_orders,
               round((complaint_orders - previous_orders) / nullif(previous_orders, 0), 6) AS change
        FROM months"""),
    "customer_rates": star(f"""
        SELECT customer_id_clean, count(*) AS orders,
               round({_SHARE.format('will_be_delayed')}, 6) AS delay_rate,
               round({_SHARE.format('will_generate_complaint')}, 6) AS complaint_rate,
               round({_SHARE.format('will_generate_credit_memo')}, 6) AS credit_memo_rate
        FROM fact_order GROUP BY customer_id_clean"""),
    "top_complaint_rate": star(f"""
        SELECT round(max(rate), 6) AS top_complaint_rate
        FROM (SELECT {_SHARE.format('will_generate_complaint')} AS rate FROM fact_order
              GROUP BY customer_id_clean)"""),
    "plants_by_delay": star("""
        SELECT primary_plant, count(*) AS orders, round(avg(will_be_delayed::int), 6) AS delay_rate
        FROM fact_order GROUP BY primary_plant
        ORDER BY avg(will_be_delayed::int) DESC, primary_plant LIMIT 10"""),
    "history_scatter": star("""
        SELECT customer_label, order_count, round(issue_rate, 6) AS issue_rate
        FROM dim_customer"""),
    "score_histogram": star(f"""
        SELECT target, least(floor(score * 20), 19)::bigint AS bin, count(*) AS orders
        FROM ({' UNION ALL '.join(
            f"SELECT '{t}' AS target, {t}_score AS score FROM scores" for t in TARGETS)})
        GROUP BY ALL"""),
    "highest_risk_orders": star(f"""
        SELECT order_id, {', '.join(f'round({c}, 4) AS {c}' for c in _RISK)} FROM scores
        ORDER BY greatest({', '.join(_RISK)}) DESC, order_id LIMIT 20"""),
    "relationship_check": star("""
        SELECT relationship, count(*) AS rows, count_if(NOT found)::bigint AS orphans,
               0::bigint AS repeated_keys
        FROM (
            SELECT 'fact_order_risk_features.order_id -> fact_order.order_id' AS relationship,
                   order_id IN (SELECT order_id FROM fact_order) AS found
            FROM features WHERE order_id IS NOT NULL
            UNION ALL
            SELECT 'fact_email.linked_order_id -> fact_order.order_id',
                   linked_order_id IN (SELECT order_id FROM fact_order)
            FROM fact_email WHERE linked_order_id IS NOT NULL
            UNION ALL
            SELECT 'fact_document.order_id -> fact_order.order_id',
                   order_id IN (SELECT order_id FROM fact_order)
            FROM fact_document WHERE order_id IS NOT NULL
            UNION ALL
            SELECT 'fact_event_timeline.order_id -> fact_order.order_id',
                   order_id IN (SELECT order_id FROM fact_order)
            FROM timeline_rows WHERE order_id IS NOT NULL
            UNION ALL
            SELECT 'fact_order.customer_id_clean -> dim_customer.customer_id_clean',
                   customer_id_clean IN (SELECT customer_id_clean FROM dim_customer
                                         WHERE customer_id_clean IS NOT NULL)
            FROM fact_order WHERE customer_id_clean IS NOT NULL
            UNION ALL
            SELECT 'fact_customer_daily.customer_id_clean -> dim_customer.customer_id_clean',
                   customer_id_clean IN (SELECT customer_id_clean FROM dim_customer
                                         WHERE customer_id_clean IS NOT NULL)
            FROM fact_customer_daily WHERE customer_id_clean IS NOT NULL
            UNION ALL
            SELECT 'order_risk_scores.order_id -> fact_order.order_id',
                   order_id IN (SELECT order_id FROM fact_order) FROM scores
            UNION ALL
            SELECT 'fact_order.order_id -> order_risk_scores.order_id',
                   order_id IN (SELECT order_id FROM scores) FROM fact_order)
        GROUP BY relationship"""),
}

CTES["flow"] = """
        SELECT count(*) AS total, count_if(document_count > 0)::bigint AS with_docs,
               count_if(has_linked_email)::bigint AS with_email,
               count_if(will_be_delayed)::bigint AS delayed,
               count_if(will_generate_complaint)::bigint AS complaint,
               count_if(will_generate_credit_memo)::bigint AS credit FROM fact_order"""
ORACLES["lifecycle_flow"] = star("""
    SELECT 'All orders' AS source, 'With docs' AS target, with_docs AS orders FROM flow
    UNION ALL SELECT 'All orders', 'With emails', with_email FROM flow
    UNION ALL SELECT 'All orders', 'Delayed', delayed FROM flow
    UNION ALL SELECT 'All orders', 'No issue', greatest(total - delayed - complaint, 0) FROM flow
    UNION ALL SELECT 'Delayed', 'Credit memo', credit FROM flow
    UNION ALL SELECT 'Complaint', 'Credit memo', credit FROM flow""")


# --- Retrieval ---------------------------------------------------------------

_STOP_WORDS = "'the', 'of', 'and', 'to', 'in', 'is', 'that', 'for', 'it', 'as', 'was', 'with'"


def _terms(source: str, key: str, text: str) -> str:
    """key, term, tf of a table of texts."""
    return f"""
        SELECT {key}, term, count(*) AS tf
        FROM (SELECT {key}, unnest(list_concat(w, list_transform(
                  range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term
              FROM (SELECT {key}, list_filter(
                        regexp_extract_all(lower({text}), '[{_WORD}]{{2,}}'),
                        lambda t: t NOT IN ({_STOP_WORDS})) AS w
                    FROM {source}))
        GROUP BY {key}, term"""


def _candidates(named: str, matches: str, rule: str = "true") -> str:
    return f"""
        SELECT b.item_id, c.doc_id, c.entity_type, c.order_id, c.customer_id,
               coalesce(m.score, 0.0) AS score,
               row_number() OVER (PARTITION BY b.item_id
                                  ORDER BY coalesce(m.score, 0.0) DESC, c.doc_id)::int AS position
        FROM benchmark b CROSS JOIN corpus c
        LEFT JOIN {named} n ON n.item_id = b.item_id
        LEFT JOIN {matches} m ON m.item_id = b.item_id AND m.doc_id = c.doc_id
        WHERE (n.item_id IS NULL OR n.order_id = c.order_id) AND {rule}
        QUALIFY position <= 20"""


CTES.update(
    {
        "corpus": """
        SELECT 'document:' || doc_id AS doc_id, 'document' AS entity_type, source AS customer_id,
               lpad(doc_id::varchar, 10, '0') AS order_id, text,
               'Document ' || source || ' ' || lang AS title FROM documents
        UNION ALL
        SELECT 'turn:' || conv_id || ':' || turn, 'email', role,
               lpad(conv_id::varchar, 10, '0'), text, 'Turn of ' || role FROM conversations""",
        "doc_terms": _terms("corpus", "doc_id", "text"),
        "question_terms": _terms("benchmark", "item_id", "text"),
        "vocabulary": """
        SELECT term, sum(tf)::bigint AS total, count(*) AS document_frequency,
               ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))) + 1 AS idf
        FROM doc_terms GROUP BY term""",
        "doc_vectors": """
        SELECT doc_id, term,
               tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id)) AS weight
        FROM doc_terms JOIN vocabulary USING (term)""",
        "question_vectors": """
        SELECT item_id, term,
               tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS weight
        FROM question_terms JOIN vocabulary USING (term)""",
        "matches": """
        SELECT item_id, doc_id, round(sum(q.weight * d.weight), 9) AS score
        FROM question_vectors q JOIN doc_vectors d USING (term) GROUP BY item_id, doc_id""",
        "named_orders": f"""
        SELECT item_id, order_id FROM (
            SELECT item_id, nullif(regexp_extract(text, '{_REFERENCE}', 1), '') AS order_id
            FROM benchmark) WHERE order_id IN (SELECT order_id FROM corpus)""",
        "candidates": _candidates("named_orders", "matches"),
        "likeness": """
        SELECT a.item_id, a.doc_id AS one, b.doc_id AS other, sum(v.weight * w.weight) AS likeness
        FROM candidates a JOIN doc_vectors v ON v.doc_id = a.doc_id
        JOIN doc_vectors w ON w.term = v.term
        JOIN candidates b ON b.item_id = a.item_id AND b.doc_id = w.doc_id
        WHERE a.doc_id <> b.doc_id GROUP BY ALL""",
        "picked_1": "SELECT *, 1 AS pick FROM candidates WHERE position = 1",
    }
)
for _n in range(2, 6):
    CTES[f"picked_{_n}"] = f"""
        SELECT * FROM picked_{_n - 1}
        UNION ALL
        SELECT * FROM (
            SELECT c.*, {_n} AS pick
            FROM candidates c
            LEFT JOIN (SELECT s.item_id, s.other, max(s.likeness) AS likeness
                       FROM likeness s JOIN picked_{_n - 1} p
                         ON p.item_id = s.item_id AND p.doc_id = s.one
                       GROUP BY ALL) r ON r.item_id = c.item_id AND r.other = c.doc_id
            WHERE (c.item_id, c.doc_id) NOT IN (SELECT (item_id, doc_id) FROM picked_{_n - 1})
            QUALIFY row_number() OVER (
                PARTITION BY c.item_id
                ORDER BY round(0.7 * c.score - 0.3 * coalesce(r.likeness, 0), 9) DESC,
                         c.position) = 1)"""

CTES["evidence"] = """
        SELECT p.*, c.text, c.title,
               row_number() OVER (PARTITION BY p.item_id ORDER BY p.score DESC, p.pick) AS rank,
               count(*) OVER (PARTITION BY p.item_id) AS n
        FROM (SELECT * FROM picked_5
              QUALIFY row_number() OVER (PARTITION BY item_id, entity_type, order_id
                                         ORDER BY score DESC, pick) = 1) p
        JOIN corpus c ON c.doc_id = p.doc_id"""
CTES["kinds"] = """
        SELECT item_id, string_agg(c || '/' || n || ' results are ' || entity_type || ' records',
                                   ' | ' ORDER BY c DESC, first_rank) AS kinds
        FROM (SELECT item_id, entity_type, any_value(n) AS n, count(*) AS c,
                     min(rank) AS first_rank
              FROM evidence GROUP BY item_id, entity_type) GROUP BY item_id"""
_THEMES = ", ".join(f"('{word}', {i})" for i, word in enumerate(THEME_KEYWORDS))
CTES["themes"] = f"""
        SELECT item_id, string_agg(chr(39) || word || chr(39) || ' (' || hits || '×)', ', '
                                   ORDER BY hits DESC, i) AS themes
        FROM (SELECT * FROM (
                  SELECT item_id, word, i, sum((length(lower(text))
                         - length(replace(lower(text), word, ''))) / length(word))::bigint AS hits
                  FROM evidence CROSS JOIN (VALUES {_THEMES}) t(word, i)
                  GROUP BY item_id, word, i)
              WHERE hits > 0
              QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, i) <= 3)
        GROUP BY item_id"""

CTES["referring"] = """
        SELECT item_id, text || ' order ' || lpad(item_id::varchar, 10, '0') AS text FROM benchmark"""
CTES["referring_terms"] = _terms("referring", "item_id", "text")
CTES["referring_matches"] = """
        SELECT item_id, doc_id, round(sum(q.weight * d.weight), 9) AS score
        FROM (SELECT item_id, term,
                     tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY item_id)) AS weight
              FROM referring_terms JOIN vocabulary USING (term)) q
        JOIN doc_vectors d USING (term) GROUP BY item_id, doc_id"""
CTES["referred"] = f"""
        SELECT item_id, order_id FROM (
            SELECT item_id, nullif(regexp_extract(text, '{_REFERENCE}', 1), '') AS order_id
            FROM referring) WHERE order_id IN (SELECT order_id FROM corpus)"""
CTES["referring_candidates"] = _candidates("referred", "referring_matches")
CTES["document_candidates"] = _candidates("named_orders", "matches", "c.entity_type = 'document'")

ORACLES.update(
    {
        "filtered_candidates": star("""
        SELECT item_id::varchar AS query_id, doc_id, round(score, 6) AS score, position
        FROM document_candidates"""),
        "named_order_candidates": star("""
        SELECT item_id::varchar AS query_id, doc_id, round(score, 6) AS score, position
        FROM referring_candidates"""),
        "text_timestamps": f"""
        SELECT o_orderkey, {_at('parsed')} AS parsed FROM (
            SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::timestamp
                   WHEN 1 THEN o_orderdate + INTERVAL '7 hours 8 minutes 9 seconds'
                   WHEN 2 THEN o_orderdate + INTERVAL '7 hours 8 minutes 9.5 seconds' END AS parsed
            FROM orders)""",
        "customer_timeline": star("""
        SELECT customer_id_clean, event_id, event_type,
               rank() OVER (PARTITION BY customer_id_clean
                            ORDER BY event_timestamp ASC NULLS LAST, event_id)::int AS position
        FROM fact_event_timeline WHERE customer_id_clean IS NOT NULL"""),
        "order_timeline": star("""
        SELECT order_id, event_id, event_type,
               rank() OVER (PARTITION BY order_id
                            ORDER BY event_timestamp ASC NULLS LAST, event_id)::int AS position
        FROM fact_event_timeline WHERE order_id IS NOT NULL"""),
        "evidence_summaries": star("""
        SELECT item_id::varchar AS query_id,
               'Retrieved ' || count(*) || ' evidence records. Relevant orders: '
               || array_to_string(list_sort(list_distinct(list(order_id)))[1:5], ', ')
               || '. Relevant customers: '
               || array_to_string(list_sort(list_distinct(list(customer_id)))[1:5], ', ')
               || '. ' || any_value(kinds)
               || coalesce(' | Key themes: ' || any_value(themes), '') || '. Highlights: '
               || string_agg('[' || entity_type || '] ' || title || ': ' || left(text, 180),
                             ' — ' ORDER BY rank) FILTER (rank <= 3)
               || ' (Extractive summary — based only on retrieved records.)' AS summary,
               count(*)::int AS evidence_count,
               array_to_string(list_sort(list_distinct(list(order_id))), ',') AS order_ids
        FROM evidence JOIN kinds USING (item_id) LEFT JOIN themes USING (item_id)
        GROUP BY item_id"""),
        "tfidf_vocabulary": star(
            "SELECT term, total, document_frequency, round(idf, 6) AS idf FROM vocabulary"
        ),
        "tfidf_candidates": star("""
        SELECT item_id::varchar AS query_id, doc_id, round(score, 6) AS score, position
        FROM candidates"""),
        "retrieve_evidence": star("""
        SELECT item_id::varchar AS query_id,
               row_number() OVER (PARTITION BY item_id ORDER BY picked.score DESC, pick)::int
                   AS rank,
               doc_id, entity_type, order_id, customer_id, round(picked.score, 6) AS score
        FROM (SELECT * FROM picked_5
              QUALIFY row_number() OVER (PARTITION BY item_id, entity_type, order_id
                                         ORDER BY score DESC, pick) = 1) picked"""),
    }
)


# --- Risk: splits, curves and metrics ----------------------------------------

CTES["order_labels"] = " UNION ALL ".join(
    f"SELECT '{t}' AS target, {t}::int AS label, {t}_score AS score "
    f"FROM fact_order JOIN (SELECT order_id, {t}_score FROM scores) USING (order_id)"
    for t in TARGETS
)
CTES["document_labels"] = """
    SELECT lang AS target, quality AS label, round(n_chars / (n_chars + 1000), 3) AS score
    FROM labels JOIN documents USING (doc_id)"""


def _curve(source: str) -> str:
    return f"""
        SELECT target, threshold,
               sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, pos, neg,
               sum(pos) OVER (PARTITION BY target) AS p, sum(neg) OVER (PARTITION BY target) AS n
        FROM (SELECT target, score AS threshold, count_if(label = 1) AS pos,
                     count_if(label = 0) AS neg FROM {source} GROUP BY ALL)
        WINDOW w AS (PARTITION BY target ORDER BY threshold DESC)"""


def _ranking(source: str) -> str:
    """AUC as the share of positive-negative pairs in the right order, ties half."""
    return f"""
        SELECT target, (SELECT avg(CASE WHEN a.score > b.score THEN 1.0
                                        WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)
                        FROM {source} a JOIN {source} b
                          ON a.target = b.target AND a.label = 1 AND b.label = 0
                        WHERE a.target = c.target) AS roc_auc,
               CASE WHEN max(p) > 0 AND max(n) > 0
                    THEN sum(pos / p * (tp / (tp + fp))) END AS average_precision
        FROM ({_curve(source)}) c GROUP BY target"""


def _confusion(source: str, threshold: str) -> str:
    return f"""
        SELECT target, round(avg((label = 1)::int), 6) AS positive_rate,
               {threshold}::double AS threshold,
               round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1,
               round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision,
               round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall,
               round(any_value(roc_auc), 6) AS roc_auc,
               round(any_value(average_precision), 6) AS average_precision
        FROM {source} JOIN (
            SELECT target, count_if(score >= {threshold} AND label = 1) AS tp,
                   count_if(score >= {threshold} AND label = 0) AS fp,
                   count_if(score < {threshold} AND label = 1) AS fn
            FROM {source} GROUP BY target) USING (target)
        JOIN ({_ranking(source)}) r USING (target)
        GROUP BY target, tp, fp, fn"""


_F1 = "2 * pr * rc / (pr + rc + 1e-8)"
CTES["curve_points"] = f"""
    SELECT target, threshold, tp::bigint AS true_positives, fp::bigint AS false_positives,
           tp / (tp + fp) AS pr, coalesce(tp / nullif(p, 0), 0.0) AS rc
    FROM ({_curve('order_labels')})"""

ORACLES.update(
    {
        "precision_recall": star(f"""
        SELECT target, round(threshold, 6) AS threshold, true_positives, false_positives,
               round(pr, 6) AS precision, round(rc, 6) AS recall, round({_F1}, 6) AS f1
        FROM curve_points"""),
        "ranking_metrics": star(f"""
        SELECT target, round(roc_auc, 6) AS roc_auc,
               round(average_precision, 6) AS average_precision
        FROM ({_ranking('order_labels')})"""),
        "best_thresholds": star(f"""
        SELECT target, round(arg_max(threshold, ({_F1}, -threshold)), 6) AS threshold
        FROM curve_points GROUP BY target"""),
        "binary_metrics": star(_confusion("order_labels", "0.4")),
        "label_metrics": star(_confusion("document_labels", "0.5")),
        "time_split": star("""
        SELECT cutoff AS cutoff_micros,
               count_if(epoch_us(order_created_at) <= cutoff)::bigint AS train_rows,
               count_if(epoch_us(order_created_at) > cutoff)::bigint AS test_rows
        FROM fact_order, (SELECT quantile_cont(epoch_us(order_created_at)::double, 0.8) AS cutoff
                          FROM fact_order) q
        GROUP BY cutoff"""),
        "stratified_split": star("""
        SELECT order_id, will_be_delayed::int AS label,
               row_number() OVER (PARTITION BY will_be_delayed ORDER BY sha1('42|' || order_id))
               <= round(count(*) OVER (PARTITION BY will_be_delayed) * 0.2) AS is_test
        FROM fact_order"""),
        "stratified_folds": star("""
        SELECT order_id, will_be_delayed::int AS label,
               ((row_number() OVER (PARTITION BY will_be_delayed
                                    ORDER BY sha1('folds-42|' || order_id)) - 1) % 3)::int AS fold
        FROM fact_order"""),
        "class_weights": star("""
        SELECT will_be_delayed::int AS label,
               round((SELECT count(*) FROM fact_order) / (2 * count(*)), 6) AS weight
        FROM fact_order GROUP BY will_be_delayed"""),
        "time_ranks": star("""
        SELECT order_id, row_number() OVER (ORDER BY order_created_at, sha1(order_id)) - 1
                   AS time_rank
        FROM fact_order"""),
    }
)


# --- Risk: the training run over all targets ---------------------------------

CTES["dated"] = """
    SELECT *, epoch_us(order_created_at) <= cutoff AS early,
           row_number() OVER (ORDER BY order_created_at, sha1(order_id)) - 1 AS time_rank,
           count(*) OVER () AS n
    FROM fact_order, (SELECT quantile_cont(epoch_us(order_created_at)::double, 0.8) AS cutoff
                      FROM fact_order WHERE order_id IS NOT NULL) q
    WHERE order_created_at IS NOT NULL AND order_id IS NOT NULL"""
CTES["dated_targets"] = " UNION ALL ".join(
    f"SELECT order_id, '{t}' AS target, {t}::int AS label, early, time_rank, n FROM dated" for t in TARGETS
)
# Split by time, or by class where one side of it lacks a class.
CTES["dated_labels"] = """
    SELECT *, CASE WHEN early_low <> early_high AND late_low <> late_high THEN NOT early
                   ELSE place <= round(of_class * 0.2) END AS test
    FROM (SELECT *, min(label) FILTER (early) OVER t AS early_low, max(label) FILTER (early) OVER t AS early_high,
                 min(label) FILTER (NOT early) OVER t AS late_low, max(label) FILTER (NOT early) OVER t AS late_high,
                 row_number() OVER (PARTITION BY target, label ORDER BY sha1('42|' || order_id)) AS place,
                 count(*) OVER (PARTITION BY target, label) AS of_class
          FROM dated_targets WINDOW t AS (PARTITION BY target)) s"""
# The windows of five folds whose both sides hold both classes.
CTES["dated_windows"] = """
    SELECT target, i::int AS "window", any_value(n // 6) * (i + 1) AS train_rows,
           count(*) FILTER (time_rank >= n // 6 * (i + 1)) AS test_rows,
           avg(label) FILTER (time_rank >= n // 6 * (i + 1)) AS positive_rate
    FROM dated_labels, range(5) AS t(i)
    WHERE n // 6 >= 50 AND time_rank < n // 6 * (i + 2)
    GROUP BY target, i
    HAVING count(DISTINCT label) FILTER (time_rank >= n // 6 * (i + 1)) = 2
       AND count(DISTINCT label) FILTER (time_rank < n // 6 * (i + 1)) = 2"""
CTES["dated_sides"] = """
    SELECT target, count(*) FILTER (early) AS train_rows, count(*) FILTER (NOT early) AS test_rows,
           avg(label) FILTER (test) AS positive_rate,
           (SELECT count(*) FROM dated_windows w WHERE w.target = l.target) AS windows
    FROM dated_labels l GROUP BY target"""
CTES["risk_numbers"] = """
    SELECT order_line_count, product_nunique, plant_nunique, shipping_point_nunique,
           f.order_year, f.order_month_num, f.order_quarter,
           ln(1 + customer_prior_orders) AS customer_prior_orders_log,
           coalesce(pc / nullif(customer_prior_orders, 0), 0.0) AS customer_prior_will_generate_complaint_rate,
           coalesce(pd / nullif(customer_prior_orders, 0), 0.0) AS customer_prior_will_be_delayed_rate,
           coalesce(pm / nullif(customer_prior_orders, 0), 0.0) AS customer_prior_will_generate_credit_memo_rate,
           plant_prior_orders, coalesce(pp / nullif(plant_prior_orders, 0), 0.0) AS plant_prior_delay_rate,
           f.primary_plant, f.primary_product_family
    FROM (SELECT order_id, order_year, order_month_num, order_quarter, customer_prior_orders, pc, pd, pm,
                 plant_prior_orders, pp, primary_plant, primary_product_family FROM features) f
    JOIN (SELECT order_id, order_line_count, product_nunique, plant_nunique, shipping_point_nunique
          FROM fact_order) o ON f.order_id IS NOT DISTINCT FROM o.order_id"""

_FEATURES = [f"num__{n}" for n in NUMERIC_FEATURES] + [f"cat__{n}" for n in CATEGORICAL_FEATURES]

ORACLES.update(
    {
        "candidate_scores": star("""
        SELECT target, model, order_id, label, true AS is_probability
        FROM dated_labels, (VALUES ('logistic_regression'), ('hist_gradient_boosting')) m(model)
        WHERE test"""),
        "calibrated_scores": star("""
        SELECT target, 'calibrated' AS model, order_id, label, true AS is_probability
        FROM dated_labels WHERE test"""),
        "training_scores": star(f"""
        SELECT order_id, customer_id_clean, {_at('order_created_at')} AS order_created_at,
               {', '.join(f'true AS {t}_agrees' for t in TARGETS)}
        FROM dated WHERE NOT early"""),
        "training_record": star("""
        SELECT target, 'trained' AS status, train_rows, test_rows, round(positive_rate, 6) AS positive_rate,
               windows, true AS threshold_in_range FROM dated_sides"""),
        "cross_validation": star("""
        SELECT target, "window", train_rows, test_rows, round(positive_rate, 6) AS positive_rate,
               true AS measured FROM dated_windows"""),
        "governance": star("""
        SELECT target, 'trained' AS status, train_rows, windows AS folds, 3::bigint AS targets_trained,
               true AS has_model FROM dated_sides"""),
        "feature_ranking": star(f"""
        SELECT target, unnest({_FEATURES}) AS feature FROM dated_sides"""),
        "run_history": star("""
        SELECT any_value(train_rows) AS train_rows, any_value(test_rows) AS test_rows,
               count(*) AS targets_trained, true AS is_last FROM dated_sides"""),
        "feature_medians": star(" UNION ALL ".join(
            f"SELECT '{n}' AS name, round(median({n})::double, 6) AS median FROM risk_numbers"
            for n in NUMERIC_FEATURES)),
        "feature_codes": star(" UNION ALL ".join(
            f"SELECT '{n}' AS name, {n} AS label, count(*) AS n, row_number() OVER (ORDER BY {n}) - 1 AS code "
            f"FROM risk_numbers WHERE {n} IS NOT NULL GROUP BY {n}" for n in CATEGORICAL_FEATURES)),
    }
)

ORACLES.update(
    {
        "customer_page": star(f"""
        SELECT customer_id_clean, {_at('event_timestamp')} AS event_timestamp, event_type, event_id, order_id
        FROM fact_event_timeline
        WHERE customer_id_clean = (SELECT customer_id_clean FROM dim_customer
            WHERE customer_id_clean IS NOT NULL
            ORDER BY issue_rate DESC, order_count DESC, customer_id_clean LIMIT 1)"""),
        "order_page": star(f"""
        SELECT order_id, document_type, source_document_id, {_at('event_timestamp')} AS event_timestamp,
               round(revenue_amount, 4) AS revenue_amount, round(cost_amount, 4) AS cost_amount,
               round(refund_amount, 4) AS refund_amount, delivery_lag_days, content_summary
        FROM fact_document
        WHERE order_id = (SELECT order_id FROM fact_order WHERE order_id IS NOT NULL
                          ORDER BY document_count DESC, order_id LIMIT 1)"""),
    }
)

