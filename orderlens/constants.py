"""Fixed values of the domain. Everything here can be overridden by a parameter."""

from __future__ import annotations

# --- Fixed values: patterns -------------------------------------------------
ORDER_REFERENCE_DIGITS = 10
NULL_MARKERS = ["<NA>", "nan", "None", ""]

# All characters that count as white space when ids are stripped.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- Fixed values: keyword lists --------------------------------------------
SPAM_KEYWORDS = [
    "unsubscribe",
    "blockchain",
    "quantum",
    "free assessment",
    "mainframe called",
    "click here",
    "special offer",
]

COMPLAINT_KEYWORDS = [
    "urgent",
    "complaint",
    "delivery issue",
    "delivery failure",
    "delay",
    "delayed",
    "damaged",
    "shortage",
    "credit",
    "replacement",
    "expedited",
    "escalation",
    "escalate",
    "issue",
    "problem",
    "late",
    "action plan",
    "root cause",
    "unacceptable",
    "reconsider",
    "immediate resolution",
]

THEME_KEYWORDS = ["delay", "complaint", "credit", "damaged", "shortage", "late"]

# --- Fixed values: document type -> column holding its event time -----------
EVENT_TIME_BY_TYPE = {
    "PURCHASE_ORDER": "order_date",
    "INVOICE": "invoice_date",
    "SHIPPING_NOTICE": "ship_date",
    "QUALITY_REPORT": "inspection_date",
    "CREDIT_MEMO": "issue_date",
}

# --- Fixed values: lengths, limits, windows ---------------------------------
COMPLAINT_TOLERANCE_DAYS = 60
PREVIEW_LENGTH = 280
HIGHLIGHT_LENGTH = 180
TOP_K = 5
CANDIDATES_PER_RESULT = 4
MMR_LAMBDA = 0.7
HIGH_RISK_SCORE = 0.7

# --- Fixed values: risk targets and features --------------------------------
TARGETS = [
    "will_generate_complaint",
    "will_be_delayed",
    "will_generate_credit_memo",
]

NUMERIC_FEATURES = [
    "order_line_count",
    "product_nunique",
    "plant_nunique",
    "shipping_point_nunique",
    "order_year",
    "order_month_num",
    "order_quarter",
    "customer_prior_orders_log",
    "customer_prior_will_generate_complaint_rate",
    "customer_prior_will_be_delayed_rate",
    "customer_prior_will_generate_credit_memo_rate",
    "plant_prior_orders",
    "plant_prior_delay_rate",
]

CATEGORICAL_FEATURES = ["primary_plant", "primary_product_family"]

EXCLUDED_OUTCOME_FEATURES = [
    "document_count",
    "revenue_total",
    "cost_total",
    "refund_total",
    "shipping_notice_count",
    "invoice_count",
    "quality_report_count",
    "credit_memo_count",
    "delayed_shipments",
    "max_delivery_lag_days",
    "linked_email_count",
    "complaint_email_count",
    "spam_email_count",
    "event_span_days",
]

# --- Fixed values: training parameters --------------------------------------
TRAIN_QUANTILE = 0.8
STRATIFIED_TEST_SHARE = 0.2
SPLIT_SEED = 42
LOGISTIC_ITERATIONS = 600
BOOSTING_RATE = 0.05
BOOSTING_ROUNDS = 250
BOOSTING_DEPTH = 6
CALIBRATION_FOLDS = 3
CV_SPLITS = 5
CV_MIN_FOLD_ROWS = 50

# --- Fixed values: logical names of the outputs -----------------------------
PROCESSED_TABLES = [
    "fact_email",
    "fact_document",
    "fact_order",
    "dim_customer",
    "fact_event_timeline",
    "fact_customer_daily",
    "fact_order_risk_features",
    "retrieval_corpus",
]
JSON_ASSETS = ["build_manifest", "data_quality_report"]
ALLOWED_DATABASE_TABLES = ["contacts", "emails"]
