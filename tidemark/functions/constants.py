"""Fixed values.

Everything in this module is a fixed value that must equal the original
application's for results to agree: enumerations, thresholds, weights,
feature lists and action texts. They are stated plainly, in their natural
order, and used by name everywhere else.
"""

from __future__ import annotations

import datetime as _dt

# --- fixed values: clocks -------------------------------------------------
# as_of for the order-derived tables (time is compressed eight-fold before it)
ORDERS_AS_OF = _dt.date(2001, 8, 1)
# as_of for the event-only operators that read the driver's `events` table
EVENTS_AS_OF = _dt.date(2024, 1, 31)
# time compression factor of the adapter
TIME_COMPRESSION = 8
# customers whose last activity is older than this many days are churned
CHURN_GAP_DAYS = 45
# adapter: a customer's orders count from this day + (custkey * 37) % 2400
CUSTOMER_FLOOR_ORIGIN = _dt.date(1995, 1, 1)
CUSTOMER_FLOOR_MULT = 37
CUSTOMER_FLOOR_SPAN = 2400
UPGRADE_ORDER_PRICE = 200000
UPGRADE_MIN_DAYS = 30

# --- fixed values: enumerations ------------------------------------------
PLAN_TIERS = ["free", "starter", "growth", "enterprise", "custom"]
INDUSTRIES = ["FinTech", "HealthTech", "LegalTech", "HR Tech", "EdTech",
              "InsurTech", "PropTech", "RetailTech", "Other"]
EVENT_TYPES = ["evidence_upload", "monitoring_run", "report_view", "user_invite",
               "integration_connect", "api_call", "premium_feature_trial",
               "feature_limit_hit"]
PRIORITIES = ["low", "medium", "high", "critical"]
TOPICS = ["compliance", "integration", "billing", "onboarding", "feature_request"]
STAGES = ["prospecting", "qualification", "proposal", "closed_won", "closed_lost"]
CLOSED_STAGES = ["closed_won", "closed_lost"]
OUTCOMES = ["upgraded", "no_response", "active", "churned"]
OPPORTUNITY_TYPES = ["expansion", "new_business"]
OUTREACH_CHANNELS = ["email", "phone", "in_app", "qbr"]
RISK_TIERS = ["low", "medium", "high", "critical"]
SIGNAL_TIERS = ["low", "medium", "high"]

# adapter: driver order priority -> ticket priority
ORDER_PRIORITY_TO_TICKET = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium"}
OUTREACH_ORDER_PRIORITY = "5-LOW"

# --- fixed values: staging rules -----------------------------------------
RETENTION_EVENT_TYPES = ["integration_connect", "api_call", "monitoring_run"]
# a second definition used by the descriptive analyses
EDA_RETENTION_EVENT_TYPES = ["evidence_upload", "monitoring_run", "report_view"]
HIGH_PRIORITIES = ["high", "critical"]
EARLY_STAGE_DAYS = 90
CHURN_SIGNAL_DAYS = 60
GAP_TIER_HIGH = 0.70
GAP_TIER_MEDIUM = 0.35

# --- fixed values: risk mart ---------------------------------------------
# (flag name, driver label or None, weight) in mart order
RISK_FLAGS = [
    ("flag_very_low_events", "low_events", "0.18"),
    ("flag_zero_recent_events", "zero_7d_events", "0.20"),
    ("flag_low_adoption", "low_adoption", "0.15"),
    ("flag_inactive_2w", "inactive_14d", "0.12"),
    ("flag_high_support_load", "support_overload", "0.12"),
    ("flag_ticket_surge", None, "0.08"),
    ("flag_early_stage_at_risk", "onboarding_at_risk", "0.15"),
    ("flag_low_onboarding", "low_integration", "0.10"),
    ("flag_no_retention_signals", None, "0.10"),
]
RISK_BASE_RATE = "0.10"
TIER_CRITICAL = 0.75
TIER_HIGH = 0.50
TIER_MEDIUM = 0.25

# chart labels of the seven flags on the single-customer view
C360_FLAG_LABELS = [
    ("flag_very_low_events", "Low Product Events (30d)"),
    ("flag_zero_recent_events", "Zero 7-Day Events"),
    ("flag_low_adoption", "Low Adoption Score"),
    ("flag_inactive_2w", "Inactive 14+ Days"),
    ("flag_high_support_load", "High-Priority Tickets"),
    ("flag_early_stage_at_risk", "Early-Stage at Risk"),
    ("flag_low_onboarding", "Low Onboarding"),
]

DRILL_ACTIONS = {
    "critical": "CRITICAL – Escalate to senior CSM. EBR within 7d.",
    "high": "HIGH RISK – Outreach within 48h. Review top drivers.",
    "medium": "MEDIUM – Add to watch list. Schedule check-in.",
    "low": "LOW RISK – Monitor monthly.",
}
CHURN_ACTIONS = {
    "critical": "CRITICAL – Escalate to senior CSM immediately. Schedule EBR within 7 days.",
    "high": "HIGH RISK – Trigger CS outreach within 48 hours. Review top SHAP drivers.",
    "medium": "MEDIUM RISK – Add to CSM watch list. Schedule check-in call.",
    "low": "LOW RISK – No immediate action required. Monitor monthly.",
}

# --- fixed values: expansion ---------------------------------------------
# plan tier -> (mrr floor, mrr ceiling) for tier-ceiling pressure
TIER_MRR_BANDS = {"free": (0.0, 0.01), "starter": (500.0, 2000.0),
                  "growth": (2000.0, 8000.0), "enterprise": (8000.0, 50000.0)}
NEXT_TIER = {"free": "starter", "starter": "growth", "growth": "enterprise",
             "enterprise": "custom"}
UPLIFT_MULTIPLIER = {"free": 0.0, "starter": 3.0, "growth": 5.0,
                     "enterprise": 1.2, "custom": 0.0}
FREE_TO_STARTER_FLOOR_MRR = 500.0
HIGH_VALUE_UPLIFT = 10000
QUADRANT_WEIGHTS = {"trial": 0.30, "limit": 0.25, "request": 0.15, "opp": 0.20, "ceiling": 0.10}

# --- fixed values: model features ----------------------------------------
CHURN_NUMERIC_FEATURES = [
    "mrr", "tenure_days", "total_events", "events_last_30d", "events_last_7d",
    "avg_adoption_score", "days_since_last_event", "retention_signal_count",
    "integration_connects_first_30d", "activated_at_30d", "tickets_last_30d",
    "high_priority_tickets", "avg_resolution_hours", "is_early_stage",
]
EXPANSION_EXTRA_FEATURES = [
    "premium_feature_trials_30d", "feature_request_tickets_90d",
    "has_open_expansion_opp", "expansion_opp_amount", "mrr_tier_ceiling_pct",
    "feature_limit_hit_30d",
]
EXPANSION_NUMERIC_FEATURES = CHURN_NUMERIC_FEATURES + EXPANSION_EXTRA_FEATURES
CATEGORICAL_FEATURES = ["plan_tier", "industry"]
TRAIN_CUTOFF = _dt.date(2025, 6, 1)
RANDOM_SEED = 42

# --- fixed values: drift --------------------------------------------------
DRIFT_FEATURES = [
    "mrr", "tenure_days", "total_events", "events_last_30d", "events_last_7d",
    "avg_adoption_score", "days_since_last_event", "retention_signal_count",
    "integration_connects_first_30d", "tickets_last_30d",
    "high_priority_tickets", "avg_resolution_hours",
]
DRIFT_BINS = 10
DRIFT_MIN_ROWS = 10
PSI_EPS = 1e-10
PSI_EDGE_WIDEN = 1e-6
PSI_MODERATE = 0.10
PSI_ALERT = 0.20
KS_ALPHA = 0.05

# --- fixed values: out-of-time split on the compressed order calendar ---------
# (the original splits at TRAIN_CUTOFF on its own calendar; on the adapter's
# calendar signups span Oct 2000 - Aug 2001, and this date leaves ~2/3 in train)
ORDERS_TRAIN_CUTOFF = _dt.date(2001, 5, 1)

# fixed values: output texts
FLIGHT_RISK_REASON = ("Churn probability %d%% and upgrade propensity %d%% both exceed 50%% threshold. "
                      "Restore account health before any upsell motion.")
