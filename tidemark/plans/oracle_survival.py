"""Independent DuckDB SQL for the survival queries."""

from __future__ import annotations

from tidemark.plans.oracle_base import AS_OF

Z95 = "1.959963984540054"


def r(x: str, d: int = 9) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), {d}) AS DOUBLE)"


SURV_CTES = f"""
sd AS (
  SELECT customer_id, plan_tier, industry, CASE WHEN churn_date IS NOT NULL THEN 1 ELSE 0 END AS event,
         date_diff('day', signup_date, coalesce(churn_date, {AS_OF})) AS duration_days
  FROM raw_customers WHERE date_diff('day', signup_date, coalesce(churn_date, {AS_OF})) > 0),
ud AS (
  SELECT customer_id, plan_tier, industry, date_diff('day', signup_date, coalesce(upgrade_date, {AS_OF})) AS duration_days,
         CASE WHEN upgrade_date IS NOT NULL THEN 1 ELSE 0 END AS event
  FROM raw_customers WHERE churn_date IS NULL OR upgrade_date IS NOT NULL)"""


def km_sql(source: str, stratum: str) -> str:
    return f"""
SELECT stratum, CAST(t AS BIGINT) AS t, CAST(n AS BIGINT) AS n_at_risk, CAST(events AS BIGINT) AS events,
       {r('s')} AS survival,
       CASE WHEN s > 0 AND s < 1 THEN {r(f'exp(-exp(ln(-ln(s)) + {Z95} * sqrt(cs) / ln(s)))')} END AS ci_lower,
       CASE WHEN s > 0 AND s < 1 THEN {r(f'exp(-exp(ln(-ln(s)) - {Z95} * sqrt(cs) / ln(s)))')} END AS ci_upper
FROM (
  SELECT *, CASE WHEN z = 1 THEN 0.0 ELSE exp(lg) END AS s FROM (
    SELECT *, sum(CASE WHEN events < n THEN ln(1 - events / n) ELSE 0 END) OVER w AS lg,
           max(CASE WHEN events = n AND events > 0 THEN 1 ELSE 0 END) OVER w AS z,
           sum(CASE WHEN n > events THEN events / (n * (n - events)) ELSE 0 END) OVER w AS cs
    FROM (SELECT *, sum(removed) OVER (PARTITION BY stratum ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n
          FROM (SELECT CAST({stratum} AS VARCHAR) AS stratum, duration_days AS t, count(*) AS removed,
                       CAST(sum(event) AS BIGINT) AS events FROM {source} GROUP BY 1, 2))
    WINDOW w AS (PARTITION BY stratum ORDER BY t ROWS UNBOUNDED PRECEDING)))"""


def km_cte(name: str, source: str, stratum: str) -> str:
    return f"{name} AS ({km_sql(source, stratum)})"


def logrank2_sql(source: str, group: str, name: str) -> str:
    return f"""
SELECT '{name}' AS test, {r('o')} AS observed, {r('e')} AS expected, {r('v')} AS variance,
       {r('(o - e) * (o - e) / v')} AS chi2, CAST(1 AS BIGINT) AS df
FROM (SELECT CAST(sum(d1) AS DOUBLE) AS o, sum(d * n1 / n) AS e,
             sum(CASE WHEN n > 1 THEN d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1) ELSE 0 END) AS v
      FROM (SELECT *, CAST(sum(rr) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS n,
                   CAST(sum(r1) OVER (ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS n1
            FROM (SELECT duration_days AS t, count(*) AS rr, count(*) FILTER (WHERE {group}) AS r1,
                         CAST(sum(event) AS DOUBLE) AS d, CAST(sum(CASE WHEN {group} THEN event ELSE 0 END) AS DOUBLE) AS d1
                  FROM {source} GROUP BY 1)))"""


SURVIVAL = {
    "surv_dataset": ("SELECT customer_id, plan_tier, industry, CAST(event AS BIGINT) AS event, CAST(duration_days AS BIGINT) AS duration_days FROM sd", ""),
    "surv_km_tier": ("SELECT * FROM km_tier", km_cte("km_tier", "sd", "plan_tier")),
    "surv_km_industry": ("SELECT * FROM km_ind", km_cte("km_ind", "sd", "industry")),
    "surv_km_all": ("SELECT * FROM km_all", km_cte("km_all", "sd", "'all'")),
    "surv_median": ("SELECT stratum, min(t) FILTER (WHERE survival <= 0.5) AS median_survival_days FROM km_tier GROUP BY 1",
                    km_cte("km_tier", "sd", "plan_tier")),
    "surv_at_t": ("""SELECT stratum,
        coalesce(arg_max(survival, t) FILTER (WHERE t <= 90), 1.0) AS s_90,
        coalesce(arg_max(survival, t) FILTER (WHERE t <= 180), 1.0) AS s_180,
        coalesce(arg_max(survival, t) FILTER (WHERE t <= 365), 1.0) AS s_365 FROM km_tier GROUP BY 1""",
                  km_cte("km_tier", "sd", "plan_tier")),
    "surv_logrank_starter_enterprise": (logrank2_sql("(SELECT * FROM sd WHERE plan_tier IN ('starter', 'enterprise'))",
                                                     "plan_tier = 'starter'", "starter_vs_enterprise"), ""),
    "surv_dropout_90d": ("""SELECT plan_tier, industry, count(*) AS n,
        count(*) FILTER (WHERE event = 1 AND duration_days <= 90) AS churned_90d,
        CAST(round(CAST(count(*) FILTER (WHERE event = 1 AND duration_days <= 90) / count(*) AS DECIMAL(38,10)), 6) AS DOUBLE) AS dropout_rate
        FROM sd GROUP BY 1, 2""", ""),
    "surv_dropout_90d_pivot": ("""SELECT * FROM (
        PIVOT (SELECT plan_tier, industry,
               CAST(round(CAST(count(*) FILTER (WHERE event = 1 AND duration_days <= 90) / count(*) AS DECIMAL(38,10)), 6) AS DOUBLE) AS dropout_rate
               FROM sd GROUP BY 1, 2)
        ON plan_tier IN ('free', 'starter', 'growth', 'enterprise', 'custom') USING first(dropout_rate) GROUP BY industry)""", ""),
    "surv_time_to_upgrade": ("SELECT * FROM km_up", km_cte("km_up", "ud", "plan_tier")),
}


HAZARD_CTES = """
hz_end AS (SELECT max(duration_days) AS last FROM sd),
hz_ch AS (SELECT greatest(duration_days, 1) AS day, count(*) AS churns FROM sd WHERE event = 1 GROUP BY 1),
hz_days AS (SELECT unnest(range(1, last + 1)) AS day FROM hz_end),
hz_ar AS (SELECT d.day, (SELECT count(*) FROM sd WHERE duration_days >= d.day) AS at_risk FROM hz_days d),
hz AS (SELECT d.day, coalesce(churns, 0) AS churns, greatest(coalesce(at_risk, 0), 1) AS at_risk,
              coalesce(churns, 0) / greatest(coalesce(at_risk, 0), 1) AS raw
       FROM hz_days d LEFT JOIN hz_ch ON hz_ch.day = d.day LEFT JOIN hz_ar ON hz_ar.day = d.day),
hz_ext AS (SELECT day, raw FROM hz UNION ALL SELECT 1 - day, raw FROM hz WHERE day <= 28
           UNION ALL SELECT 2 * last + 1 - day, raw FROM hz, hz_end WHERE day > last - 28),
kern AS (SELECT range AS k, exp(-0.5 * (range / 7.0) * (range / 7.0)) AS w FROM range(-28, 29)),
kn AS (SELECT k, w / sum(w) OVER () AS w FROM kern),
hz_sm AS (SELECT h.day, sum(e.raw * kn.w) AS smoothed FROM hz h, kn, hz_ext e WHERE e.day = h.day + kn.k GROUP BY h.day)"""

SURVIVAL["surv_hazard"] = (f"""SELECT CAST(h.day AS BIGINT) AS day, CAST(h.churns AS BIGINT) AS churns, CAST(h.at_risk AS BIGINT) AS at_risk,
       {r('h.raw')} AS raw_hazard, {r('s.smoothed')} AS smoothed_hazard FROM hz h JOIN hz_sm s USING (day)""", HAZARD_CTES)

SURVIVAL["surv_hazard_peak"] = (f"""SELECT arg_max(day, (sm, -day)) AS peak_day, max(sm) AS peak_hazard
FROM (SELECT CAST(h.day AS BIGINT) AS day, {r('s.smoothed')} AS sm FROM hz h JOIN hz_sm s USING (day))""", HAZARD_CTES)
