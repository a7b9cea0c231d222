"""Independent DuckDB SQL for the drift baseline and PSI."""

from __future__ import annotations

from tidemark.functions import constants as K
from tidemark.plans.oracle_analysis import ANALYSIS, ANALYSIS_CTES

CUTOFF = f"DATE '{K.ORDERS_TRAIN_CUTOFF.isoformat()}'"


def _long(src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT customer_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src} WHERE {f} IS NOT NULL"
        for f in K.DRIFT_FEATURES)


def r6(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(38,12)), 6) AS DOUBLE)"


DRIFT_CTES = ANALYSIS_CTES + f""",
cpit AS ({ANALYSIS['train_churn_pit']}),
dtrain AS (SELECT * FROM cpit WHERE signup_date < {CUTOFF}),
blong AS ({_long('dtrain')}),
plong AS ({_long('mart_churn')}),
bstats AS (SELECT feature, count(*) AS n, min(value) AS min, max(value) AS max, avg(value) AS mean,
                  stddev_samp(value) AS std FROM blong GROUP BY feature),
brange AS (SELECT feature, n, CASE WHEN min = max THEN min - 0.5 ELSE min END AS lo,
                  CASE WHEN min = max THEN max + 0.5 ELSE max END AS hi FROM bstats),
bidx0 AS (SELECT l.feature, l.value, r.lo, r.hi, (r.hi - r.lo) / 10 AS width,
                 least(greatest(CAST(floor((l.value - r.lo) * (10 / (r.hi - r.lo))) AS INTEGER), 0), 9) AS i0
          FROM blong l JOIN brange r USING (feature)),
bidx1 AS (SELECT *, CASE WHEN value < lo + i0 * width AND i0 > 0 THEN i0 - 1 ELSE i0 END AS i1 FROM bidx0),
bidx AS (SELECT feature, CASE WHEN value >= lo + (i1 + 1) * width AND i1 < 9 THEN i1 + 1 ELSE i1 END AS bin FROM bidx1),
bcount AS (SELECT feature, bin, count(*) AS c FROM bidx GROUP BY 1, 2),
bhist AS (SELECT r.feature, g.bin, r.lo + g.bin * ((r.hi - r.lo) / 10) AS lower_edge,
                 CASE WHEN g.bin = 9 THEN r.hi ELSE r.lo + (g.bin + 1) * ((r.hi - r.lo) / 10) END AS upper_edge,
                 coalesce(c.c, 0) / r.n AS share
          FROM brange r CROSS JOIN (SELECT range AS bin FROM range(0, 10)) g
          LEFT JOIN bcount c ON c.feature = r.feature AND c.bin = g.bin),
pstats AS (SELECT feature, count(*) AS pn, min(value) AS pmin, max(value) AS pmax FROM plong GROUP BY 1),
pedges AS (SELECT h.feature, h.bin, h.share,
                  CASE WHEN h.bin = 0 THEN least(h.lower_edge, p.pmin) - 1e-6 ELSE h.lower_edge END AS e_lo
           FROM bhist h JOIN pstats p USING (feature)),
pbin AS (SELECT l.feature, (SELECT count(*) FROM pedges e WHERE e.feature = l.feature AND e.bin > 0 AND l.value >= e.e_lo) AS bin
         FROM plong l JOIN pstats USING (feature)),
pcount AS (SELECT feature, bin, count(*) AS c FROM pbin GROUP BY 1, 2),
psi_terms AS (SELECT e.feature, (coalesce(c.c, 0) / p.pn - e.share)
                     * ln((coalesce(c.c, 0) / p.pn + 1e-10) / (e.share + 1e-10)) AS term
              FROM pedges e JOIN pstats p USING (feature) LEFT JOIN pcount c ON c.feature = e.feature AND c.bin = e.bin
              WHERE p.pn >= 10),
either_side AS (SELECT feature FROM bstats UNION SELECT feature FROM pstats),
psi_sum AS (SELECT feature, greatest(sum(term), 0.0) AS raw FROM psi_terms GROUP BY feature),
psi_out AS (SELECT f.feature, {r6('raw')} AS psi,
                   CASE WHEN raw < 0.10 THEN 'no_drift' WHEN raw < 0.20 THEN 'moderate' WHEN raw >= 0.20 THEN 'alert' END AS psi_level,
                   CASE WHEN raw IS NULL THEN 'insufficient_rows' ELSE 'ok' END AS status
            FROM either_side f LEFT JOIN psi_sum s USING (feature)),
points AS (SELECT DISTINCT feature, value FROM (SELECT feature, value FROM blong UNION ALL SELECT feature, value FROM plong)),
steps AS (SELECT t.feature, t.value, coalesce(b.n, 0) AS nb, coalesce(p.n, 0) AS np
          FROM points t LEFT JOIN (SELECT feature, value, count(*) AS n FROM blong GROUP BY 1, 2) b USING (feature, value)
                        LEFT JOIN (SELECT feature, value, count(*) AS n FROM plong GROUP BY 1, 2) p USING (feature, value)),
cdfs AS (SELECT feature, sum(nb) OVER up AS ub, sum(np) OVER up AS up_, sum(nb) OVER whole AS m, sum(np) OVER whole AS n
         FROM steps WINDOW up AS (PARTITION BY feature ORDER BY value), whole AS (PARTITION BY feature)),
ks_raw AS (SELECT feature, CASE WHEN max(n) >= 10 AND max(m) > 0 THEN max(abs(ub / m - up_ / n)) END AS d,
                  sqrt(CAST(max(m) AS DOUBLE) * max(n) / (max(m) + max(n))) AS en, CAST(max(m) AS BIGINT) AS m, CAST(max(n) AS BIGINT) AS n
           FROM cdfs GROUP BY feature),
-- paths of the lattice inside the band, a row of it at a time: a path to (i, j) comes over (i - 1, j') for some j' <= j
lattice AS (
  WITH RECURSIVE small AS (SELECT feature, m, n, round(d * m * n) AS reach FROM ks_raw WHERE d IS NOT NULL AND m * n <= 10000),
  cells AS (SELECT feature, i, unnest(range(0, n + 1)) AS j, m, n, reach FROM (SELECT *, unnest(range(0, m + 1)) AS i FROM small)),
  band AS (SELECT feature, i, j, m, n FROM cells WHERE abs(i * n - j * m) < reach),
  paths AS (
    SELECT feature, i, j, m, n, CAST(1 AS DOUBLE) AS w FROM band WHERE i = 0
    UNION ALL
    SELECT b.feature, b.i, b.j, b.m, b.n, sum(p.w) FROM paths p JOIN band b ON b.feature = p.feature AND b.i = p.i + 1 AND p.j <= b.j
    GROUP BY ALL)
  SELECT s.feature, 1 - coalesce(max(p.w) FILTER (WHERE p.i = s.m AND p.j = s.n), 0)
                        / exp(lgamma(s.m + s.n + 1) - lgamma(s.m + 1) - lgamma(s.n + 1)) AS exact
  FROM small s LEFT JOIN paths p USING (feature) GROUP BY s.feature, s.m, s.n),
ks_out AS (SELECT feature, {r6('d')} AS ks_stat,
                  {r6("CASE WHEN d IS NULL THEN NULL WHEN m * n <= 10000 THEN greatest(0.0, least(1.0, exact)) WHEN en * d < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum(list_transform(range(1, 101), "
                      "lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * k * k * en * d * en * d))))) END")} AS ks_pvalue,
                  CASE WHEN d IS NULL THEN NULL WHEN m * n <= 10000 THEN 'exact' ELSE 'asymptotic' END AS ks_method,
                  CASE WHEN d IS NULL THEN 'insufficient_rows' ELSE 'ok' END AS status
           FROM ks_raw LEFT JOIN lattice USING (feature)),
report AS (SELECT feature, psi, psi_level, ks_stat, ks_pvalue,
                  CASE WHEN a.status = 'ok' AND b.status = 'ok' THEN 'ok' ELSE 'insufficient_rows' END AS status,
                  coalesce(psi > 0.20 OR ks_pvalue < 0.05, FALSE) AS drift_detected
           FROM psi_out a FULL JOIN ks_out b USING (feature))"""

DRIFT = {
    "drift_baseline_stats": f"SELECT feature, n, min, max, {r6('mean')} AS mean, {r6('std')} AS std FROM bstats",
    "drift_baseline_hist": f"""SELECT feature, CAST(bin AS BIGINT) AS bin, {r6('lower_edge')} AS lower_edge,
        {r6('upper_edge')} AS upper_edge, {r6('share')} AS share FROM bhist""",
    "drift_psi": "SELECT * FROM psi_out",
    "drift_ks": "SELECT * FROM ks_out",
    "drift_report": f"""SELECT DATE '{K.ORDERS_AS_OF.isoformat()}' AS checked_at, *, max(psi) OVER () AS max_psi, min(ks_pvalue) OVER () AS min_ks_pvalue,
        (SELECT bool_or(drift_detected) FROM report) AS has_drift,
        coalesce((SELECT string_agg(feature, ',' ORDER BY feature) FROM report WHERE drift_detected), '') AS drifted_features FROM report""",
    "drift_decision": """SELECT max(psi) AS max_psi, min(ks_pvalue) AS min_ks_pvalue,
        coalesce(bool_or(psi > 0.20 OR ks_pvalue < 0.05), FALSE) AS retrain FROM report""",
    "drift_guidance": """SELECT feature, psi, ks_pvalue,
        CASE WHEN psi > 0.20 AND ks_pvalue < 0.05 THEN 'retrain' WHEN psi <= 0.20 AND ks_pvalue < 0.05 THEN 'sampling_artefact'
             WHEN psi > 0.20 AND ks_pvalue >= 0.05 THEN 'investigate' WHEN status <> 'ok' THEN 'insufficient_rows' ELSE 'stable' END AS guidance
        FROM report""",
}
