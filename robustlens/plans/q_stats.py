"""T and U01/U02: statistics over trials, grouped pairs and metric observations."""
from pyspark.sql import functions as F

from ..functions import pvalues as pv
from ..functions.numeric import cohens_d, div0, is_finite, r6, safe_corr, sd0, sdp0
from ..operators import joins as jn
from ..operators import regression as rg
from ..operators import stats as st
from ..operators import trials as tr
from ..operators import windows as wn
from ..session import materialize
from . import bindings as b
from .q_aggregates import _DROP, _GP, _MS, grouped, grouped_by_item, metric_means, outcomes, rounded
from .q_joins import _CTRL, _COS, _L2
from .q_windows import _FL, layered_filters, overlap_2d_rows, _M2
from .registry import query
from .sqlkit import CORR, DIV0, HI, R, SLOPE


# p-values in SQL: the t and F tails as ratios of one integrand, midpoint rule in the angle
def _TAIL(t2, d1, d2, points=40000):
    """P(F(d1, d2) > t2) for the row: integrand sin^(d1-1) cos^(d2-1); theta from atan(sqrt(d1*F/d2)) to pi/2."""
    th = f"atan(sqrt({d1} * {t2} / {d2}))"
    f = f"exp(({d1} - 1) * ln(greatest(sin({{a}}), 1e-300)) + ({d2} - 1) * ln(greatest(cos({{a}}), 1e-300)))"
    lo = f"({th} + (pi() / 2 - {th}) * (i + 0.5) / {points})"
    al = f"(pi() / 2 * (i + 0.5) / {points})"
    return (f"(SELECT sum({f.format(a=lo)}) * (pi() / 2 - {th}) / (sum({f.format(a=al)}) * (pi() / 2)) FROM range({points}) r(i))")


def R4(x, digits=4):
    return f"(round(CAST({x} AS DOUBLE), {digits}) + 0e0)"


def TP(t, dof):
    """Two-sided p of a t statistic to four digits; 1 where it is undefined."""
    return R4(f"CASE WHEN ({t}) IS NULL OR ({dof}) <= 0 THEN 1 ELSE {_TAIL(f'(({t}) * ({t}))', '1', f'CAST(({dof}) AS DOUBLE)')} END")


def RP(r, n, digits=4):
    """Two-sided p of a correlation; three digits suit ranks of computed values, whose ties the engines' last bits can break."""
    t2 = f"(({r}) * ({r}) * (({n}) - 2) / greatest(1 - ({r}) * ({r}), 1e-300))"
    return R4(f"CASE WHEN ({r}) IS NULL OR ({n}) <= 2 THEN 1 ELSE {_TAIL(t2, '1', f'CAST(({n}) - 2 AS DOUBLE)')} END", digits)


def p4(c):
    return F.round(c, 4) + 0.0


@query("t01_pearson", f"{b.T()}, q AS (SELECT family, level_no, count(*) AS n, {CORR('csem', 'loglik_drift')} AS r FROM tr GROUP BY 1, 2) SELECT family, level_no, CAST(n AS BIGINT) AS n, {R('r')} AS r, {RP('q.r', 'q.n')} AS p_value FROM q")
def t01(spark, sf):
    r = st.pearson(outcomes(spark, sf), ["family", "level_no"], "csem", "loglik_drift")
    return rounded(r.withColumn("p_value", p4(pv.corr_pvalue("r", "n"))), "r")


def RK(x, part):
    return f"(rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2.0)"


@query("t02_spearman", f"{b.T()}, k AS (SELECT family, {RK('csem', 'family')} AS a, {RK('loglik_drift', 'family')} AS b FROM tr) , q AS (SELECT family, count(*) AS n, {CORR('a', 'b')} AS rho FROM k GROUP BY 1) SELECT family, CAST(n AS BIGINT) AS n, {R('rho')} AS rho, {RP('q.rho', 'q.n')} AS p_value FROM q")
def t02(spark, sf):
    r = st.spearman(outcomes(spark, sf), ["family"], "csem", "loglik_drift")
    return rounded(r.withColumn("p_value", p4(pv.corr_pvalue("rho", "n"))), "rho")


def TAU(cte, key, o, x):
    """Kendall tau-b of x against o per key over a small table."""
    return f"""(SELECT a.{key}, sum(sign(b.{o} - a.{o}) * sign(b.{x} - a.{x})) AS s, sum(abs(sign(b.{o} - a.{o}))) AS tx, sum(abs(sign(b.{x} - a.{x}))) AS ty
  FROM {cte} a JOIN {cte} b ON a.{key} = b.{key} AND a.level_no < b.level_no GROUP BY a.{key})"""


@query("t03_kendall_monotone", f"""{b.T()}, m AS MATERIALIZED (SELECT family, level_no, round(avg(accuracy_drop), 9) AS v FROM tr GROUP BY 1, 2)
SELECT family, {R('CASE WHEN tx * ty > 0 THEN s / sqrt(tx * ty) ELSE 0 END')} AS tau, (SELECT bool_and(p <= v) FROM (SELECT v, lag(v) OVER (ORDER BY level_no) AS p FROM m WHERE m.family = q.family)) AS monotone FROM {TAU('m', 'family', 'level_no', 'v')} q""")
def t03(spark, sf):
    m = outcomes(spark, sf).groupBy("family", "level_no").agg(F.round(F.avg("accuracy_drop"), 9).alias("v"))
    lad = st.ladder(m, ["family"], "level_no", "v")
    mono = F.forall(F.sequence(F.lit(2), F.greatest(F.size("pts"), F.lit(2))), lambda i: F.coalesce(
        F.try_element_at("pts", i - 1)["v"] <= F.try_element_at("pts", i)["v"], F.lit(True))) | (F.size("pts") < 3)
    return lad.select("family", r6(st.kendall_tau(F.col("pts"), "ord", "v")).alias("tau"), mono.alias("monotone"))


_ANOVA = """sum(n) AS N, sum(s) AS S, sum(q) AS Q, sum(s * s / n) AS B, count(*) AS k"""


def _FSQL(src):
    return f"""(SELECT {_ANOVA} FROM {src})"""


@query("t04_anova", f"""{b.T()}, c AS (SELECT level_no, perturbation, avg(accuracy_drop) AS m, count(*) AS n FROM tr GROUP BY 1, 2), w AS (SELECT level_no, sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS q FROM c GROUP BY 1),
d AS (SELECT level_no, count(*) AS n, sum(accuracy_drop) AS s, sum(accuracy_drop * accuracy_drop) AS q FROM tr GROUP BY 1), a AS (SELECT 'cell_means' AS grain, * FROM {_FSQL('w')} UNION ALL SELECT 'rows', * FROM {_FSQL('d')})
, q AS (SELECT grain, ((B - S * S / N) / (k - 1)) / ((Q - B) / (N - k)) AS f, CAST(k - 1 AS DOUBLE) AS df1, CAST(N - k AS DOUBLE) AS df2 FROM a)
SELECT grain, {R('f')} AS f_stat, df1, df2, {R4(_TAIL('q.f', 'q.df1', 'q.df2'))} AS p_value FROM q""")
def t04(spark, sf):
    t = outcomes(spark, sf)
    cell = t.groupBy("level_no", "perturbation").agg(F.avg("accuracy_drop").alias("m"), F.count("*").alias("n"))
    w = cell.groupBy("level_no").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"))
    d = t.groupBy("level_no").agg(F.count("*").alias("n"), F.sum("accuracy_drop").alias("s"), F.sum(F.col("accuracy_drop") * F.col("accuracy_drop")).alias("q"))
    both = w.withColumn("grain", F.lit("cell_means")).unionByName(d.withColumn("grain", F.lit("rows")))
    return rounded(st.anova(both, ["grain"]).withColumn("p_value", p4(pv.f_pvalue("f_stat", "df1", "df2"))), "f_stat")


_MIRC = """cell AS (SELECT item_id, level_no, avg(volatility) AS volatility, avg(accuracy_drop) AS accuracy_drop FROM tr GROUP BY 1, 2),
mir AS (SELECT 'volatility' AS outcome, CAST(x.level_no AS INT) AS rung, x.volatility AS base, y.volatility AS wordy FROM cell x JOIN cell y ON x.item_id = y.item_id AND y.level_no = x.level_no + 4 WHERE x.level_no <= 4
  UNION ALL SELECT 'accuracy_drop', CAST(x.level_no AS INT), x.accuracy_drop, y.accuracy_drop FROM cell x JOIN cell y ON x.item_id = y.item_id AND y.level_no = x.level_no + 4 WHERE x.level_no <= 4)"""


@query("t06_paired_ttest", f"""{b.T()}, {_MIRC} , q AS (SELECT count(*) AS n, avg(base - wordy) AS ef, avg(base - wordy) / (stddev_samp(base - wordy) / sqrt(count(*))) AS t FROM mir WHERE outcome = 'volatility')
SELECT CAST(n AS BIGINT) AS n_pairs, {R('ef')} AS effect, {R('t')} AS t_stat, {TP('q.t', 'q.n - 1')} AS p_value FROM q""")
def t06(spark, sf):
    m = jn.mirror_cells(outcomes(spark, sf), ["volatility"])
    return rounded(m.agg(*st.paired_columns("base_volatility", "wordy_volatility")).select("n_pairs", "effect", "t_stat", p4(pv.t_pvalue("t_stat", "dof")).alias("p_value")), "effect", "t_stat")


_T07 = f"""{b.T()}, {_MIRC}, g AS (SELECT outcome, rung, count(*) AS n, avg(base) AS mb, avg(wordy) AS mw, avg(base - wordy) AS ef, stddev_samp(base - wordy) AS sd FROM mir GROUP BY GROUPING SETS ((outcome, rung), (outcome)))"""


@query("t07_mirror_ttests", f"""{_T07} SELECT outcome, rung, CAST(n AS BIGINT) AS n_pairs, {R('mb')} AS mean_x, {R('mw')} AS mean_y, {R('ef')} AS effect, {R('ef / (sd / sqrt(n))')} AS t_stat, {R('ef / sd')} AS dz FROM g""")
def t07(spark, sf):
    m = jn.mirror_cells(outcomes(spark, sf), ["volatility", "accuracy_drop"])
    out = st.mirror_ttests(m, ["volatility", "accuracy_drop"]).drop("sem", "dof")
    return rounded(out, "mean_x", "mean_y", "effect", "t_stat", "dz")


@query("u01_tail_probabilities", f"""{_T07}, q AS (SELECT outcome, rung, n - 1.0e0 AS dof, ef / (sd / sqrt(n)) AS t FROM g) SELECT outcome, rung, {R('t')} AS t_stat, {R4(_TAIL('q.t * q.t', '1', 'q.dof'))} AS p_value FROM q""")
def u01(spark, sf):
    m = jn.mirror_cells(outcomes(spark, sf), ["volatility", "accuracy_drop"])
    t = st.mirror_ttests(m, ["volatility", "accuracy_drop"])
    return t.select("outcome", "rung", r6("t_stat").alias("t_stat"), (F.round(pv.t_pvalue("t_stat", "dof"), 4) + 0.0).alias("p_value"))


@query("t07_mirror_intervals", None)
def t07ci(spark, sf):
    m = jn.mirror_cells(outcomes(spark, sf), ["volatility", "accuracy_drop"])
    t = st.mirror_ttests(m, ["volatility", "accuracy_drop"]).withColumn("crit", pv.t_critical("dof"))
    return t.select("outcome", "rung", r6("effect").alias("effect"), r6(F.col("effect") - F.col("crit") * F.col("sem")).alias("ci_lower"),
                    r6(F.col("effect") + F.col("crit") * F.col("sem")).alias("ci_upper"), r6(pv.t_pvalue("t_stat", "dof")).alias("p_value"))


_B, _SEED = 1000, 42
_W = "CASE " + " ".join(f"WHEN u < {c} THEN {i}" for i, c in enumerate(st.POISSON_CDF)) + f" ELSE {len(st.POISSON_CDF)} END"


def BOOT(units, unit_cols, sums, keys, n_boot=_B, seed=_SEED):
    """CTEs bd (one row per keys and draw) over a table of units."""
    coef = ", ".join(f"({i}, {a}, {c})" for i, (a, c) in enumerate(st.draw_coefficients(n_boot, seed)))
    k = "".join(f"{x}, " for x in keys)
    return f"""co(draw, a, c) AS (VALUES {coef}), ux AS (SELECT *, {HI('unit', *unit_cols)} AS x FROM {units}),
uw AS (SELECT {k}draw, {', '.join(sums)}, CAST((CAST(x AS HUGEINT) * a + c) % {st.PRIME} AS DOUBLE) / {st.PRIME}e0 AS u FROM ux, co),
bd AS (SELECT {k}draw, {', '.join(f'sum(({_W}) * {s}) AS {s}' for s in sums)} FROM uw GROUP BY {k}draw)"""


@query("t08_bootstrap_mean", f"""{b.T()}, un AS (SELECT level_no, item_id, sum(volatility) AS s, count(*) AS n FROM tr GROUP BY 1, 2), {BOOT('un', ['item_id'], ['s', 'n'], ['level_no'])}
SELECT level_no, {R("quantile_cont(CAST(s / n AS DOUBLE), 0.025)")} AS ci_lower, {R("quantile_cont(CAST(s / n AS DOUBLE), 0.975)")} AS ci_upper, (SELECT {R('sum(s) / sum(n)')} FROM un WHERE un.level_no = bd.level_no) AS estimate FROM bd GROUP BY level_no""")
def t08(spark, sf):
    un = outcomes(spark, sf).groupBy("level_no", "item_id").agg(F.sum("volatility").alias("s"), F.count("*").alias("n"))
    return rounded(st.bootstrap_ci(un, ["level_no"], ["item_id"], "mean", _B, 0.95, _SEED), "ci_lower", "ci_upper", "estimate")


@query("u02_bootstrap_correlation", f"""{b.T()}, un AS (SELECT family, item_id, count(*) AS n, sum(csem) AS sx, sum(volatility) AS sy, sum(csem * csem) AS qxx, sum(volatility * volatility) AS qyy, sum(csem * volatility) AS qxy FROM tr GROUP BY 1, 2),
{BOOT('un', ['item_id'], ['n', 'sx', 'sy', 'qxx', 'qyy', 'qxy'], ['family'])}, r AS (SELECT family, (qxy - sx * sy / n) / sqrt((qxx - sx * sx / n) * (qyy - sy * sy / n)) AS r FROM bd)
SELECT family, {R('quantile_cont(CAST(r AS DOUBLE), 0.025)')} AS ci_lower, {R('quantile_cont(CAST(r AS DOUBLE), 0.975)')} AS ci_upper, (SELECT {R('(sum(qxy) - sum(sx) * sum(sy) / sum(n)) / sqrt((sum(qxx) - sum(sx) * sum(sx) / sum(n)) * (sum(qyy) - sum(sy) * sum(sy) / sum(n)))')} FROM un WHERE un.family = r.family) AS estimate FROM r GROUP BY family""")
def u02(spark, sf):
    x, y = F.col("csem"), F.col("volatility")
    un = outcomes(spark, sf).groupBy("family", "item_id").agg(
        F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("qxx"), F.sum(y * y).alias("qyy"), F.sum(x * y).alias("qxy"))
    return rounded(st.bootstrap_ci(un, ["family"], ["item_id"], "corr", _B, 0.95, _SEED), "ci_lower", "ci_upper", "estimate")


_CI9 = "tanh(atanh(greatest(least(r, 0.999999), -0.999999)) {s} 1.96 / sqrt(n - 3))"


@query("t09_fisher_interval", f"""{b.T()}, c AS (SELECT perturbation, count(*) AS n, {CORR('csem', 'volatility')} AS r FROM tr GROUP BY 1)
SELECT perturbation, {R('r')} AS r, {R(f"CASE WHEN n <= 3 THEN r ELSE {_CI9.format(s='-')} END")} AS ci_lower, {R(f"CASE WHEN n <= 3 THEN r ELSE {_CI9.format(s='+')} END")} AS ci_upper FROM c""")
def t09(spark, sf):
    c = st.pearson(outcomes(spark, sf), ["perturbation"], "csem", "volatility")
    lo, hi = st.fisher_ci(F.col("r"), F.col("n"))
    return c.select("perturbation", r6("r").alias("r"), r6(lo).alias("ci_lower"), r6(hi).alias("ci_upper"))


@query("t10_linear_trend", f"""{b.T()}, g AS (SELECT perturbation, count(*) AS n, CASE WHEN count(*) >= 3 THEN {SLOPE('csem', 'volatility')} ELSE 0 END AS sl, avg(csem) AS mx, avg(volatility) AS my, {CORR('csem', 'volatility')} AS r, min(csem) AS a, max(csem) AS b, min(volatility) AS c, max(volatility) AS d FROM tr GROUP BY 1),
k AS (SELECT perturbation, {RK('csem', 'perturbation')} AS ra, {RK('volatility', 'perturbation')} AS rb FROM tr), s AS (SELECT perturbation, {CORR('ra', 'rb')} AS rho FROM k GROUP BY 1)
SELECT perturbation, CAST(n AS BIGINT) AS n, {R('sl')} AS slope, {R('my - sl * mx')} AS intercept, {R('r')} AS pearson_r, {RP('g.r', 'g.n')} AS pearson_p, {R('rho')} AS spearman_rho, {RP('s.rho', 'g.n')} AS spearman_p, {R('a')} AS x_min, {R('b')} AS x_max, {R('c')} AS y_min, {R('d')} AS y_max FROM g JOIN s USING (perturbation)""")
def t10(spark, sf):
    t = outcomes(spark, sf)
    rho = st.spearman(t, ["perturbation"], "csem", "volatility").select("perturbation", F.col("rho").alias("spearman_rho"))
    out = st.linear_trend(t, ["perturbation"], "csem", "volatility").join(rho, "perturbation")
    out = rounded(out, *[c for c in out.columns if c not in ("perturbation", "n", "pearson_r", "spearman_rho")])
    out = out.withColumn("pearson_p", p4(pv.corr_pvalue("pearson_r", "n"))).withColumn("spearman_p", p4(pv.corr_pvalue("spearman_rho", "n")))
    return rounded(out, "pearson_r", "spearman_rho")


@query("t11_complexity_residual", f"""{b.T()}, f AS (SELECT greatest(regr_slope(csem, cprompt), 0) AS b, avg(csem) AS my, avg(cprompt) AS mx, var_pop(csem) AS vy, var_pop(cprompt) AS vx, covar_pop(csem, cprompt) AS c FROM tr WHERE level_no <= 4)
SELECT item_id, level_no, perturbation, {R('csem - (my - b * mx) - b * cprompt')} AS residual, {R('1 - (vy - 2 * b * c + b * b * vx) / vy')} AS r_squared FROM tr, f""")
def t11(spark, sf):
    rows, fit = st.linear_residual(outcomes(spark, sf), "csem", "cprompt", F.col("level_no") <= 4, 0.0)
    r2 = fit.select("r_squared").scalar()
    return rows.select("item_id", "level_no", "perturbation", r6("residual").alias("residual")).withColumn("r_squared", r6(r2))


@query("t12_within_group_slopes", f"""{b.T()}, g AS (SELECT item_id, count(*) AS n, regr_slope(loglik_drift, csem) AS b, avg(csem) AS mx, avg(loglik_drift) AS my, CASE WHEN count(*) >= 3 AND min(loglik_drift) < max(loglik_drift) THEN {CORR('csem', 'loglik_drift')} END AS r FROM tr GROUP BY 1 HAVING min(csem) < max(csem)),
un AS (SELECT item_id, b AS s, 1 AS n FROM g), {BOOT('un', ['item_id'], ['s', 'n'], [])}, q AS (SELECT count(*) AS n, avg(b) / (stddev_samp(b) / sqrt(count(*))) AS t FROM g)
SELECT CAST(count(*) AS BIGINT) AS n_groups, (SELECT {TP('q.t', 'q.n - 1')} FROM q) AS p_value, {R('avg(n)')} AS mean_points, {R('avg(b)')} AS mean_slope, {R('stddev_pop(b)')} AS std_slope, {R('avg(my - b * mx)')} AS mean_intercept, {R('coalesce(avg(r), 0)')} AS mean_within_r, {R('avg(b) / (stddev_samp(b) / sqrt(count(*)))')} AS t_stat,
  (SELECT {R('quantile_cont(CAST(s / n AS DOUBLE), 0.025)')} FROM bd) AS slope_ci_lower, (SELECT {R('quantile_cont(CAST(s / n AS DOUBLE), 0.975)')} FROM bd) AS slope_ci_upper FROM g""")
def t12(spark, sf):
    out = st.slope_trend(outcomes(spark, sf), "item_id", "csem", "loglik_drift", _B, 0.95, _SEED)
    out = rounded(out.withColumn("p_value", pv.t_pvalue("t_stat", (F.col("n_groups") - 1).cast("double"))), *[c for c in out.columns if c != "n_groups"])
    return out.withColumn("p_value", p4(F.col("p_value")))


# --- regression oracles: two predictors in closed form ------------------------------------------------------
def OLS2(rows, params, key="key", tss="yy", name="o", second="cprompt"):
    """CTEs ending in <name>: key, x, beta, se (CR1), cse, n, g, r2 over rows(key, cl, x1, x2, y[, ry]) already centred.

    `params` counts all columns of the design (predictors, intercept, dummies)."""
    return f"""{name}g AS MATERIALIZED (SELECT {key}, count(*) AS n, sum(x1*x1) AS a, sum(x1*x2) AS h, sum(x2*x2) AS d, sum(x1*y) AS p, sum(x2*y) AS q, sum(y*y) AS yy, {tss} AS tss FROM {rows} GROUP BY {key}),
{name}b AS MATERIALIZED (SELECT *, (d*p - h*q) / (a*d - h*h) AS b1, (a*q - h*p) / (a*d - h*h) AS b2, d / (a*d - h*h) AS i1, -h / (a*d - h*h) AS i12, a / (a*d - h*h) AS i2 FROM {name}g),
{name}u AS (SELECT r.{key}, r.cl, sum(x1 * (y - b1*x1 - b2*x2)) AS u1, sum(x2 * (y - b1*x1 - b2*x2)) AS u2 FROM {rows} r JOIN {name}b ON {name}b.{key} = r.{key} GROUP BY 1, 2),
{name}m AS (SELECT {key}, sum(u1*u1) AS m1, sum(u1*u2) AS m12, sum(u2*u2) AS m2, count(*) AS gc FROM {name}u GROUP BY 1),
{name}s AS (SELECT b.*, gc, (gc / (gc - 1.0)) * ((n - 1.0) / (n - {params})) AS cf, yy - b1*p - b2*q AS rss, m1, m12, m2 FROM {name}b b JOIN {name}m USING ({key})),
{name} AS (SELECT {key}, 'csem' AS predictor, b1 AS beta, sqrt(cf * (i1*i1*m1 + 2*i1*i12*m12 + i12*i12*m2)) AS se, sqrt(rss / (n - {params}) * i1) AS cse, n, gc, 1 - rss / tss AS r2 FROM {name}s
  UNION ALL SELECT {key}, '{second}', b2, sqrt(cf * (i12*i12*m1 + 2*i12*i2*m12 + i2*i2*m2)), sqrt(rss / (n - {params}) * i2), n, gc, 1 - rss / tss FROM {name}s)"""


_X2 = ["csem", "cprompt"]
_OUT = f"predictor, {R('beta')} AS beta, {R('se')} AS stderr, {R('cse')} AS classical_stderr, {R('beta / se')} AS t_stat, CAST(n AS BIGINT) AS n, CAST(gc AS BIGINT) AS n_clusters, {R('r2')} AS r_squared"
_POOLED = "rw AS (SELECT 'all' AS key, item_id AS cl, csem - avg(csem) OVER () AS x1, cprompt - avg(cprompt) OVER () AS x2, loglik_drift - avg(loglik_drift) OVER () AS y FROM tr)"


def coef(df, *keys):
    out = df.where("predictor <> 'intercept'").select(*keys, "predictor", "beta", "stderr", "classical_stderr", "t_stat", "n", "n_clusters", "r_squared")
    return rounded(out, "beta", "stderr", "classical_stderr", "t_stat", "r_squared")


@query("t13_multivariate_ols", f"{b.T()}, {_POOLED}, {OLS2('rw', 3)} SELECT predictor, {R('beta')} AS beta, {R('cse')} AS classical_stderr, {R('beta / cse')} AS classical_t, {R('r2')} AS r_squared, CAST(n AS BIGINT) AS n FROM o")
def t13(spark, sf):
    f = rg.fit(outcomes(spark, sf), _X2, "loglik_drift", "item_id").where("predictor <> 'intercept'")
    return rounded(f.select("predictor", "beta", "classical_stderr", "classical_t", "r_squared", "n"), "beta", "classical_stderr", "classical_t", "r_squared")


@query("t14_cluster_robust", f"{b.T()}, {_POOLED}, {OLS2('rw', 3)} SELECT {_OUT} FROM o")
def t14(spark, sf):
    return coef(rg.fit(outcomes(spark, sf), _X2, "loglik_drift", "item_id"))


_WITHIN = """rw AS (SELECT 'all' AS key, item_id AS cl, csem - avg(csem) OVER w AS x1, cprompt - avg(cprompt) OVER w AS x2, loglik_drift - avg(loglik_drift) OVER w AS y FROM tr
  WINDOW w AS (PARTITION BY item_id) QUALIFY count(*) OVER w >= 2)"""


@query("t15_within_group_fit", f"{b.T()}, {_WITHIN}, {OLS2('rw', 2)} SELECT {_OUT} FROM o")
def t15(spark, sf):
    return coef(rg.fit(outcomes(spark, sf), _X2, "loglik_drift", "item_id", within=True))


_FE = """rw AS (SELECT 'all' AS key, item_id AS cl, csem - avg(csem) OVER w AS x1, cprompt - avg(cprompt) OVER w AS x2, volatility - avg(volatility) OVER w AS y, volatility AS ry FROM tr WINDOW w AS (PARTITION BY perturbation))"""
_NPERT = "(2 + (SELECT count(DISTINCT perturbation) FROM tr))"


@query("t16_dummy_fixed_effects", f"{b.T()}, {_FE}, {OLS2('rw', _NPERT, tss='var_pop(ry) * count(*)')} SELECT {_OUT} FROM o")
def t16(spark, sf):
    return coef(rg.long_format_fit(outcomes(spark, sf), _X2, "volatility", "item_id", "perturbation", ["fe"]))


@query("t17_vif", f"""{b.T()}, r AS (SELECT level_no, count(*) AS n, corr(csem, cprompt) AS a, corr(csem, volatility) AS b, corr(cprompt, volatility) AS c FROM tr GROUP BY 1), d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT level_no, p AS predictor, CAST(n AS BIGINT) AS n, {R("CASE p WHEN 'csem' THEN (1 - c * c) / det WHEN 'cprompt' THEN (1 - b * b) / det ELSE (1 - a * a) / det END")} AS vif, {R('a')} AS first_pair_r, {RP('d.a', 'd.n')} AS first_pair_p, {R("CASE p WHEN 'csem' THEN 100 * (1 - det / (1 - c * c)) WHEN 'cprompt' THEN 100 * (1 - det / (1 - b * b)) ELSE 100 * (1 - det / (1 - a * a)) END")} AS collinearity_pct FROM d, (VALUES ('csem'), ('cprompt'), ('volatility')) v(p)""")
def t17(spark, sf):
    v = rg.vif(outcomes(spark, sf), ["level_no"], ["csem", "cprompt", "volatility"])
    v = v.withColumn("first_pair_p", p4(pv.corr_pvalue("first_pair_r", "n"))).withColumn("collinearity_pct", 100 * (1 - 1 / F.col("vif")))
    return rounded(v, "vif", "first_pair_r", "collinearity_pct")


_PRED = ("csem", "cprompt", "hopt")


_MARGINAL = f"""c AS (SELECT predictor, count(*) AS n, {CORR('x', 'y')} AS r FROM p GROUP BY 1), k AS (SELECT predictor, {RK('x', 'predictor')} AS a, {RK('y', 'predictor')} AS b FROM p), sp AS (SELECT predictor, {CORR('a', 'b')} AS rho FROM k GROUP BY 1),
m AS MATERIALIZED (SELECT predictor, level_no, round(avg(x), 9) AS mx, round(avg(y), 9) AS my FROM p GROUP BY 1, 2), t1 AS {TAU('m', 'predictor', 'level_no', 'my')}, t2 AS {TAU('m', 'predictor', 'level_no', 'mx')}, t3 AS {TAU('m', 'predictor', 'mx', 'my')}
SELECT c.predictor, CAST(n AS BIGINT) AS n, {R('r')} AS pearson_r, {R(_CI9.format(s='-'))} AS ci_lower, {R(_CI9.format(s='+'))} AS ci_upper, {R('rho')} AS spearman_rho,
  {R('CASE WHEN t1.tx * t1.ty > 0 THEN t1.s / sqrt(t1.tx * t1.ty) ELSE 0 END')} AS tau_level_target, {R('CASE WHEN t2.tx * t2.ty > 0 THEN t2.s / sqrt(t2.tx * t2.ty) ELSE 0 END')} AS tau_level_predictor, {R('CASE WHEN t3.tx * t3.ty > 0 THEN t3.s / sqrt(t3.tx * t3.ty) ELSE 0 END')} AS tau_predictor_target
FROM c JOIN sp USING (predictor) JOIN t1 USING (predictor) JOIN t2 USING (predictor) JOIN t3 USING (predictor)"""


def points(predictors, cond):
    return "p AS (" + " UNION ALL ".join(f"SELECT '{p}' AS predictor, level_no, {p} AS x, volatility AS y FROM tr WHERE {cond}" for p in predictors) + ")"


@query("t18_marginal_relationships", f"{b.T()}, {points(_PRED, 'level_no <= 4')}, {_MARGINAL}")
def t18(spark, sf):
    out = st.marginal_relationships(outcomes(spark, sf).where("level_no <= 4"), _PRED, "volatility")
    return rounded(out, *[x for x in out.columns if x not in ("predictor", "n")])


@query("t19_primary_view", f"{b.T()}, {points(('csem', 'hopt'), 'level_no <= 4')}, {_MARGINAL}")
def t19p(spark, sf):
    out = rg.horse_race_view(outcomes(spark, sf), "primary", ["csem", "hopt"], "volatility", "item_id")
    return rounded(out, *[x for x in out.columns if x not in ("predictor", "n")])


_VW = """vw AS (SELECT v.view AS key, tr.* FROM tr JOIN (VALUES ('wordy', 5, 8), ('pooled', 1, 8)) v(view, lo, hi) ON level_no BETWEEN lo AND hi),
rw AS (SELECT key, item_id AS cl, csem - avg(csem) OVER w AS x1, hopt - avg(hopt) OVER w AS x2, volatility - avg(volatility) OVER w AS y FROM vw WINDOW w AS (PARTITION BY key)),
ri AS (SELECT key, item_id AS cl, csem - avg(csem) OVER w AS x1, hopt - avg(hopt) OVER w AS x2, volatility - avg(volatility) OVER w AS y FROM vw WINDOW w AS (PARTITION BY key, item_id) QUALIFY count(*) OVER w >= 2)"""


@query("t19_horse_race_views", f"{b.T()}, {_VW}, {OLS2('rw', 3, second='hopt')}, {OLS2('ri', 2, name='w', second='hopt')} SELECT key AS view, 'pooled' AS fit, {_OUT} FROM o UNION ALL SELECT key, 'within_item', {_OUT} FROM w")
def t19(spark, sf):
    v = tr.level_views(outcomes(spark, sf)).where("view <> 'primary'")
    pooled = coef(rg.fit(v, ["csem", "hopt"], "volatility", "item_id", ["view"]), "view").withColumn("fit", F.lit("pooled"))
    within = coef(rg.fit(v, ["csem", "hopt"], "volatility", "item_id", ["view"], within=True), "view").withColumn("fit", F.lit("within_item"))
    return pooled.unionByName(within)


@query("t20_long_format_fit", f"""{b.T()}, {_FE}, pl AS (SELECT 'all' AS key, item_id AS cl, csem - avg(csem) OVER () AS x1, cprompt - avg(cprompt) OVER () AS x2, volatility - avg(volatility) OVER () AS y FROM tr),
{OLS2('rw', _NPERT, tss='var_pop(ry) * count(*)')}, {OLS2('pl', 3, name='n')} SELECT 'fe' AS model, {_OUT} FROM o UNION ALL SELECT 'no_fe', {_OUT} FROM n""")
def t20(spark, sf):
    return coef(rg.long_format_fit(outcomes(spark, sf), _X2, "volatility", "item_id", "perturbation"), "model")


_BYP = "rw AS (SELECT perturbation AS key, item_id AS cl, csem - avg(csem) OVER w AS x1, cprompt - avg(cprompt) OVER w AS x2, volatility - avg(volatility) OVER w AS y FROM tr WINDOW w AS (PARTITION BY perturbation) QUALIFY count(*) OVER w >= 50)"


@query("t21_per_perturbation_fits", f"{b.T()}, {_BYP}, {OLS2('rw', 3)} SELECT key AS perturbation, {_OUT} FROM o")
def t21(spark, sf):
    return coef(rg.fit_by_key(outcomes(spark, sf), _X2, "volatility", "item_id", "perturbation", 50), "perturbation")


@query("t21_sign_stability", f"""{b.T()}, {_BYP}, {OLS2('rw', 3)} SELECT predictor, CAST(count(*) AS BIGINT) AS n_fits, {R('avg((beta > 0)::INT)')} AS fraction_positive, {R('avg((beta < 0)::INT)')} AS fraction_negative, {R('avg(beta)')} AS mean_beta, {R('quantile_cont(beta, 0.5)')} AS median_beta, {R('stddev_pop(beta)')} AS std_beta FROM o GROUP BY predictor""")
def t21s(spark, sf):
    s = rg.sign_stability(rg.fit_by_key(outcomes(spark, sf), _X2, "volatility", "item_id", "perturbation", 50))
    return rounded(s, "fraction_positive", "fraction_negative", "mean_beta", "median_beta", "std_beta")


_DF = "dfm AS (SELECT *, CASE WHEN family = 'AF' THEN 'zero' WHEN list_sum(d) <= 1e-6 THEN 'zero' WHEN list_sum(list_transform(range(1, 9), lambda i: (i - 1) * d[i])) / list_sum(d) < 8 / 3e0 THEN 'low_freq' WHEN list_sum(list_transform(range(1, 9), lambda i: (i - 1) * d[i])) / list_sum(d) > 16 / 3e0 THEN 'high_freq' ELSE 'broadband' END AS fam FROM pairs)"
_BYF = "rw AS (SELECT fam AS key, item_id AS cl, csem - avg(csem) OVER w AS x1, cprompt - avg(cprompt) OVER w AS x2, volatility - avg(volatility) OVER w AS y FROM dfm WINDOW w AS (PARTITION BY fam) QUALIFY count(*) OVER w >= 30)"


@query("t22_delta_family_fits", f"""{b.PAIRS()}, {_DF}, {_BYF}, {OLS2('rw', 3)}, ct AS (SELECT fam, count(*) AS k FROM dfm GROUP BY 1)
SELECT ct.fam AS delta_family, CAST(k AS BIGINT) AS n_rows, o.predictor IS NULL AS skipped, o.predictor, {R('beta')} AS beta, {R('se')} AS stderr FROM ct LEFT JOIN o ON o.key = ct.fam""")
def t22(spark, sf):
    from ..functions.arrays import delta_family
    p = tr.with_outcomes(b.trials(spark, sf, "d")).withColumn("delta_family", F.when(F.col("family") == "AF", "zero").otherwise(delta_family("d")))
    f = rg.fit_by_key(p, _X2, "volatility", "item_id", "delta_family", 30).where("predictor IS NULL OR predictor <> 'intercept'")
    return rounded(f.select("delta_family", "n_rows", "skipped", "predictor", "beta", "stderr"), "beta", "stderr")


_ZB = """zb AS (SELECT *, ln(1 + greatest(predicted, 0)) AS pl FROM g), zz AS (SELECT *, (pl - avg(pl) OVER ()) / stddev_pop(pl) OVER () AS pz, (volatility - avg(volatility) OVER ()) / stddev_pop(volatility) OVER () AS az FROM zb)"""


@query("t23_standardized_bridge", f"{_GP}, {_ZB} SELECT item_id, level_no, family, {R('pl')} AS pred_log, {R('pz')} AS pred_z, {R('az')} AS actual_z FROM zz")
def t23(spark, sf):
    z = st.standardized_bridge(grouped(spark, sf), "predicted", "volatility")
    return rounded(z.select("item_id", "level_no", "family", "pred_log", "pred_z", "actual_z"), "pred_log", "pred_z", "actual_z")


@query("t24_prediction_error", f"{_GP}, f AS (SELECT regr_slope(volatility, predicted) AS b, regr_intercept(volatility, predicted) AS a FROM g) SELECT item_id, level_no, family, {R('a + b * predicted')} AS calibrated, {R('volatility - a - b * predicted')} AS residual, {R('abs(volatility - a - b * predicted)')} AS abs_error FROM g, f")
def t24(spark, sf):
    e = st.prediction_error(grouped(spark, sf), "predicted", "volatility")
    return rounded(e.select("item_id", "level_no", "family", "calibrated", "residual", "abs_error"), "calibrated", "residual", "abs_error")


@query("t25_prediction_factor_fit", None)
def t25(spark, sf):
    f = rg.prediction_fit(grouped_by_item(spark, sf), "predicted", ["csem", "cprompt", "hopt"], "volatility", "item_id")
    return rounded(f.select("view", "predictor", "beta", "standardized_beta", "stderr", "p_value", "r_squared", "n"), "beta", "standardized_beta", "stderr", "p_value", "r_squared")


_TG = ("volatility", "erosion", "accuracy_drop")


_VIEWS = ", ".join(["('primary', 1, 4)", "('wordy', 5, 8)", "('pooled', 1, 8)"] + [f"('level_{i}', {i}, {i})" for i in range(1, 9)])
_GRAINS = " UNION ALL ".join(f"SELECT '{grain}' AS grain, '{t}' AS target, level_no, round(predicted, 9) AS predicted, round({t}, 9) AS y FROM {src}" for grain, src in (("grouped", "g"), ("sample", "pairs")) for t in _TG)


@query("t26_overlap_law", f"""{_GP}, l AS ({_GRAINS}), w AS (SELECT l.*, v.view FROM l JOIN (VALUES {_VIEWS}) v(view, lo, hi) ON level_no BETWEEN lo AND hi),
k AS (SELECT grain, target, view, predicted, y, {RK('predicted', 'grain, target, view')} AS a, {RK('y', 'grain, target, view')} AS b FROM w),
q AS (SELECT grain, target, view, count(*) AS n, {CORR('predicted', 'y')} AS r, {CORR('a', 'b')} AS rho FROM k GROUP BY 1, 2, 3)
SELECT grain, target, view, CAST(n AS BIGINT) AS n, {R('r')} AS r, {R(f"CASE WHEN n <= 3 THEN r ELSE {_CI9.format(s='-')} END")} AS ci_lower, {R(f"CASE WHEN n <= 3 THEN r ELSE {_CI9.format(s='+')} END")} AS ci_upper, {RP('q.r', 'q.n')} AS p_value,
  {R('rho')} AS rho, r > CASE grain WHEN 'sample' THEN 0.3 ELSE 0.7 END AND n >= 30 AS passed, rho > 0.8 AS strong_rho, rho > 0.6 AS secondary_rho FROM q""")
def t26(spark, sf):
    # trials with equal values are folded before they are rounded and unpivoted, and both grains fold to value cells before anything reads them again
    p = b.pairs(spark, sf).groupBy("level_no", "predicted", *_TG).agg(F.count("*").alias("k"))
    g = grouped(spark, sf).withColumn("k", F.lit(1).cast("long"))
    w = [x.select(F.lit(lab).alias("grain"), "level_no", "k", *[F.round(c, 9).alias(c) for c in ("predicted", *_TG)]) for lab, x in (("grouped", g), ("sample", p))]
    w = tr.unpivot_targets(w[0].unionByName(w[1]), list(_TG))
    cells = materialize(spark, w.groupBy("grain", "target", "level_no", "predicted", "value").agg(F.sum("k").alias("k")), "cells")
    out = st.view_correlations(cells, ["grain", "target"], "predicted", "value", "level_no", "k", {"primary": tr.PRIMARY_LEVELS, "wordy": tr.WORDY_LEVELS})
    lo, hi = st.fisher_ci(F.col("r"), F.col("n"))
    out = out.withColumns({"ci_lower": lo, "ci_upper": hi, "p_value": p4(pv.corr_pvalue("r", "n")), "strong_rho": F.col("rho") > 0.8, "secondary_rho": F.col("rho") > 0.6,
                                         "passed": (F.col("r") > F.when(F.col("grain") == "sample", 0.3).otherwise(0.7)) & (F.col("n") >= 30)})
    return rounded(out, "r", "rho", "ci_lower", "ci_upper")


@query("t27_variant_correlations", f"""{_GP}, v AS (SELECT agg_level, variant, round(x, 9) AS x, round(y, 9) AS y FROM (SELECT 'grouped' AS agg_level, 'first_order' AS variant, predicted AS x, volatility AS y FROM g UNION ALL SELECT 'grouped', 'quadratic', predicted_quadratic, volatility FROM g UNION ALL SELECT 'sample', 'first_order', predicted, volatility FROM pairs UNION ALL SELECT 'sample', 'quadratic', predicted_quadratic, volatility FROM pairs)),
k AS (SELECT *, {RK('x', 'agg_level, variant')} AS a, {RK('y', 'agg_level, variant')} AS b FROM v), q AS (SELECT agg_level, variant, count(*) AS n, {CORR('x', 'y', 3, 'NULL')} AS r, {CORR('a', 'b', 3, 'NULL')} AS rho FROM k GROUP BY 1, 2)
SELECT agg_level, variant, CAST(n AS BIGINT) AS n, {R('r')} AS r, {RP('q.r', 'q.n')} AS p_value, {R('rho')} AS rho, {RP('q.rho', 'q.n', 3)} AS rho_p FROM q""")
def t27(spark, sf):
    def long(df, lab):
        z = F.explode(F.array(F.struct(F.lit("first_order").alias("variant"), F.round("predicted", 9).alias("x")),
                              F.struct(F.lit("quadratic").alias("variant"), F.round("predicted_quadratic", 9).alias("x"))))
        return df.select(F.lit(lab).alias("agg_level"), F.round("volatility", 9).alias("y"), z.alias("z")).select("agg_level", "y", "z.*")
    v = long(grouped(spark, sf), "grouped").unionByName(long(b.pairs(spark, sf), "sample"))
    v = materialize(spark, v.groupBy("agg_level", "variant", "x", "y").agg(F.count("*").alias("k")), "cells")
    keys = ["agg_level", "variant"]
    out = st.pearson(v, keys, "x", "y", 3, None, "k").join(st.spearman(v, keys, "x", "y", 3, None, "k").drop("n"), keys)
    out = out.withColumn("p_value", p4(pv.corr_pvalue("r", "n"))).withColumn("rho_p", F.round(pv.corr_pvalue("rho", "n"), 3) + 0.0)
    return rounded(out, "r", "rho")


@query("t23_bridge_summary", f"""{_GP}, {_ZB}, y AS (SELECT round(pz, 9) AS x, round(az, 9) AS y FROM zz), k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM y),
q AS (SELECT count(*) AS n, {SLOPE('x', 'y')} AS slope, {CORR('x', 'y')} AS r, {CORR('a', 'b')} AS rho FROM k)
SELECT CAST(n AS BIGINT) AS n, {R('slope')} AS slope, {R('r')} AS r, {RP('q.r', 'q.n')} AS p_value, {R('rho')} AS rho FROM q""")
def t23s(spark, sf):
    z = st.standardized_bridge(grouped(spark, sf), "predicted", "volatility").select(F.round("pred_z", 9).alias("x"), F.round("actual_z", 9).alias("y"))
    z = materialize(spark, z.groupBy("x", "y").agg(F.count("*").alias("k")), "cells")
    rho = st.spearman(z, [], "x", "y", weight="k").select("rho").scalar()
    out = st.pearson(z, [], "x", "y", weight="k").withColumn("p_value", p4(pv.corr_pvalue("r", "n"))).withColumn("rho", rho)
    line = z.agg((F.sum(F.col("k") * F.col("x") * F.col("y")) / F.sum(F.col("k") * F.col("x") * F.col("x"))).alias("b")).select("b").scalar()   # both sides are centred
    return rounded(out.withColumn("slope", line), "slope", "r", "rho")


_MU = f"""mu AS (SELECT item_id, perturbation, severity, count(*) AS n, var_pop(predicted) * count(*) AS sxx, var_pop(volatility) * count(*) AS syy, covar_pop(predicted, volatility) * count(*) AS sxy, {CORR('predicted', 'volatility', 3, 'NULL')} AS r
  FROM pairs GROUP BY 1, 2, 3 HAVING count(DISTINCT level_no) >= 2)"""


def matched(spark, sf):
    return st.unit_sums(b.pairs(spark, sf), ["item_id", "perturbation", "severity"], "predicted", "volatility")


@query("t28_matched_fixed_effects", f"""{b.PAIRS()}, {_MU} SELECT CAST(count(*) AS BIGINT) AS n_units, CAST(sum(n) AS BIGINT) AS n_rows, {R('sum(sxy) / sqrt(sum(sxx) * sum(syy))')} AS fe_r, {R('sum(sxy) / sum(sxx)')} AS fe_slope, {R('sum(sxy) / sqrt(sum(sxx) * sum(syy))')} AS fe_std_beta,
  CAST(count(r) AS BIGINT) AS within_n, {R('avg(r)')} AS within_mean, {R('avg((r > 0)::INT)')} AS within_positive_rate, {R('quantile_cont(r, 0.5)')} AS within_median FROM mu""")
def t28(spark, sf):
    u = materialize(spark, matched(spark, sf), "units")   # read by the sums and by the median
    s = st.fixed_effects_summary(u)
    med = wn.exact_quantiles(u.select("r"), "r", [0.5]).select("q0").scalar()
    return rounded(s.withColumn("within_median", med), "fe_r", "fe_slope", "fe_std_beta", "within_mean", "within_positive_rate", "within_median")


@query("t29_cluster_bootstrap", f"""{b.PAIRS()}, {_MU}, {BOOT('mu', ['item_id', 'perturbation', 'severity'], ['sxx', 'syy', 'sxy'], [])}
SELECT {R('quantile_cont(sxy / sqrt(sxx * syy), 0.025)')} AS fe_r_low, {R('quantile_cont(sxy / sqrt(sxx * syy), 0.975)')} AS fe_r_high, {R('quantile_cont(sxy / sxx, 0.025)')} AS fe_slope_low, {R('quantile_cont(sxy / sxx, 0.975)')} AS fe_slope_high FROM bd""")
def t29(spark, sf):
    d = st.bootstrap_sums(matched(spark, sf), [], ["item_id", "perturbation", "severity"], ["sxx", "syy", "sxy"], _B, _SEED)
    d = d.select((F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("r"), (F.col("sxy") / F.col("sxx")).alias("b"))
    q = F.array(F.lit(0.025), F.lit(0.975))
    g = d.agg(F.percentile("r", q).alias("r"), F.percentile("b", q).alias("b"))
    return g.select(*[r6(F.col(c)[i]).alias(f"{n}_{e}") for c, n in (("r", "fe_r"), ("b", "fe_slope")) for i, e in enumerate(("low", "high"))])


@query("t30_tug_of_war_refit", f"""{b.T()}, c AS (SELECT item_id, level_no, avg(csem) AS csem, avg(cprompt) AS cprompt, avg(volatility) AS vol FROM tr GROUP BY 1, 2),
z AS (SELECT item_id, (csem - avg(csem) OVER ()) / stddev_pop(csem) OVER () AS cs, (cprompt - avg(cprompt) OVER ()) / stddev_pop(cprompt) OVER () AS cp, (vol - avg(vol) OVER ()) / stddev_pop(vol) OVER () AS v FROM c),
b1 AS (SELECT sum(cs * cp) / sum(cp * cp) AS b FROM z), r AS (SELECT item_id, cs - b * cp AS cr, cp, v FROM z, b1),
rw AS (SELECT 'all' AS key, item_id AS cl, cr - avg(cr) OVER w AS x1, cp - avg(cp) OVER w AS x2, v - avg(v) OVER w AS y FROM r WINDOW w AS (PARTITION BY item_id)), {OLS2('rw', 2)}
SELECT predictor, {R('beta')} AS beta, {R('r2')} AS r_squared FROM o""")
def t30(spark, sf):
    c = outcomes(spark, sf).groupBy("item_id", "level_no").agg(F.avg("csem").alias("csem"), F.avg("cprompt").alias("cprompt"), F.avg("volatility").alias("vol"))
    names = ("csem", "cprompt", "vol")
    row = c.agg(*[F.avg(x).alias(f"m_{x}") for x in names], *[F.stddev_pop(x).alias(f"s_{x}") for x in names])
    zc = st.with_scalars(c, row)
    zc = zc.select("item_id", *[st.z(F.col(x), F.col(f"_st.m_{x}"), F.col(f"_st.s_{x}")).alias(x) for x in names])
    part = zc.agg((F.sum(F.col("csem") * F.col("cprompt")) / F.sum(F.col("cprompt") * F.col("cprompt"))).alias("b")).select("b").scalar()
    res = zc.withColumn("_b", part).withColumn("csem", F.col("csem") - F.col("_b") * F.col("cprompt")).drop("_b")
    f = rg.fit(res, ["csem", "cprompt"], "vol", "item_id", within=True)
    return rounded(f.select("predictor", "beta", "r_squared"), "beta", "r_squared")


@query("t31_frequency_specificity", f"""WITH {b.METRIC_SQL}, g AS (SELECT model, count(*) FILTER (WHERE h) AS na, count(*) FILTER (WHERE NOT h) AS nb, avg(value) FILTER (WHERE h) AS ma, avg(value) FILTER (WHERE NOT h) AS mb, var_samp(value) FILTER (WHERE h) AS va, var_samp(value) FILTER (WHERE NOT h) AS vb
  FROM (SELECT *, perturb = '5-LOW' AS h FROM obs WHERE perturb IN ('5-LOW', '2-HIGH')) GROUP BY model), s AS (SELECT *, ((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) AS sp FROM g),
q AS (SELECT *, (ma - mb) / sqrt(sp * (1.0 / na + 1.0 / nb)) AS t, CAST(na + nb - 2 AS DOUBLE) AS dof FROM s)
SELECT model, CAST(na AS BIGINT) AS n_a, CAST(nb AS BIGINT) AS n_b, {R('ma')} AS m_a, {R('mb')} AS m_b, {R('ma - mb')} AS difference, {R('t')} AS t_stat, {R('(ma - mb) / sqrt(sp)')} AS cohens_d, dof, {TP('q.t', 'q.dof')} AS p_value FROM q""")
def t31(spark, sf):
    o = b.metric_obs(spark, sf).where("perturb IN ('5-LOW', '2-HIGH')").withColumn("high", F.col("perturb") == "5-LOW")
    out = st.two_sample(o, ["model"], "high", "value").withColumn("p_value", p4(pv.t_pvalue("t_stat", "dof")))
    return rounded(out, "m_a", "m_b", "difference", "t_stat", "cohens_d")


_FAM32 = "CASE WHEN x.perturb IN ('2-HIGH', '3-MEDIUM') THEN 'lowfreq' ELSE 'highfreq' END"


@query("t32_differential_sensitivity", f"""{_DROP}, p AS (SELECT {_FAM32} AS family, x.d AS a, y.d AS b FROM dr x JOIN dr y ON x.metric = y.metric AND x.perturb = y.perturb AND x.severity = y.severity WHERE x.model = 'F' AND y.model = 'O'),
q AS (SELECT coalesce(family, 'overall') AS family, count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(a - b) AS ef, stddev_samp(a - b) AS sd FROM p GROUP BY GROUPING SETS ((family), ())),
h AS (SELECT *, ef / (sd / sqrt(n)) AS t FROM q)
SELECT family, CAST(n AS BIGINT) AS n_pairs, {R('ma')} AS mean_x, {R('mb')} AS mean_y, {R('ef')} AS effect, {R('t')} AS t_stat, {R('ef / sd')} AS dz, {TP('h.t', 'h.n - 1')} AS p_value FROM h""")
def t32(spark, sf):
    d = jn.relative_to_base(metric_means(spark, sf))
    keys = ["metric", "perturb", "severity"]
    p = jn.shared_keys(d.where("model = 'F'").select(*keys, F.col("drop").alias("a")), d.where("model = 'O'").select(*keys, F.col("drop").alias("b")), keys)
    p = p.withColumn("family", F.when(F.col("perturb").isin("2-HIGH", "3-MEDIUM"), "lowfreq").otherwise("highfreq"))
    out = p.groupingSets([["family"], []], "family").agg(*st.paired_columns("a", "b")).withColumn("family", F.coalesce("family", F.lit("overall")))
    out = out.withColumn("p_value", p4(pv.t_pvalue("t_stat", "dof"))).drop("sem", "dof")
    return rounded(out, "mean_x", "mean_y", "effect", "t_stat", "dz")


@query("t33_alignment_correlation", f"""{_DROP}, j AS (SELECT a.model, a.mean AS x, p.d AS y FROM ms a JOIN dr p ON p.metric = 'iou' AND p.model = a.model AND p.perturb = a.perturb AND p.severity = a.severity WHERE a.metric = 'dice' AND a.severity > 0),
k AS (SELECT *, {RK('x', 'model')} AS rx, {RK('y', 'model')} AS ry FROM j) , q AS (SELECT model, count(*) AS n, CASE WHEN count(*) >= 10 THEN {CORR('x', 'y')} END AS r, CASE WHEN count(*) >= 10 THEN {CORR('rx', 'ry')} END AS rho FROM k GROUP BY model)
SELECT model, CAST(n AS BIGINT) AS n, {R('r')} AS pearson_r, {RP('q.r', 'q.n')} AS pearson_p, {R('rho')} AS spearman_r, {RP('q.rho', 'q.n')} AS spearman_p FROM q""")
def t33(spark, sf):
    ms = metric_means(spark, sf)
    keys = ["model", "perturb", "severity"]
    j = ms.where("metric = 'dice' AND severity > 0").select(*keys, F.col("mean").alias("x")).join(
        jn.relative_to_base(ms).where("metric = 'iou'").select(*keys, F.col("drop").alias("y")), keys)
    r = st.pearson(j, ["model"], "x", "y", 10, None).withColumnRenamed("r", "pearson_r")
    rho = st.spearman(j, ["model"], "x", "y", 10, None).select("model", F.col("rho").alias("spearman_r"))
    out = r.join(rho, "model").withColumn("pearson_p", p4(pv.corr_pvalue("pearson_r", "n"))).withColumn("spearman_p", p4(pv.corr_pvalue("spearman_r", "n")))
    return rounded(out, "pearson_r", "spearman_r")


@query("t34_drift_effect_sizes", f"""WITH {b.METRIC_SQL}, m AS (SELECT model, metric, perturb, severity, count(*) AS n, avg(value) AS m, coalesce(var_samp(value), 0) AS v FROM obs GROUP BY 1, 2, 3, 4),
e AS (SELECT x.*, (x.m - y.m) / sqrt(((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2)) AS d FROM m x JOIN m y ON x.model = y.model AND x.metric = y.metric AND y.perturb = 'Base' AND y.severity = 0 WHERE NOT (x.perturb = 'Base' AND x.severity = 0))
SELECT model, metric, perturb, severity, CAST(n AS BIGINT) AS count, {R('d')} AS effect, avg(d) OVER (PARTITION BY model, metric) > -1 AS nonlocal FROM e""")
def t34(spark, sf):
    m = b.metric_obs(spark, sf).groupBy("model", "metric", "perturb", "severity").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("v"))
    is_base = (F.col("perturb") == "Base") & (F.col("severity") == 0)
    base = m.where(is_base).select("model", "metric", F.col("n").alias("bn"), F.col("m").alias("bm"), F.col("v").alias("bv"))
    pooled = F.try_divide((F.col("n") - 1) * F.col("v") + (F.col("bn") - 1) * F.col("bv"), F.col("n") + F.col("bn") - 2)
    e = m.where(~is_base).join(base, ["model", "metric"]).withColumn("effect", F.when(pooled > 0, (F.col("m") - F.col("bm")) / F.sqrt(pooled)).otherwise(0.0))
    mean = e.groupBy("model", "metric").agg((F.avg("effect") > -1).alias("nonlocal"))
    return e.join(mean, ["model", "metric"]).select("model", "metric", "perturb", "severity", F.col("n").alias("count"), r6("effect").alias("effect"), "nonlocal")


_SHAPE = """sh AS (SELECT level_no, layer_group, bw, list_sum(list_sort(w, 'DESC')[1:2]) AS top2, list_sum(w[5:8]) AS tail FROM fl),
lm AS MATERIALIZED (SELECT layer_group, metric, level_no, round(avg(v), 9) AS v FROM (SELECT layer_group, level_no, 'bandwidth' AS metric, bw AS v FROM sh UNION ALL SELECT layer_group, level_no, 'top_2_mass', top2 FROM sh UNION ALL SELECT layer_group, level_no, 'tail_mass', tail FROM sh) GROUP BY 1, 2, 3)"""


def shape_means(spark, sf):
    from ..functions.arrays import bandwidth, tail_mass, top_k_mass
    f = layered_filters(spark, sf).withColumns({"bandwidth": bandwidth("radial"), "top_2_mass": top_k_mass("w", 2), "tail_mass": tail_mass("w")})
    z = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("bandwidth", "top_2_mass", "tail_mass")]))
    return f.select("layer_group", "level_no", z.alias("z")).select("layer_group", "level_no", "z.*").groupBy("layer_group", "metric", "level_no").agg(F.round(F.avg("v"), 9).alias("v"))


@query("t35_shape_ladder", f"""{_FL}, {_SHAPE}, k AS (SELECT layer_group, metric, {RK('level_no', 'layer_group, metric')} AS a, {RK('v', 'layer_group, metric')} AS b FROM lm WHERE level_no <= 4)
SELECT layer_group, metric, {R(CORR('a', 'b'))} AS rho FROM k GROUP BY 1, 2""")
def t35(spark, sf):
    lad = st.ladder(shape_means(spark, sf).where("level_no <= 4"), ["layer_group", "metric"], "level_no", "v")
    return lad.select("layer_group", "metric", r6(st.ladder_spearman(F.col("pts"), "ord", "v")).alias("rho"))


@query("t35_mirror_divergence", f"""{_FL}, {_SHAPE} SELECT metric, x.layer_group, {R('avg(abs(y.v - x.v))')} AS mean_abs_delta FROM lm x JOIN lm y USING (layer_group, metric) WHERE y.level_no = x.level_no + 4 GROUP BY 1, 2""")
def t35d(spark, sf):
    m = shape_means(spark, sf)
    rung = (F.col("level_no") - 1) % 4
    g = m.groupBy("layer_group", "metric", rung.alias("rung")).agg(F.max(F.when(F.col("level_no") <= 4, F.col("v"))).alias("b"), F.max(F.when(F.col("level_no") > 4, F.col("v"))).alias("w"))
    return g.where("b IS NOT NULL AND w IS NOT NULL").groupBy("metric", "layer_group").agg(r6(F.avg(F.abs(F.col("w") - F.col("b")))).alias("mean_abs_delta"))


# fixed values: gate thresholds by test; a minimum has to be passed, a maximum may be met
GATES = {"overlap_law_r": ("min", 0.7), "overlap_law_n": ("min", 29.0), "sample_r": ("min", 0.3), "monotone_tau": ("min", 0.6), "sign_stability": ("min", 0.6),
         "strong_rho": ("min", 0.8), "secondary_rho": ("min", 0.6), "dual_force_p": ("max", 0.05)}


@query("t36_gates_verdict", f"""{b.T()}, s AS (SELECT family, CAST(count(*) AS DOUBLE) AS overlap_law_n, {CORR('csem', 'volatility')} AS overlap_law_r, {CORR('cprompt', 'volatility')} AS sample_r, avg((loglik_drift > 0)::INT) AS sign_stability FROM tr GROUP BY 1),
k AS (SELECT family, {RK('csem', 'family')} AS a, {RK('cprompt', 'family')} AS c, {RK('volatility', 'family')} AS v FROM tr), rh AS (SELECT family, {CORR('a', 'v')} AS strong_rho, {CORR('c', 'v')} AS secondary_rho FROM k GROUP BY 1),
m AS MATERIALIZED (SELECT family, level_no, round(avg(volatility), 9) AS v FROM tr GROUP BY 1, 2), ta AS (SELECT family, CASE WHEN tx * ty > 0 THEN s / sqrt(tx * ty) ELSE 0e0 END AS monotone_tau FROM {TAU('m', 'family', 'level_no', 'v')} q),
w AS (SELECT * FROM s JOIN rh USING (family) JOIN ta USING (family)), x AS (SELECT *, {RP('w.overlap_law_r', 'w.overlap_law_n')} AS dual_force_p FROM w),
""" + "l AS (" + " UNION ALL ".join(f"SELECT family, coalesce({t} {'>' if d == 'min' else '<='} {v}, false) AS ok FROM x" for t, (d, v) in GATES.items()) + """)
SELECT family, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS n_passed, CAST(count(*) AS BIGINT) AS n_total, bool_and(ok) AS supported, (SELECT x.overlap_law_r < 0 AND x.dual_force_p <= 0.05 FROM x WHERE x.family = l.family) AS falsified FROM l GROUP BY family""")
def t36(spark, sf):
    t = outcomes(spark, sf)
    s = t.groupBy("family").agg(safe_corr("csem", "volatility").alias("overlap_law_r"), F.count("*").alias("overlap_law_n"), safe_corr("cprompt", "volatility").alias("sample_r"),
                                F.avg((F.col("loglik_drift") > 0).cast("double")).alias("sign_stability"))
    for name, x in (("strong_rho", "csem"), ("secondary_rho", "cprompt")):
        s = s.join(st.spearman(t, ["family"], x, "volatility").select("family", F.col("rho").alias(name)), "family")
    m = t.groupBy("family", "level_no").agg(F.round(F.avg("volatility"), 9).alias("v"))
    lad = st.ladder(m, ["family"], "level_no", "v")
    s = s.join(lad.select("family", st.kendall_tau(F.col("pts"), "ord", "v").alias("monotone_tau")), "family")
    s = s.withColumn("dual_force_p", p4(pv.corr_pvalue("overlap_law_r", "overlap_law_n")))
    tests = s.select("family", F.explode(F.array(*[F.struct(F.lit(t).alias("test"), F.col(t).cast("double").alias("value")) for t in GATES])).alias("z")).select("family", "z.*")
    th = F.explode(F.array(*[F.struct(F.lit(k).alias("test"), F.lit(d).alias("direction"), F.lit(v).alias("threshold")) for k, (d, v) in GATES.items()]))
    thresholds = spark.range(1).select(th.alias("z")).select("z.*")   # the fixed threshold dimension
    wrong = s.select("family", ((F.col("overlap_law_r") < 0) & (F.col("dual_force_p") <= 0.05)).alias("falsified"))
    return st.verdict(st.gates(tests, F.broadcast(thresholds)), "family").join(wrong, "family")


@query("t37_kde", f"""WITH s AS (SELECT model, count(*) AS n, stddev_pop(value) AS sd, min(value) AS lo, max(value) AS hi FROM (SELECT o_orderstatus AS model, o_totalprice / 100000 AS value FROM orders) GROUP BY 1),
v AS (SELECT o_orderstatus AS model, o_totalprice / 100000 AS value, count(*) AS k FROM orders GROUP BY 1, 2), w AS (SELECT *, 1.06 * sd * n ** (-0.2) AS bw FROM s)
SELECT model, CAST(i AS INT) AS i, {R('max(lo + (hi - lo) * i / 199)')} AS x, {R('sum(k * exp(-0.5 * ((lo + (hi - lo) * i / 199 - value) / bw) ** 2) / (bw * sqrt(2 * pi()) * n))')} AS density FROM v JOIN w USING (model), range(0, 200) g(i) GROUP BY 1, 2""")
def t37(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("model"), (F.col("o_totalprice") / 100000).alias("value"))
    return rounded(st.kde(o, ["model"], "value"), "x", "density")


@query("t38_histogram", """WITH s AS (SELECT o_orderstatus AS model, count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi, greatest(10, least(50, floor(sqrt(count(*))))) AS bins FROM orders GROUP BY 1)
SELECT model, CAST(bins AS BIGINT) AS bins, CAST(least(floor((o_totalprice - lo) / (hi - lo) * bins), bins - 1) AS INT) AS bin, CAST(count(*) AS BIGINT) AS k FROM orders JOIN s ON s.model = o_orderstatus GROUP BY 1, 2, 3""")
def t38(spark, sf):
    o = b.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("model"), F.col("o_totalprice").alias("value"))
    return st.histogram(o, ["model"], "value")


@query("t39_pca", None)
def t39(spark, sf):
    from ..operators.embeddings import pca_variance
    return rounded(pca_variance(b.table(spark, sf, "embeddings").withColumn("channel", F.col("label") % 2), "channel", "embedding", 2), "explained_variance", "explained_ratio")
