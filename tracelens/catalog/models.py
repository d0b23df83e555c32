"""Resampling, model and evaluation queries on labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.runs import mixed_tasks
from ..plans import evaluate as V
from ..plans import evidence as E
from ..plans import logit as M
from ..plans import resample as R
from ..session import materialize
from . import bind as B
from .registry import query
from .sequences import LONG_FEATURES
from .statistics import fisher, rho_sql, rnk, t_p, within

PERMUTATIONS, DRAWS = 10_000, 2_000


def preds(t):
    """Scores for the labelled documents: the share of common words."""
    return t.features.select("run_id", "task_id", "stratum", "success", F.col("f_common").alias("score"), F.least("f_parts", F.lit(0.99)).alias("other"))


B.CTES["preds"] = "SELECT run_id, task_id, stratum, success, f_common AS score, least(f_parts, 0.99) AS other FROM features"


def auc_sql(source: str, keys: str, score: str, label: str) -> str:
    cols = f"{keys}, " if keys else ""
    return f"""SELECT {cols}count(*) AS n, (sum(CASE WHEN {label} = 1 THEN r END) - sum({label}) * (sum({label}) + 1) / 2.0::DOUBLE) / nullif(sum({label}) * (count(*) - sum({label})), 0) AS auc
        FROM (SELECT *, {rnk(keys, score)} AS r FROM {source}) {'GROUP BY ' + keys if keys else ''}"""


def five_sql(source: str, x: str, out: str) -> str:
    """``source`` with the column ``out``: the fifth power of ``x`` modulo 2^31 - 1."""
    p = 2147483647
    return f"SELECT * EXCLUDE (x_, s_), s_ * s_ % {p} * x_ % {p} AS {out} FROM (SELECT *, x_ * x_ % {p} AS s_ FROM (SELECT *, ({x}) % {p} AS x_ FROM ({source})))"


def shuffled_sql(source: str, strata: str, reps: int, seed: int = 42) -> str:
    """The first n+ rows of each (replicate, stratum) in order of their draws get the positive label."""
    keys = f"SELECT g.rep::BIGINT AS rep FROM range(0, {reps}) g(rep)"
    for j in (1, 2, 3):
        keys = five_sql(keys, f"{seed * 1000003 + j * 131071 + 17} + rep * 8191", f"k{j}")
    units = f"SELECT *, ('0x' || substr(md5(run_id::VARCHAR), 1, 7))::BIGINT AS u1, ('0x' || substr(md5(run_id::VARCHAR), 8, 7))::BIGINT AS u2, sum(success) OVER (PARTITION BY {strata}) AS pos FROM {source}"
    drawn = five_sql(f"SELECT u.*, k.* FROM ({units}) u, ({keys}) k", "u1 + k1", "d1")
    drawn = five_sql(five_sql(drawn, "d1 * (k2 % 2147483646 + 1) + u2", "d2"), "d2 + k3", "h")
    return f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY rep, {strata} ORDER BY h, run_id) <= pos THEN 1 ELSE 0 END AS shuffled FROM ({drawn})"


def diff_sql(source: str, keys: str, strata: str, x: str, label: str) -> str:
    cols = f"{keys}, " if keys else ""
    return f"""SELECT {cols}sum(n * d) / sum(n) AS statistic FROM (SELECT {cols}{strata}, count(*) AS n,
        coalesce(avg(CASE WHEN {label} = 1 THEN {x} END) - avg(CASE WHEN {label} = 0 THEN {x} END), 0) AS d FROM {source} GROUP BY {cols}{strata}) {'GROUP BY ' + keys if keys else ''}"""


def perm_sql(strata: str, x: str) -> str:
    return f"""WITH usable AS (SELECT * FROM features WHERE {strata} IN (SELECT {strata} FROM features GROUP BY {strata} HAVING min(success) < max(success))),
    mixed AS ({shuffled_sql('usable', strata, PERMUTATIONS)}), nul AS ({diff_sql('mixed', 'rep', strata, x, 'shuffled')}), seen AS ({diff_sql('usable', '', strata, x, 'success')})
    SELECT s.statistic AS observed, count(*) AS permutations, (count(*) FILTER (WHERE abs(round(n.statistic, 12)) >= abs(round(s.statistic, 12))) + 1) / (count(*) + 1) AS p
    FROM nul n, seen s GROUP BY s.statistic"""


@query("b1_stratified_permutation", perm_sql("stratum", "f_common"), dbl="observed p", lng="permutations")
def _b1(t):
    return R.permutation_test(materialize(t.features), "stratum", "f_common", "success", "run_id", PERMUTATIONS)


@query("b2_within_task_permutation", perm_sql("task_id", "f_tokens"), dbl="observed p", lng="permutations")
def _b2(t):
    f = materialize(t.features)
    return R.permutation_test(f.join(mixed_tasks(f), "task_id", "left_semi"), "task_id", "f_tokens", "success", "run_id", PERMUTATIONS)


B.CTES["permuted"] = " UNION ALL ".join(f"SELECT '{f}' AS feature, p FROM ({perm_sql('stratum', f)})" for f in LONG_FEATURES)


@query("t17_evidence_tiers", """SELECT feature, w.p AS within_p, f.p_combined, q.p AS permutation_p, CASE WHEN h > 0 AND NOT same_sign AND h < 3 THEN 'retracted' WHEN h = 3 THEN 'gold' WHEN h = 2 THEN 'silver' WHEN h = 1 THEN 'moderate' ELSE 'null' END AS tier
    FROM (SELECT feature, min(p) AS p FROM within GROUP BY feature) w JOIN fisher f USING (feature) JOIN permuted q USING (feature),
    LATERAL (SELECT coalesce(CAST(w.p < 0.05 AS INT), 0) + coalesce(CAST(f.p_combined < 0.05 AS INT), 0) + coalesce(CAST(q.p < 0.05 AS INT), 0) AS h)""", dbl="within_p p_combined permutation_p")
def _t17(t):
    """Tiers from the within-stratum tests, their combination and the stratified permutation test."""
    parts = R.permutation_tests(materialize(t.features), "stratum", LONG_FEATURES, "success", "run_id", PERMUTATIONS).select("feature", F.col("p").alias("permutation_p"))
    rows = within(t).groupBy("feature").agg(F.min("p").alias("within_p")).join(fisher(t), "feature").join(parts, "feature")
    return rows.select("feature", "within_p", "p_combined", "permutation_p", E.tier(F.col("within_p"), F.col("p_combined"), F.col("permutation_p"), F.col("same_sign")).alias("tier"))


@query("b4_label_shuffle_auc", f"""WITH mixed AS ({shuffled_sql('preds', 'stratum', PERMUTATIONS)}), nul AS ({auc_sql('mixed', 'rep', 'score', 'shuffled')}), seen AS ({auc_sql('preds', '', 'score', 'success')})
    SELECT s.auc AS observed, count(*) AS permutations, avg(n.auc) AS mean_null, stddev_pop(n.auc) AS sd_null, avg(CASE WHEN round(n.auc, 12) >= round(s.auc, 12) THEN 1.0::DOUBLE ELSE 0 END) AS p
    FROM nul n, seen s WHERE n.auc IS NOT NULL GROUP BY s.auc""", dbl="observed mean_null sd_null p", lng="permutations")
def _b4(t):
    return R.shuffle_auc_test(materialize(preds(t)), "stratum", "score", "success", "run_id", PERMUTATIONS)


@query("b5_bootstrap_auc", f"""WITH placed AS (SELECT *, row_number() OVER (ORDER BY md5(run_id::VARCHAR), run_id) - 1 AS position, count(*) OVER () AS m FROM preds),
    drawn AS (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || position), 1, 8))::BIGINT % m AS position FROM placed, range(0, {DRAWS}) g(rep)),
    sample AS (SELECT d.rep, p.score, p.success FROM drawn d JOIN placed p USING (position)), a AS ({auc_sql('sample', 'rep', 'score', 'success')})
    SELECT count(auc) AS replicates, avg(auc) AS mean, stddev_samp(auc) AS se, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high FROM a""", dbl="mean se low high", lng="replicates")
def _b5(t):
    reps = R.bootstrap_auc(preds(t), "score", "success", "run_id", DRAWS)
    return R.bootstrap_interval(materialize(reps))


@query("m4_binary_metrics", "SELECT stratum, count(*) AS n, avg(CASE WHEN (score >= 0.5) = (success = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, avg((score - success) * (score - success)) AS brier, avg(success) AS base_rate FROM preds GROUP BY stratum",
       dbl="accuracy brier base_rate", lng="n")
def _m4(t):
    return V.binary_metrics(preds(t), ["stratum"], "score", "success")


@query("m5_auc", auc_sql("preds", "stratum", "score", "success"), dbl="auc", lng="n")
def _m5(t):
    return V.auc(preds(t), ["stratum"], "score", "success")


_REL = "SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS mean_score, avg(success) AS rate FROM preds GROUP BY 1"


@query("m6_reliability", _REL, dbl="mean_score rate", lng="bin n")
def _m6(t):
    return V.reliability(preds(t), "score", "success")


@query("m6_calibration_error", f"SELECT sum(n * abs(rate - mean_score)) / sum(n) AS ece FROM ({_REL})", dbl="ece")
def _m6b(t):
    return V.expected_calibration_error(preds(t), "score", "success")


GRID = [0.05, 0.1, 0.15, 0.2, 0.3, 0.5]


@query("m7_risk_coverage", f"""SELECT th AS threshold, count(*) FILTER (WHERE score >= th) / count(*) AS coverage, avg(1.0::DOUBLE - success) FILTER (WHERE score >= th) AS risk
    FROM preds, (SELECT unnest({GRID}::DOUBLE[]) AS th) GROUP BY th""", dbl="threshold coverage risk")
def _m7(t):
    return V.risk_coverage(preds(t), "score", "success", GRID)


_NORMAL = "1 - exp(-{z} * {z} / 2) * list_sum(list_transform(range(0, 120), lambda k: exp((2 * k + 1) * ln(greatest({z}, 1e-12) / sqrt(2)) - lgamma(k + 1.5::DOUBLE))))"


@query("m8_clustered_vuong", f"""WITH p AS (SELECT *, greatest(least(score, 0.98), 0.02) AS a, greatest(least(other, 0.98), 0.02) AS b FROM preds),
    c AS (SELECT task_id, avg(ln(CASE WHEN success = 1 THEN a ELSE 1 - a END) - ln(CASE WHEN success = 1 THEN b ELSE 1 - b END)) AS d FROM p GROUP BY task_id),
    s AS (SELECT count(*) AS clusters, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS vuong FROM c)
    SELECT clusters, vuong, {_NORMAL.format(z='least(abs(vuong), 8)')} AS p FROM s""", dbl="vuong p", lng="clusters")
def _m8(t):
    clip = lambda c: F.greatest(F.least(F.col(c), F.lit(0.98)), F.lit(0.02))
    return V.vuong(preds(t).withColumn("a", clip("score")).withColumn("b", clip("other")), [], "task_id", "a", "b", "success")


@query("m9_agreement_signal", """WITH l AS (SELECT *, CASE run_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'disagree' END AS level FROM preds)
    SELECT run_id, level, avg(success) OVER (PARTITION BY level) AS p_level FROM l""", dbl="p_level")
def _m9(t):
    level = F.element_at(F.array(F.lit("full"), F.lit("partial"), F.lit("disagree")), (F.pmod("run_id", F.lit(3)) + 1).cast("int"))
    return V.agreement_signal(t.runs.withColumn("level", level), "level", "success").select("run_id", "level", "p_level")


@query("m9_critic_quality", """WITH l AS (SELECT stratum, success, CASE run_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' ELSE 'disagree' END AS level FROM preds)
    SELECT stratum, count(*) FILTER (WHERE level = 'disagree' AND success = 0) / nullif(count(*) FILTER (WHERE level = 'disagree'), 0) AS critic_precision, count(*) FILTER (WHERE level <> 'disagree') / count(*) AS coverage,
    count(*) FILTER (WHERE level <> 'disagree' AND success = 0) / nullif(count(*) FILTER (WHERE level <> 'disagree'), 0) AS selective_risk FROM l GROUP BY stratum""", dbl="critic_precision coverage selective_risk")
def _m9b(t):
    level = F.element_at(F.array(F.lit("full"), F.lit("partial"), F.lit("disagree")), (F.pmod("run_id", F.lit(3)) + 1).cast("int"))
    return V.critic_quality(t.runs.withColumn("level", level), ["stratum"], "level", "success")


# -- models: SQL reaches the same maximum by a fixed number of steps with a bound of the Hessian ------------

FEATURES = ["f_tokens", "f_common", "f_commas", "f_parts"]
FOCAL = ["en", "fr"]  # strata in which features are selected


STEPS, POLISH = 200, 5


def _list(items) -> str:
    return "[" + ", ".join(items) + "]"


def gauss_sql(size: int, source: str, keys: str, name: str) -> str:
    """``name`` (keys, w): the inverse of the matrix m (rows of lists) of each row of ``source``, by elimination without row swaps."""
    unit = "m[i][c] - m[i][pv + 1] * m[pv + 1][c] / m[pv + 1][pv + 1]"
    return f"""{name}_e AS (SELECT {keys}, 0 AS pv, list_transform(range(1, {size + 1}), lambda i: list_concat(m[i], list_transform(range(1, {size + 1}), lambda c: CASE WHEN c = i THEN 1.0::DOUBLE ELSE 0 END))) AS m FROM {source}
        UNION ALL SELECT {keys}, pv + 1, list_transform(range(1, {size + 1}), lambda i: CASE WHEN i = pv + 1 THEN list_transform(m[i], lambda v: v / m[pv + 1][pv + 1]) ELSE list_transform(range(1, {2 * size + 1}), lambda c: {unit}) END) FROM {name}_e WHERE pv < {size}),
    {name} AS (SELECT {keys}, list_transform(range(1, {size + 1}), lambda i: m[i][{size + 1}:{2 * size}]) AS w FROM {name}_e WHERE pv = {size})"""


def fit_sql(size: int, penalty: float = 1.0, steps: int = STEPS) -> str:
    """CTEs ``fit`` (fold, b, ll, h, converged) from ``z`` (fold, y, and c1 = 1, c2 … standardised) and ``keep`` (fold, k: list of 0 and 1).

    Each step solves with Z'Z / 4 + penalty, which bounds every Hessian, so the likelihood never falls; a few Newton steps
    follow, which stay long where the maximum is at infinity.
    """
    ids = range(1, size + 1)
    eta = " + ".join(f"s.b[{i}] * z.c{i}" for i in ids)
    prob = f"1 / (1 + exp(-({eta})))"
    gram = _list(_list(f"sum(c{min(i, j)} * c{max(i, j)})" for j in ids) for i in ids)
    ridge = f"CASE WHEN i = 1 THEN 0 ELSE {penalty} END"
    grad = _list(f"s.k[{i}] * (sum((z.y - p) * z.c{i}) - {0 if i == 1 else penalty} * s.b[{i}])" for i in ids)
    hess = _list(_list(f"sum(p * (1 - p) * c{min(i, j)} * c{max(i, j)})" for j in ids) for i in ids)
    inner = f"SELECT z.*, s.b, s.n, s.k, s.w, {prob} AS p, {eta} AS eta FROM {{}} s JOIN z ON z.fold = s.fold"
    any_ = lambda x: x.replace("s.b", "any_value(b)").replace("s.k", "any_value(k)").replace("z.", "")
    newton, before = "", "last"
    for step in range(1, POLISH + 1):
        whole = _list(_list(f"any_value(k)[{i}] * any_value(k)[{j}] * (sum(p * (1 - p) * c{min(i, j)} * c{max(i, j)})" + (f" + {penalty}" if i == j > 1 else "") + ")" + (f" + 1 - any_value(k)[{i}]" if i == j else "") for j in ids) for i in ids)
        newton += f""",
    q{step} AS (SELECT fold, any_value(k) AS k, any_value(w) AS w0, any_value(n) AS n, any_value(b) AS b, {any_(grad)} AS g, {whole} AS m FROM ({inner.format(before)}) GROUP BY fold),
    {gauss_sql(size, f'q{step}', 'fold, k, w0, n, b, g', f'i{step}')},
    p{step} AS (SELECT fold, k, w0 AS w, n, list_transform(range(1, {size + 1}), lambda i: b[i] + list_dot_product(w[i], g)) AS b, list_max(list_transform(range(1, {size + 1}), lambda i: abs(list_dot_product(w[i], g)))) AS moved FROM i{step})"""
        before = f"p{step}"
    return f"""gram AS (SELECT fold, {gram} AS g FROM z GROUP BY fold),
    bound AS (SELECT fold, k, list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j: k[i] * k[j] * (g[i][j] / 4 + CASE WHEN i = j THEN {ridge} ELSE 0 END) + CASE WHEN i = j THEN 1 - k[i] ELSE 0 END)) AS m FROM gram JOIN keep USING (fold)),
    {gauss_sql(size, 'bound', 'fold, k', 'inv')},
    it AS (SELECT fold, k, w, 0 AS n, {_list(['0.0::DOUBLE'] * size)} AS b FROM inv
        UNION ALL SELECT fold, k, w, n + 1, list_transform(range(1, {size + 1}), lambda i: b[i] + list_dot_product(w[i], g)) FROM (
            SELECT fold, any_value(k) AS k, any_value(w) AS w, any_value(n) AS n, any_value(b) AS b, {any_(grad)} AS g
            FROM ({inner.format('it')} WHERE s.n < {steps}) GROUP BY fold)),
    last AS (SELECT * FROM it WHERE n = {steps}){newton},
    fit AS (SELECT fold, any_value(b) AS b, any_value(moved) < 1e-3 AS converged, sum(y * eta - ln(1 + exp(eta))) AS ll, {hess} AS h
        FROM ({inner.format(before).replace('SELECT z.*,', 'SELECT z.*, s.moved,')}) GROUP BY fold)"""


def scaled(by: str = "", source: str = "tr") -> str:
    """Columns y, c1 = 1 and the standardised features."""
    over = f"OVER ({by})"
    return "success AS y, 1.0::DOUBLE AS c1, " + ", ".join(
        f"({f} - avg({f}) {over}) / coalesce(nullif(stddev_pop({f}) {over}, 0), 1) AS c{i + 2}" for i, f in enumerate(FEATURES))


def held_out_sql(masks: str) -> str:
    """CTEs up to ``held_out`` (fold, run_id, y, score): every task left out, ``keep`` from ``masks``."""
    means = ", ".join(f"avg({f}) AS m{i + 2}, coalesce(nullif(stddev_pop({f}), 0), 1) AS d{i + 2}" for i, f in enumerate(FEATURES))
    return f"""folds AS (SELECT DISTINCT task_id AS fold FROM features), tr AS (SELECT fold, f.* FROM folds JOIN features f ON f.task_id <> fold),
    z AS (SELECT fold, {scaled('PARTITION BY fold')} FROM tr), scale AS (SELECT fold, min(success) < max(success) AS two_classes, {means} FROM tr GROUP BY fold),
    {masks}, {fit_sql(len(FEATURES) + 1)},
    held_out AS (SELECT f.run_id, f.task_id, f.success AS y, 1 / (1 + exp(-(b[1] + {' + '.join(f'b[{i + 2}] * ({c} - m{i + 2}) / d{i + 2}' for i, c in enumerate(FEATURES))}))) AS score
        FROM features f JOIN fit ON fit.fold = f.task_id JOIN scale ON scale.fold = f.task_id WHERE two_classes)"""


_ALL = f"keep AS (SELECT DISTINCT fold, {_list(['1'] * (len(FEATURES) + 1))} AS k FROM z)"


@query("m1_logistic_regression", f"""WITH RECURSIVE z AS (SELECT 0 AS fold, {scaled()} FROM features), {_ALL}, {fit_sql(len(FEATURES) + 1)}
    SELECT unnest({_list(f"'{n}'" for n in ['intercept', *FEATURES])}) AS term, unnest(b) AS coefficient, converged FROM fit""", dbl="coefficient")
def _m1(t):
    m = M.fit(materialize(t.features), FEATURES, "success")
    rows = [(name, float(b), m["converged"]) for name, b in zip(["intercept", *FEATURES], m["beta"])]
    return t.spark.createDataFrame(rows, "term string, coefficient double, converged boolean")


@query("m2_leave_task_out", f"WITH RECURSIVE {held_out_sql(_ALL)} SELECT run_id, task_id, CAST(y AS INTEGER) AS y, score FROM held_out", dbl="score")
def _m2(t):
    p, _ = M.cross_validate(t.features.select("run_id", "task_id", "success", *FEATURES), FEATURES, ["success"], "task_id")
    return p.select("run_id", "task_id", "y", "score")


_PICK = f"""sel_long AS (SELECT fold, model, success, unnest({_list(f"'{f}'" for f in FEATURES)}) AS feature, unnest({_list(FEATURES)}) AS x FROM tr WHERE model IN ({', '.join(f"'{m}'" for m in FOCAL)})),
    sel_rho AS ({rho_sql('sel_long', 'fold, model, feature', floor=5)}), sel AS (SELECT DISTINCT fold, feature FROM (SELECT *, {t_p('rho', 'n')} AS p FROM sel_rho) WHERE abs(rho) > 0.15 AND p < 0.10),
    picked AS (SELECT fold, coalesce(list(feature) FILTER (WHERE feature IS NOT NULL), []) AS fs FROM folds LEFT JOIN sel USING (fold) GROUP BY fold),
    keep AS (SELECT fold, list_concat([1], list_transform({_list(f"'{f}'" for f in FEATURES)}, lambda f: CASE WHEN len(fs) = 0 OR list_contains(fs, f) THEN 1 ELSE 0 END)) AS k FROM picked)"""


@query("m3_nested_selection_cv", f"""WITH RECURSIVE {held_out_sql(_PICK)}, m AS (SELECT avg(CASE WHEN (score >= 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy, avg((score - y) * (score - y)) AS brier FROM held_out),
    stable AS (SELECT unnest({_list(f"'{f}'" for f in FEATURES)}) AS feature, unnest({_list(f'avg(k[{i + 2}])' for i in range(len(FEATURES)))}) AS stability FROM keep)
    SELECT feature, stability, n, auc, accuracy, brier FROM stable, m, ({auc_sql('held_out', '', 'score', 'y')})""", dbl="stability auc accuracy brier", lng="n")
def _m3(t):
    rows = t.features.select("run_id", "task_id", "model", "success", *FEATURES)
    p, share = M.cross_validate(rows, FEATURES, ["success"], "task_id", select_in=("model", FOCAL))
    stable = t.spark.createDataFrame([(k, v) for k, v in share.items()], "feature string, stability double")
    p = materialize(p)
    scores = V.auc(p, [], "score", "y").crossJoin(F.broadcast(V.binary_metrics(p, [], "score", "y").select("accuracy", "brier")))
    return stable.crossJoin(F.broadcast(scores))  # one row of scores


@query("b3_permuted_cv_auc")
def _b3(t):
    rows = materialize(t.features.select("run_id", "task_id", "stratum", "model", "success", *FEATURES))
    a = M.permuted_auc(rows, FEATURES, "success", "task_id", "stratum", "run_id", PERMUTATIONS, select_in=("model", FOCAL))
    seen = a.where("rep = 0").select(F.col("auc").alias("observed"))
    return a.where("rep > 0").crossJoin(F.broadcast(seen)).groupBy("observed").agg(
        F.count("auc").alias("permutations"), F.avg("auc").alias("mean_null"), F.avg((F.col("auc") >= F.col("observed")).cast("double")).alias("p"))


_TOP = "SELECT stratum, row_number() OVER (ORDER BY count(*) DESC, stratum) AS place FROM features GROUP BY stratum QUALIFY place <= 3"
_TWO_SIDED = _NORMAL.format(z="least({z}, 8)")


@query("t24_stratum_logit", f"""WITH RECURSIVE top3 AS ({_TOP}), part AS (SELECT f.*, place FROM features f JOIN top3 USING (stratum)),
    z AS (SELECT v.f AS fold, success AS y, 1.0::DOUBLE AS c1, CASE v.f {' '.join(f"WHEN '{f}' THEN ({f} - avg({f}) OVER (PARTITION BY v.f)) / stddev_samp({f}) OVER (PARTITION BY v.f)" for f in FEATURES)} ELSE 0.0 END AS c2,
        CASE WHEN place = 2 THEN 1.0::DOUBLE ELSE 0 END AS c3, CASE WHEN place = 3 THEN 1.0::DOUBLE ELSE 0 END AS c4 FROM part, (SELECT unnest({_list(f"'{f}'" for f in ['', *FEATURES])}) AS f) v),
    keep AS (SELECT fold, [1, CASE WHEN fold = '' THEN 0 ELSE 1 END, 1, 1] AS k FROM (SELECT DISTINCT fold FROM z)), {fit_sql(4, 0.0)},
    hh AS (SELECT fold, b, ll, converged, h AS m FROM fit WHERE fold <> ''), {gauss_sql(4, 'hh', 'fold, b, ll, converged', 'cov')},
    t AS (SELECT fold AS feature, converged, CASE WHEN converged THEN b[2] END AS coef, CASE WHEN converged THEN b[2] / sqrt(w[2][2]) END AS wald,
        CASE WHEN converged THEN greatest(2 * (ll - (SELECT ll FROM fit WHERE fold = '')), 0) END AS lr FROM cov)
    SELECT feature, (SELECT count(*) FROM part) AS n, coef, wald, lr, converged, CASE WHEN converged THEN {_TWO_SIDED.format(z='abs(wald)')} END AS p, CASE WHEN converged THEN {_TWO_SIDED.format(z='sqrt(lr)')} END AS lr_p FROM t""", dbl="coef wald lr p lr_p", lng="n")
def _t24(t):
    return M.stratum_logit_table(t.features, FEATURES, "stratum", "success")


def _likelihood(g: str, model: int) -> str:
    """Profile log-likelihood at the variance ratio g from the sums of a feature's strata, as an aggregate."""
    w = f"({g} / (1 + n * {g}))"
    a00, a01, a11 = f"sum(n - {w} * n * n)", f"sum(sx - {w} * n * sx)", f"sum(sxx - {w} * sx * sx)"
    b0, b1, c = f"sum(sy - {w} * n * sy)", f"sum(sxy - {w} * sx * sy)", f"sum(syy - {w} * sy * sy)"
    det = f"({a00} * {a11} - {a01} * {a01})"
    rss = f"{c} - ({a11} * {b0} - {a01} * {b1}) / {det} * {b0} - ({a00} * {b1} - {a01} * {b0}) / {det} * {b1}" if model else f"{c} - {b0} * {b0} / {a00}"
    return f"(-sum(n) / 2 * (ln(2 * pi() * greatest({rss}, 1e-300) / sum(n)) + 1) - sum(ln(1 + n * {g})) / 2)"


def _best_ratio(model: int) -> str:
    """Golden sections of the logarithm of the ratio."""
    gold = 0.6180339887498949
    at = f"(SELECT *, hi - {gold} * (hi - lo) AS x1, lo + {gold} * (hi - lo) AS x2 FROM gs{model} WHERE step < 60)"
    return f"""gs{model} AS (SELECT DISTINCT feature, -14.0::DOUBLE AS lo, 8.0::DOUBLE AS hi, 0 AS step FROM parts UNION ALL
        SELECT feature, CASE WHEN f1 >= f2 THEN lo ELSE x1 END, CASE WHEN f1 >= f2 THEN x2 ELSE hi END, step + 1 FROM (
            SELECT q.feature, any_value(lo) AS lo, any_value(hi) AS hi, any_value(step) AS step, any_value(x1) AS x1, any_value(x2) AS x2, {_likelihood('exp(x1)', model)} AS f1, {_likelihood('exp(x2)', model)} AS f2
            FROM {at} q JOIN parts p ON p.feature = q.feature GROUP BY q.feature)),
    at{model} AS (SELECT feature, exp((lo + hi) / 2) AS g FROM gs{model} WHERE step = 60 UNION ALL SELECT DISTINCT feature, 0.0::DOUBLE FROM parts),
    top{model} AS (SELECT a.feature, a.g, {_likelihood('g', model)} AS ll FROM at{model} a JOIN parts p ON p.feature = a.feature GROUP BY a.feature, a.g QUALIFY row_number() OVER (PARTITION BY a.feature ORDER BY ll DESC) = 1)"""


_W = "(g / (1 + n * g))"


@query("t25_random_intercept", f"""WITH RECURSIVE wide AS (SELECT stratum, success::DOUBLE AS y, unnest({_list(f"'{f}'" for f in FEATURES)}) AS feature, unnest({_list(FEATURES)}) AS x FROM features),
    std AS (SELECT *, stddev_pop(x) OVER (PARTITION BY feature) AS sd, (x - avg(x) OVER (PARTITION BY feature)) / stddev_pop(x) OVER (PARTITION BY feature) AS v FROM wide),
    parts AS (SELECT feature, stratum, count(*)::DOUBLE AS n, sum(v) AS sx, sum(y) AS sy, sum(v * v) AS sxx, sum(y * y) AS syy, sum(v * y) AS sxy, max(sd) AS sd FROM std GROUP BY feature, stratum),
    {_best_ratio(1)}, {_best_ratio(0)},
    a AS (SELECT t.feature, t.g, t.ll, sum(n) AS n, max(sd) AS sd, sum(n - {_W} * n * n) AS a00, sum(sx - {_W} * n * sx) AS a01, sum(sxx - {_W} * sx * sx) AS a11, sum(sy - {_W} * n * sy) AS b0,
        sum(sxy - {_W} * sx * sy) AS b1, sum(syy - {_W} * sy * sy) AS c FROM top1 t JOIN parts p ON p.feature = t.feature GROUP BY t.feature, t.g, t.ll),
    b AS (SELECT *, a00 * a11 - a01 * a01 AS det, (a00 * b1 - a01 * b0) / (a00 * a11 - a01 * a01) AS slope, (a11 * b0 - a01 * b1) / (a00 * a11 - a01 * a01) AS base FROM a),
    r AS (SELECT b.feature, n, slope / sd AS coef, sqrt((c - base * b0 - slope * b1) / n * a00 / det) / sd AS se, b.g AS ratio, b.g = 0 AS border, greatest(2 * (b.ll - t.ll), 0) AS lr FROM b JOIN top0 t ON t.feature = b.feature)
    SELECT feature, n, coef, se, round(ratio, 4) AS ratio, border, lr, coef / se AS z, {_TWO_SIDED.format(z='abs(coef / se)')} AS p, {_TWO_SIDED.format(z='sqrt(lr)')} AS lr_p FROM r""", dbl="coef se ratio lr z p lr_p", lng="n")
def _t25(t):
    return M.random_intercept(t.features, FEATURES, "stratum", "success").withColumn("ratio", F.round("ratio", 4))


@query("e21_average_precision", """WITH s AS (SELECT score, count(*) AS w, count(*) FILTER (WHERE success = 1) AS p FROM preds GROUP BY score)
    SELECT sum(p * hits / seen) / (SELECT sum(p) FROM s) AS average_precision FROM (SELECT *, sum(p) OVER (ORDER BY score DESC) AS hits, sum(w) OVER (ORDER BY score DESC) AS seen FROM s)""", dbl="average_precision")
def _e21(t):
    return V.average_precision(preds(t), [], "score", "success")


@query("e21_block_bootstrap", f"""WITH c AS (SELECT task_id, sum(f_common) AS s, count(*) AS c FROM features GROUP BY task_id),
    placed AS (SELECT *, row_number() OVER (ORDER BY md5(task_id), task_id) - 1 AS i, count(*) OVER () AS m FROM c),
    drawn AS (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || i), 1, 8))::BIGINT % m AS i FROM placed, range(0, {DRAWS}) g(rep))
    SELECT rep, sum(s) / sum(c) AS mean FROM drawn JOIN placed USING (i) GROUP BY rep""", dbl="mean", lng="rep")
def _e21b(t):
    return R.block_bootstrap_mean(t.features, "task_id", "f_common", DRAWS)




@query("e21_block_bootstrap_auc", f"""WITH placed AS (SELECT *, row_number() OVER (ORDER BY md5(task_id), task_id) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT task_id FROM preds)),
    drawn AS (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || i), 1, 8))::BIGINT % m AS i FROM placed, range(0, {DRAWS}) g(rep)),
    sample AS (SELECT d.rep, p.score, p.success FROM drawn d JOIN placed USING (i) JOIN preds p USING (task_id)), a AS ({auc_sql('sample', 'rep', 'score', 'success')})
    SELECT count(auc) AS replicates, avg(auc) AS mean, stddev_samp(auc) AS se, quantile_cont(auc, 0.025) AS low, quantile_cont(auc, 0.975) AS high FROM a""", dbl="mean se low high", lng="replicates")
def _e21c(t):
    return R.bootstrap_interval(materialize(R.block_bootstrap_auc(preds(t), "task_id", "score", "success", DRAWS)))


_AP_SAMPLE = f"""placed AS (SELECT *, row_number() OVER (ORDER BY md5(task_id), task_id) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT task_id FROM preds)),
    drawn AS (SELECT rep, ('0x' || substr(md5('42|' || rep || '|' || i), 1, 8))::BIGINT % m AS i FROM placed, range(0, {DRAWS}) g(rep)),
    s AS (SELECT rep, score, count(*) AS w, count(*) FILTER (WHERE success = 1) AS p FROM drawn JOIN placed USING (i) JOIN preds USING (task_id) GROUP BY rep, score),
    steps AS (SELECT *, sum(p) OVER (PARTITION BY rep ORDER BY score DESC) AS hits, sum(w) OVER (PARTITION BY rep ORDER BY score DESC) AS seen FROM s),
    a AS (SELECT rep, sum(p * hits / seen) / nullif(sum(p), 0) AS ap FROM steps GROUP BY rep)"""


@query("e21_block_bootstrap_precision", f"""WITH {_AP_SAMPLE}
    SELECT count(ap) AS replicates, avg(ap) AS mean, stddev_samp(ap) AS se, quantile_cont(ap, 0.025) AS low, quantile_cont(ap, 0.975) AS high FROM a""", dbl="mean se low high", lng="replicates")
def _e21d(t):
    return R.bootstrap_interval(materialize(R.block_bootstrap_precision(preds(t), "task_id", "score", "success", DRAWS)), "average_precision")
