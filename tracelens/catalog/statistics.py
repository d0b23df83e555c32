"""Association, combination and multiplicity queries on labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.gates import kappa
from ..operators.runs import majority
from ..operators.skew import average_ranks, quantile
from ..plans import association as A
from ..plans import evidence as E
from ..sources import tables
from . import bind as B
from .registry import query
from .sequences import LONG_FEATURES, long


def rnk(by: str, x: str) -> str:
    by = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by[13:-1]}, {x}" if by else f"PARTITION BY {x}"
    return f"rank() OVER ({by}ORDER BY {x}) + (count(*) OVER ({tie}) - 1) / 2.0::DOUBLE"


def rho_sql(source: str, keys: str, x: str = "x", y: str = "success", floor: int = 0) -> str:
    """n and Spearman's rho per group, straight from the definition."""
    cols = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {cols}count(*) AS n, CASE WHEN count(*) < {floor} OR isnan(corr(rx, ry)) THEN NULL ELSE corr(rx, ry) END AS rho
        FROM (SELECT {cols}{rnk(keys, x)} AS rx, {rnk(keys, y)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) {group}"""


def t_p(r: str, n: str) -> str:
    """Two-sided t tail from rho and n by the finite series for whole degrees of freedom."""
    v, c = f"({n} - 2)", f"ln(1 - {r} * {r})"
    even = f"abs({r}) * list_sum(list_transform(range(0, {v} // 2), lambda k: exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - 2 * k * ln(2) + k * {c})))"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum(list_transform(range(0, ({v} - 1) // 2), lambda k: exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2) + (k + 0.5) * {c}))), 0))"
    return f"CASE WHEN {r} IS NULL OR {n} < 3 THEN NULL WHEN abs({r}) > 0.9999999999 THEN 0.0 WHEN {v} % 2 = 0 THEN 1 - {even} ELSE 1 - {odd} END"


def chi_p(x: str, k: str) -> str:
    return f"CASE WHEN {x} <= 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(0, {k}), lambda i: exp(i * ln({x} / 2) - {x} / 2 - lgamma(i + 1))))) END"


def tested(name: str, source: str, keys: str, floor: int = 0, y: str = "success") -> None:
    B.CTES[name + "_rho"] = rho_sql(source, keys, y=y, floor=floor)
    B.CTES[name] = f"SELECT *, {t_p('rho', 'n')} AS p FROM {name}_rho"


tested("within", "long", "stratum, feature", floor=5)
tested("pooled", "long", "feature")
tested("by_model", "long", "model, feature", floor=5)
tested("by_model_toxic", "long", "model, feature", floor=5, y="toxic")
tested("by_wave", "long", "wave, feature")
B.CTES["fisher"] = f"""SELECT feature, k, chi2, mean_rho, same_sign, {chi_p('chi2', 'k')} AS p_combined FROM (
    SELECT feature, count(*) AS k, -2 * sum(ln(greatest(p, 1e-300::DOUBLE))) AS chi2, sum(rho * n) / sum(n) AS mean_rho, abs(sum(sign(rho))) = count(*) AS same_sign
    FROM within WHERE p IS NOT NULL GROUP BY feature)"""


def result(t, name: str, keys: list[str], floor: int = 0, y: str = "success"):
    if name not in t.__dict__:
        t.__dict__[name] = A.with_pvalue(A.spearman(long(t), keys, y=y, min_n=floor))
    return t.__dict__[name]


def within(t):
    return result(t, "_within", ["stratum", "feature"], 5)


def pooled(t):
    return result(t, "_pooled", ["feature"])


def by_model(t):
    return result(t, "_by_model", ["model", "feature"], 5)


def by_wave(t):
    return result(t, "_by_wave", ["wave", "feature"])


def fisher(t):
    return A.fisher_combine(A.with_log_pvalue(within(t)), ["feature"], log_p="ln_p")


@query("flagship_within_stratum", """SELECT feature, k, chi2, mean_rho, same_sign, p_combined, rk AS bh_rank, round(rk / m * 0.05::DOUBLE, 6) AS bh_threshold,
    rk <= coalesce(max(CASE WHEN p_combined <= round(rk / m * 0.05::DOUBLE, 6) THEN rk END) OVER (), 0) AS survives
    FROM (SELECT *, row_number() OVER (ORDER BY p_combined, feature) AS rk, count(*) OVER () AS m FROM (SELECT * REPLACE (round(p_combined, 9) AS p_combined) FROM fisher))""",
       dbl="chi2 mean_rho p_combined bh_threshold", lng="k bh_rank")
def _flagship(t):
    return A.benjamini_hochberg(fisher(t).withColumn("p_combined", F.round("p_combined", 9)), "feature", p="p_combined")


@query("t1_average_ranks", f"SELECT DISTINCT stratum, feature, x, {rnk('stratum, feature', 'x')} AS rnk FROM long", dbl="x rnk")
def _t1(t):
    rows = long(t).select("stratum", "feature", "x", F.lit(1).alias("one"))
    return average_ranks(rows, ["stratum", "feature"], "x", "one").select("stratum", "feature", "x", "rnk")


@query("t2_spearman", "SELECT model, feature, n, rho FROM by_model", dbl="rho", lng="n")
def _t2(t):
    return A.spearman(long(t), ["model", "feature"], y="success", min_n=5)


@query("t3_spearman_pvalue", "SELECT model, feature, n, rho, p FROM by_model", dbl="rho p", lng="n")
def _t3(t):
    return by_model(t)


B.CTES["task_latest"] = "SELECT * FROM features QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY run_id DESC) = 1"
B.CTES["task_long"] = " UNION ALL ".join(f"SELECT success, '{f}' AS feature, {f} AS x FROM task_latest" for f in LONG_FEATURES)
tested("task_level", "task_long", "feature", floor=5)


@query("t4_task_level_table", "SELECT feature, n, rho, p, least(p * count(p) OVER (), 1) AS p_bonf, CASE WHEN least(p * count(p) OVER (), 1) < 0.001 THEN '***' WHEN least(p * count(p) OVER (), 1) < 0.01 THEN '**' WHEN least(p * count(p) OVER (), 1) < 0.05 THEN '*' ELSE '' END AS stars FROM task_level",
       dbl="rho p p_bonf", lng="n")
def _t4(t):
    last = tables.latest(t.features, "task_id", ["run_id"])
    out = A.bonferroni(A.with_pvalue(A.spearman(A.to_long(last, ["success"], LONG_FEATURES), ["feature"], y="success", min_n=5)))
    p = F.col("p_bonf")
    return out.withColumn("stars", F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))


B.CTES["binned"] = """SELECT b.bin, f.feature, f.x, c.success, c.run_id FROM (SELECT c.*, r.success, CASE WHEN seq <= 3 THEN 'early' WHEN seq <= 7 THEN 'mid' ELSE 'late' END AS own FROM calls c JOIN call_runs r USING (run_id)) c,
    LATERAL (SELECT unnest([c.own, 'all']) AS bin) b, LATERAL (SELECT unnest(['value', 'k', 'chars']) AS feature, unnest([c.value, CAST(c.k AS DOUBLE), CAST(length(c.tool_target) AS DOUBLE)]) AS x) f"""


@query("t5_call_bin_matrix", f"""SELECT m.feature, m.bin, n, rho, abs(rho) > 0.2 AS flagged, u.n_runs FROM ({rho_sql('binned', 'feature, bin', floor=15)}) m
    JOIN (SELECT bin, count(DISTINCT run_id) AS n_runs FROM binned GROUP BY bin) u USING (bin)""", dbl="rho", lng="n n_runs")
def _t5(t):
    rows = t.calls.join(t.call_runs, "run_id").select(
        "run_id", "success", "value", F.col("k").cast("double").alias("k"), F.length("tool_target").cast("double").alias("chars"),
        F.explode(F.array(T.trajectory_bin("seq"), F.lit("all"))).alias("bin"))
    stats = A.spearman(A.to_long(rows, ["bin", "success"], ["value", "k", "chars"]), ["feature", "bin"], y="success", min_n=15)
    n_runs = rows.groupBy("bin").agg(F.count_distinct("run_id").alias("n_runs"))
    return stats.join(n_runs, "bin").withColumn("flagged", F.abs("rho") > 0.2)


@query("t6_within_stratum", "SELECT stratum, feature, n, rho, p FROM within", dbl="rho p", lng="n")
def _t6(t):
    return within(t)


def partial_sql(strata: str = "") -> str:
    mean = lambda c: f"{c} - avg({c}) OVER (PARTITION BY feature{', stratum' if strata else ''})"
    return f"""SELECT feature, count(*) AS n, CASE WHEN isnan(corr(ra, rb)) THEN NULL ELSE corr(ra, rb) END AS rho FROM (
        SELECT feature, {rnk('feature', 'ex')} AS ra, {rnk('feature', 'ey')} AS rb FROM (
            SELECT feature, round(dx - coalesce(sum(dx * dz) OVER w / nullif(sum(dz * dz) OVER w, 0), 0) * dz, 9) AS ex,
                round(dy - coalesce(sum(dy * dz) OVER w / nullif(sum(dz * dz) OVER w, 0), 0) * dz, 9) AS ey
            FROM (SELECT feature, {mean('rx')} AS dx, {mean('ry')} AS dy, {mean('rz')} AS dz FROM (
                SELECT l.feature, l.stratum, {rnk('l.feature', 'l.x')} AS rx, {rnk('l.feature', 'l.success')} AS ry, {rnk('l.feature', 'z.f_chars')} AS rz
                FROM long l JOIN features z USING (run_id) WHERE l.feature <> 'f_chars')) WINDOW w AS (PARTITION BY feature))) GROUP BY feature"""


def _controlled(t):
    rows = t.features.withColumn("z", F.col("f_chars"))
    return A.to_long(rows, ["run_id", "stratum", "success", "z"], [f for f in LONG_FEATURES if f != "f_chars"])


B.CTES["partial_one"] = partial_sql()
B.CTES["partial_strata"] = partial_sql("stratum")


@query("t7_partial_spearman", f"SELECT feature, n, rho, {t_p('rho', 'n')} AS p FROM partial_one", dbl="rho p", lng="n")
def _t7(t):
    return A.with_pvalue(A.partial_spearman(_controlled(t), ["feature"], "x", "success", "z"))


@query("t8_partial_spearman_strata", f"SELECT feature, n, rho, {t_p('rho', 'n')} AS p FROM partial_strata", dbl="rho p", lng="n")
def _t8(t):
    return A.with_pvalue(A.partial_spearman(_controlled(t), ["feature"], "x", "success", "z", strata="stratum"))


@query("t9_bonferroni", "SELECT stratum, feature, p, least(p * count(p) OVER (), 1) AS p_bonf, p < 0.05::DOUBLE / count(p) OVER () AS survives FROM within WHERE p IS NOT NULL", dbl="p p_bonf")
def _t9(t):
    out = A.bonferroni(within(t).where(F.col("p").isNotNull()))
    m = within(t).agg(F.count("p").alias("m"))
    return out.crossJoin(F.broadcast(m)).select("stratum", "feature", "p", "p_bonf", (F.col("p") < 0.05 / F.col("m")).alias("survives"))  # one row


@query("t10_benjamini_hochberg", """SELECT stratum, feature, p, rk AS bh_rank, round(rk / m * 0.2::DOUBLE, 6) AS bh_threshold,
    rk <= coalesce(max(CASE WHEN p <= round(rk / m * 0.2::DOUBLE, 6) THEN rk END) OVER (PARTITION BY stratum), 0) AS survives
    FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY p, feature) AS rk, count(*) OVER (PARTITION BY stratum) AS m FROM (SELECT * REPLACE (round(p, 9) AS p) FROM within) WHERE p IS NOT NULL)""",
       dbl="p bh_threshold", lng="bh_rank")
def _t10(t):
    out = A.benjamini_hochberg(within(t).withColumn("p", F.round("p", 9)), "feature", q=0.2, family=["stratum"])
    return out.select("stratum", "feature", "p", "bh_rank", "bh_threshold", "survives")


@query("t11_fisher_combination", "SELECT * FROM fisher", dbl="chi2 mean_rho p_combined", lng="k")
def _t11(t):
    return fisher(t)


@query("t12_fisher_interval", """SELECT stratum, feature, rho, CASE WHEN n > 3 AND abs(rho) < 1 THEN tanh(atanh(rho) - 1.959963984540054::DOUBLE / sqrt(n - 3)) END AS ci_low,
    CASE WHEN n > 3 AND abs(rho) < 1 THEN tanh(atanh(rho) + 1.959963984540054::DOUBLE / sqrt(n - 3)) END AS ci_high FROM within""", dbl="rho ci_low ci_high")
def _t12(t):
    return A.fisher_interval(within(t)).select("stratum", "feature", "rho", "ci_low", "ci_high")


@query("t13_fixed_effects", """SELECT feature, count(*) AS k, sum((n - 3) * atanh(rho)) / sum(n - 3) AS z_mean, 1 / sqrt(sum(n - 3)) AS z_se, tanh(sum((n - 3) * atanh(rho)) / sum(n - 3)) AS rho_pooled
    FROM by_wave WHERE abs(rho) < 1 AND n > 3 GROUP BY feature""", dbl="z_mean z_se rho_pooled", lng="k")
def _t13(t):
    return A.fixed_effects(by_wave(t), ["feature"])


B.CTES["pairs"] = " UNION ALL ".join(
    f"SELECT run_id, '{a}' AS f1, '{b}' AS f2, {a} AS x, {b} AS y FROM features"
    for i, a in enumerate(LONG_FEATURES) for b in LONG_FEATURES[i + 1:])


@query("t14_intercorrelation", f"SELECT f1, f2, n, rho, coalesce(abs(rho) > 0.5, false) AS collinear FROM ({rho_sql('pairs', 'f1, f2', y='y', floor=5)})", dbl="rho", lng="n")
def _t14(t):
    """Every pair of features; ``E.reaching`` gives those with a small p to who wants fewer."""
    return E.intercorrelation(t.features, LONG_FEATURES)


@query("j9_feature_pairs", "SELECT * FROM pairs", dbl="x y")
def _j9(t):
    return E.pair_values(t.features, ["run_id"], LONG_FEATURES)


_DIR = {"f_tokens": "positive", "f_common": "negative", "f_parts": "positive", "random_noise": "null"}
B.CTES["noised"] = """SELECT success, 'random_noise' AS feature, ('0x' || substr(md5('42|' || run_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS x FROM features
    UNION ALL SELECT success, feature, x FROM long WHERE feature IN ('f_tokens', 'f_common', 'f_parts')"""


@query("t15_direction_check", f"""SELECT feature, n, rho, CASE feature WHEN 'random_noise' THEN 'null' WHEN 'f_common' THEN 'negative' ELSE 'positive' END AS expected,
    CASE WHEN rho IS NULL THEN 'no var' WHEN feature = 'random_noise' THEN 'control' WHEN (rho > 0) = (feature <> 'f_common') THEN 'YES' ELSE 'NO' END AS matches FROM ({rho_sql('noised', 'feature')})""",
       dbl="rho", lng="n")
def _t15(t):
    rows = A.to_long(t.features.withColumn("random_noise", E.noise("run_id")), ["success"], list(_DIR))
    return E.direction_check(A.spearman(rows, ["feature"], y="success"), _DIR)


B.CTES["methods"] = f"""SELECT 'pooled' AS method, feature, p FROM pooled UNION ALL SELECT 'partial', feature, {t_p('rho', 'n')} FROM partial_one
    UNION ALL SELECT model, feature, p FROM by_model UNION ALL SELECT 'fisher', feature, p_combined FROM fisher"""


def methods(t):
    part = A.with_pvalue(A.partial_spearman(_controlled(t), ["feature"], "x", "success", "z"))
    out = pooled(t).select(F.lit("pooled").alias("method"), "feature", "p")
    out = out.unionByName(part.select(F.lit("partial").alias("method"), "feature", "p"))
    out = out.unionByName(by_model(t).select(F.col("model").alias("method"), "feature", "p"))
    return out.unionByName(fisher(t).select(F.lit("fisher").alias("method"), "feature", F.col("p_combined").alias("p")))


@query("t16_evidence_ranking", """SELECT feature, count_if(p < 0.05) AS methods, min(p) AS min_p, coalesce(bool_or(p < 0.05::DOUBLE / (SELECT count(DISTINCT feature) FROM methods)), false) AS survives FROM methods GROUP BY feature""",
       dbl="min_p", lng="methods")
def _t16(t):
    return E.rank_evidence(methods(t))


@query("t18_polarity", """SELECT a.feature, a.rho AS rho_a, a.p AS p_a, b.rho AS rho_b, b.p AS p_b, CASE WHEN a.rho IS NULL OR b.rho IS NULL THEN NULL WHEN a.p < 0.05 AND b.p < 0.05 AND sign(a.rho) = sign(b.rho) THEN 'same direction'
    WHEN a.p < 0.05 AND b.p < 0.05 THEN 'flipped' WHEN a.p < 0.05 OR b.p < 0.05 THEN 'model specific' WHEN sign(a.rho) <> sign(b.rho) THEN 'suggestive' ELSE 'none' END AS kind
    FROM by_model a JOIN by_model b USING (feature) WHERE a.model < b.model""".replace("SELECT a.feature,", "SELECT a.model AS model_a, b.model AS model_b, a.feature,"), dbl="rho_a p_a rho_b p_b")
def _t18(t):
    """Every pair of models."""
    return E.polarity(by_model(t), ["feature"], "model")


B.CTES["layered"] = f"""SELECT role AS layer, f.feature, f.x, l.quality AS success FROM (SELECT conv_id, role, avg(length(text)) AS chars, avg({B.per_tok(B.sub_hits('text', B.COMMON_PARTS), 'text')}) AS parts FROM conversations WHERE role <> 'system' GROUP BY ALL) c
    JOIN labels l ON l.doc_id = c.conv_id, LATERAL (SELECT unnest(['chars', 'parts']) AS feature, unnest([c.chars, c.parts]) AS x) f"""


@query("t19_layer_dissociation", f"""WITH r AS ({rho_sql('layered', 'layer, feature')}) SELECT a.feature, coalesce(a.rho, 0) AS rho_a, coalesce(b.rho, 0) AS rho_b,
    CASE WHEN abs(coalesce(a.rho, 0)) > abs(coalesce(b.rho, 0)) THEN 'assistant' WHEN abs(coalesce(b.rho, 0)) > abs(coalesce(a.rho, 0)) THEN 'user' ELSE 'tie' END AS winner
    FROM r a JOIN r b USING (feature) WHERE a.layer = 'assistant' AND b.layer = 'user'""", dbl="rho_a rho_b")
def _t19(t):
    per = t.conversations.where("role <> 'system'").groupBy(F.col("conv_id").alias("run_id"), F.col("role").alias("layer")).agg(
        F.avg(F.length("text")).alias("chars"), F.avg(T.substring_density("text", B.COMMON_PARTS)).alias("parts"))
    rows = A.to_long(per.join(t.call_runs, "run_id"), ["layer", "success"], ["chars", "parts"])
    return E.layer_winner(A.spearman(rows, ["layer", "feature"], y="success"), "assistant", "user")


_QUAD = """SELECT CASE WHEN f_tokens > m1 THEN 'H' ELSE 'L' END || CASE WHEN f_common > m2 THEN 'H' ELSE 'L' END AS cell, count(*) AS n, avg(success) AS rate FROM features
    JOIN (SELECT stratum, quantile_cont(f_tokens, 0.5) AS m1, quantile_cont(f_common, 0.5) AS m2 FROM features GROUP BY stratum) USING (stratum) GROUP BY 1"""


@query("t20_quadrants", _QUAD, dbl="rate", lng="n")
def _t20(t):
    return E.quadrants(t.features, "stratum", "f_tokens", "f_common", "success")


@query("t20_interaction_bonus", f"""WITH c AS ({_QUAD}) SELECT max(CASE WHEN cell = 'HH' THEN rate END) AS HH, max(CASE WHEN cell = 'HL' THEN rate END) AS HL, max(CASE WHEN cell = 'LH' THEN rate END) AS LH, max(CASE WHEN cell = 'LL' THEN rate END) AS LL,
    max(CASE WHEN cell = 'HH' THEN rate END) - max(CASE WHEN cell = 'HL' THEN rate END) - max(CASE WHEN cell = 'LH' THEN rate END) + max(CASE WHEN cell = 'LL' THEN rate END) AS bonus FROM c""", dbl="HH HL LH LL bonus")
def _t20b(t):
    return E.interaction_bonus(E.quadrants(t.features, "stratum", "f_tokens", "f_common", "success"))


@query("t21_replication", """SELECT a.feature, a.rho AS rho_a, a.p AS p_a, b.rho AS rho_b, b.p AS p_b, coalesce(sign(a.rho) = sign(b.rho) AND a.p < 0.05 AND b.p < 0.05, false) AS replicates
    FROM by_wave a JOIN by_wave b USING (feature) WHERE a.wave = 0 AND b.wave = 1""", dbl="rho_a p_a rho_b p_b")
def _t21(t):
    return E.replication(by_wave(t), ["feature"], "wave", 0, 1)


B.CTES["votes"] = """SELECT stratum, model, CASE WHEN avg(long) > 0.5 THEN 1 ELSE 0 END AS vote FROM
    (SELECT stratum, model, CAST(f_tokens > (SELECT quantile_cont(f_tokens, 0.5) FROM features) AS INT) AS long FROM features) GROUP BY stratum, model"""


def _votes(t):
    """Majority vote of each model per stratum on whether a text is longer than the median; an even split is a no."""
    mid = quantile(t.features, [], "f_tokens", [0.5])
    rows = t.features.crossJoin(F.broadcast(mid)).withColumn("long", (F.col("f_tokens") > F.col("q0")).cast("int"))  # one row
    votes = majority(rows, ["stratum", "model"], 0, "long").select("stratum", "model", "vote")
    a = votes.select("stratum", F.col("model").alias("model_a"), F.col("vote").alias("a"))
    return a.join(votes.select("stratum", F.col("model").alias("model_b"), F.col("vote").alias("b")), "stratum").where("model_a < model_b")


@query("t22_model_agreement", """WITH v AS (SELECT x.model AS model_a, y.model AS model_b, x.vote AS a, y.vote AS b FROM votes x JOIN votes y USING (stratum) WHERE x.model < y.model),
    s AS (SELECT model_a, model_b, count(*) AS n, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM v GROUP BY ALL)
    SELECT model_a, model_b, n, po AS agreement, (po - pe) / nullif(1 - pe, 0) AS kappa FROM s""", dbl="agreement kappa", lng="n")
def _t22(t):
    """Agreement of the majority votes of every pair of models over strata."""
    return kappa(_votes(t), ["model_a", "model_b"], "a", "b")


@query("t22_stratum_agreement", """SELECT stratum, count(*) AS pairs, count(*) FILTER (WHERE x.vote = y.vote) AS agree FROM votes x JOIN votes y USING (stratum) WHERE x.model < y.model GROUP BY stratum""", lng="pairs agree")
def _t22b(t):
    """The same per stratum: pairs of models, and pairs that agree."""
    return _votes(t).groupBy("stratum").agg(F.count("*").alias("pairs"), F.count_if(F.col("a") == F.col("b")).alias("agree"))


@query("t23_within_between", "SELECT run_id, avg(f_tokens) OVER (PARTITION BY stratum) AS between, f_tokens - avg(f_tokens) OVER (PARTITION BY stratum) AS within FROM features", dbl="between within")
def _t23(t):
    return E.within_between(t.features, "stratum", "f_tokens").select("run_id", "between", "within")


@query("t23_intraclass", """WITH p AS (SELECT count(*)::DOUBLE AS n, avg(f_tokens) AS m, coalesce(var_samp(f_tokens), 0) AS v FROM features GROUP BY stratum),
    s AS (SELECT count(*)::DOUBLE AS k, sum(n) AS n, sum(n * n) AS nn, sum(n * m) AS s1, sum(n * m * m) AS s2, sum(v * (n - 1)) AS ssw FROM p),
    v AS (SELECT *, (s2 - s1 * s1 / n) / (k - 1) AS msb, ssw / (n - k) AS msw, (n - nn / n) / (k - 1) AS n0 FROM s)
    SELECT k AS strata, n, (msb - msw) / (msb + (n0 - 1) * msw) AS icc FROM v""", dbl="icc", lng="strata n")
def _t23b(t):
    return E.intraclass(t.features, "stratum", "f_tokens")


@query("j12_common_survivors", "SELECT feature, count(*) AS models FROM by_model WHERE p < 0.3 GROUP BY feature HAVING count(*) >= 2", lng="models")
def _j12(t):
    """Features that survive in two models or more."""
    return by_model(t).where("p < 0.3").groupBy("feature").agg(F.count("*").alias("models")).where("models >= 2")


@query("j12_survivors_of_outcomes", "SELECT model, feature FROM by_model WHERE p < 0.3 INTERSECT SELECT model, feature FROM by_model_toxic WHERE p < 0.3")
def _j12b(t):
    """Features that survive for both outcomes, in each model."""
    other = result(t, "_by_model_toxic", ["model", "feature"], 5, y="toxic")
    hit = lambda r: r.where("p < 0.3").select("model", "feature")
    return hit(by_model(t)).intersect(hit(other))
