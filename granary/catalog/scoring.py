"""Classifiers, scores, trials and their analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.catalog.inputs import BEST, KEYS, RUNS, TRIALS, r6, table, trial_runs, trials
from granary.catalog.splits import GRID_SQL
from granary.functions.scalars import params_text
from granary.operators import analytics as H
from granary.operators import classifiers as M
from granary.operators import evaluation as G
from granary.operators.split import repeated_stratified_holdout
from granary.plans.search import grid_search

DIMS = 64
SMOOTHING = 1e-7


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda v: v.cast("double")).alias("features"),
        F.col("label").alias("label_idx"),
    )


def gaussian(spark, sf):
    rows = repeated_stratified_holdout(_vectors(spark, sf), "vec_id", "label_idx", k=1)
    train, test = rows.where(~F.col("test_0")), rows.where(F.col("test_0"))
    scored = M.gaussian_log_density(test, M.fit_gaussian_nb(train), SMOOTHING)
    return scored.select("vec_id", "label_idx", F.col("prediction").cast("bigint").alias("prediction"))


# Classes that follow a rule on columns with few distinct values: a classifier that
# works finds the rule, and SQL can state it.
RULE = "case when l_linenumber <= 3 then 0 when l_discount > 0.045 then 1 else 2 end"
SIDE = "case when l_linenumber > 4 then 1 else 0 end"


def _ruled(spark, sf, rule):
    return table(spark, sf, "lineitem").selectExpr(
        "l_linenumber", "l_discount", f"cast({rule} as int) as label_idx",
        "array(l_linenumber / 4.0D - 1, l_discount * 20 - 1) as features",
    )


def _fitted(model, params, rule):
    """Fits on all rows and predicts them: the predictions per cell of the two columns."""

    def run(spark, sf):
        rows = _ruled(spark, sf, rule)
        scored = M.fit_predict(model, params, rows, rows, rows.count())
        return _cells(scored)

    return run


def _cells(scored):
    return scored.groupBy("l_linenumber", F.round(F.col("l_discount") * 100).cast("bigint").alias("percent")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("prediction").cast("bigint").alias("least"),
        F.max("prediction").cast("bigint").alias("most"),
    )


def prediction(spark, sf):
    rows = _ruled(spark, sf, RULE)
    fitted = M.fit_decision_tree(rows, {"max_depth": 10})
    return _cells(M.predict(fitted, rows))


# Two groups of nations, far apart on one of two features.
GROUP = "case when c_nationkey >= 13 then 'east' else 'west' end"


def search(spark, sf):
    """The full grid with all holdouts, over classes that every classifier can tell apart."""
    customers = table(spark, sf, "customer").selectExpr(
        "c_custkey", f"{GROUP} as `Label`", "cast(c_nationkey + if(c_nationkey >= 13, 100, 0) as double) as place",
        "cast(c_nationkey % 5 as double) as other",
    )
    found = grid_search(customers, "c_custkey", features=["place", "other"], parallelism=8)
    return found.select("model", "combo_idx", params_text("params").alias("params"), "f1", "holdouts", "error")


# A rule that no model can learn fully: a sixth of the labels are turned round.
NOISY = "case when (c_acctbal > 4000 and c_nationkey > 8) <> (c_custkey % 6 = 0) then 'p' else 'q' end"


def noisy_search(spark, sf):
    """The full grid over noisy classes: Naive Bayes by its scores, the others by bounds and by whether limits matter."""
    customers = table(spark, sf, "customer").selectExpr(
        "c_custkey", f"{NOISY} as `Label`", "c_acctbal as balance", "cast(c_nationkey as double) as place"
    )
    found = grid_search(customers, "c_custkey", features=["balance", "place"], parallelism=4)
    bayes = F.col("model") == "Naive Bayes"
    trees = F.col("model").isin("Decision Tree", "Random Forest")
    scores = F.size(F.collect_set("f1").over(Window.partitionBy("model")))
    return found.select(
        "model", "combo_idx", F.when(bayes, r6("f1")).alias("f1"), "holdouts",
        ((F.col("f1") > 0.55) & (F.col("f1") < 0.9)).alias("in_bounds"),
        (trees & (scores > 2)).alias("limits_matter"),
    )


def _judged(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "lang")
    return table(spark, sf, "labels").join(documents, "doc_id")


def weighted(spark, sf):
    scored = G.weighted_f1(_judged(spark, sf), "quality", "toxic", ("lang",))
    return scored.select("lang", r6("f1").alias("f1"))


def confusion(spark, sf):
    return G.confusion_matrix(_judged(spark, sf), "quality", "toxic", ("lang",))


def per_class(spark, sf):
    scores = G.per_class_scores(confusion(spark, sf), ("lang",))
    return scores.select(
        "lang", "label", "support", "predicted",
        r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
    )


def means(spark, sf):
    scores = G.mean_score(trial_runs(spark, sf), (*KEYS, "model", "combo_idx"))
    return scores.select(*KEYS, "model", "combo_idx", r6("f1").alias("f1"), "holdouts")


def _best(spark, sf):
    return G.best_per_model(trials(spark, sf), KEYS)


def best(spark, sf):
    return _best(spark, sf).select(
        *KEYS, "model", "combo_idx", params_text("params").alias("params"), r6("f1_score").alias("f1_score")
    )


def running(spark, sf):
    return G.running_best(trials(spark, sf), KEYS).select(
        *KEYS, "model", "combo_idx", r6("best_so_far").alias("best_so_far")
    )


def failures(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("experiment_id"))
    scored = G.failed_trials_as_zero(G.param_grid(suppliers), trials(spark, sf), KEYS)
    return scored.select(*KEYS, "model", "combo_idx", r6("f1").alias("f1"), "error")


def progression(spark, sf):
    return H.score_progression(trials(spark, sf), KEYS).withColumn("f1", r6("f1"))


def comparison(spark, sf):
    return H.compare_models(_best(spark, sf), KEYS).select(
        *KEYS, "model", r6("f1_score").alias("f1_score"), r6("mean_f1").alias("mean_f1")
    )


def steadiness(spark, sf):
    return H.stability(trials(spark, sf), KEYS).withColumn("stability", r6("stability"))


def plainness(spark, sf):
    return _best(spark, sf).select(*KEYS, "model", H.simplicity().alias("simplicity"))


def profile(spark, sf):
    rows = H.model_profile(_best(spark, sf), trials(spark, sf), KEYS)
    return rows.withColumn("f1_score", r6("f1_score")).withColumn("stability", r6("stability"))


def sensitivity(spark, sf):
    rows = H.param_sensitivity(trials(spark, sf), KEYS)
    return rows.withColumn("sensitivity", r6("sensitivity"))


def last_sensitivity(spark, sf):
    rows = H.param_sensitivity(trials(spark, sf), KEYS, last_model_wins=True)
    return rows.withColumn("sensitivity", r6("sensitivity"))


def complexity(spark, sf):
    return H.score_vs_complexity(trials(spark, sf), KEYS).withColumn("f1", r6("f1"))


def ranking(spark, sf):
    return H.rank_configs(_best(spark, sf), KEYS).withColumn("f1_score", r6("f1_score"))


def overview(spark, sf):
    return H.results_summary(trials(spark, sf), KEYS).withColumn("best_score", r6("best_score"))


def models_by_name(spark, sf):
    return best(spark, sf).orderBy("model", *KEYS)


def models_by_score(spark, sf):
    return comparison(spark, sf).orderBy(F.desc("f1_score"), "model", *KEYS)


QUERIES = {
    "g2_logistic_regression": _fitted("Logistic Regression", {"C": 10, "max_iter": 1000}, SIDE),
    "g3_gaussian_nb": gaussian,
    "g4_decision_tree": _fitted(
        "Decision Tree", {"max_depth": 10, "min_samples_split": 5, "min_samples_leaf": 2}, RULE
    ),
    "g5_random_forest": _fitted(
        "Random Forest",
        {"n_estimators": 50, "max_depth": 15, "min_samples_split": 5, "min_samples_leaf": 2},
        RULE,
    ),
    "g6_predict": prediction,
    "g7_weighted_f1": weighted,
    "g8_confusion_matrix": confusion,
    "g8_per_class_scores": per_class,
    "g9_mean_score": means,
    "g10_best_per_model": best,
    "g11_running_best": running,
    "g12_failed_trials": failures,
    "g13_grid_search": search,
    "g13_noisy_grid": noisy_search,
    "h1_score_progression": progression,
    "h2_compare_models": comparison,
    "h3_stability": steadiness,
    "h4_simplicity": plainness,
    "h5_model_profile": profile,
    "h6_param_sensitivity": sensitivity,
    "h6_last_model_wins": last_sensitivity,
    "h7_score_vs_complexity": complexity,
    "h8_rank_configs": ranking,
    "h9_results_summary": overview,
    "s3_models_by_name": models_by_name,
    "s4_models_by_score": models_by_score,
    "s5_first_best": best,
}

_PARAMS = "'C=' || p_c || ', max_iter=' || p_iter"
_STABLE = "greatest(0, least(1, 1 - stddev_pop(f1) / greatest(avg(f1), 0.1)))"
_SPEED = "case model when 'Logistic Regression' then 0.9 when 'Naive Bayes' then 1.0 else 0.5 end::double"
_TIER = "case when s > 0.05 then 'high' when s > 0.02 then 'medium' else 'low' end"
_SENSITIVITY = f"""{TRIALS}, e as (
    select *, 'C' as param, p_c as v from trials
    union all select *, 'max_iter', p_iter from trials),
  bv as (select experiment_id, model_idx, model, param, v, avg(f1) as m from e group by all),
  sens as (select experiment_id, model_idx, model, param, stddev_pop(m) as s from bv
    group by 1, 2, 3, 4 having count(*) > 1)"""
_JUDGED = "j as (select l.*, lang from labels l join documents d on d.doc_id = l.doc_id)"
_CLASSES = f"""{_JUDGED}, c as (select lang, quality as a, toxic as p, count(*) as n from j group by all),
  k as (select lang, a as label from c union select lang, p from c),
  s as (select k.lang, label, coalesce(sum(n) filter (a = label), 0)::bigint as support,
    coalesce(sum(n) filter (p = label), 0)::bigint as predicted,
    coalesce(sum(n) filter (a = label and p = label), 0)::bigint as hits
    from k join c on c.lang = k.lang group by 1, 2),
  pc as (select *, case when predicted > 0 then hits / predicted else 0 end as precision,
    case when support > 0 then hits / support else 0 end as recall,
    case when support + predicted > 0 then 2 * hits / (support + predicted) else 0 end as f1 from s)"""

_CELLS = """select l_linenumber, round(l_discount * 100)::bigint as percent, count(*) as rows,
  min({0})::bigint as least, max({0})::bigint as most from lineitem group by 1, 2"""

ORACLES = {
    "g2_logistic_regression": _CELLS.format(SIDE),
    "g4_decision_tree": _CELLS.format(RULE),
    "g5_random_forest": _CELLS.format(RULE),
    "g6_predict": _CELLS.format(RULE),
    "g13_grid_search": f"""with {GRID_SQL}, told as (
        select avg((({GROUP}) = case when c_nationkey + case when c_nationkey >= 13 then 100 else 0 end > 60
          then 'east' else 'west' end)::int)::double as f1 from customer)
      select model, combo_idx, params, f1, 5::bigint as holdouts, null::varchar as error from g, told""",
    "g13_noisy_grid": f"""with {GRID_SQL}, v as (
        select c_custkey as id, {NOISY} as label,
          (c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over () as x,
          (c_nationkey - avg(c_nationkey) over ()) / stddev_pop(c_nationkey) over () as y from customer),
      h as (select i, v.*, row_number() over (partition by i, label order by md5(concat(id, '-', 42 + i)), id)
          <= round_even(count(*) over (partition by i, label) * 0.2::double, 0) as held from v, range(5) r(i)),
      st as (select i, label, count(*) as n, avg(x) as mx, avg(y) as my, var_pop(x) as vx, var_pop(y) as vy
        from h where not held group by all),
      whole as (select i, count(*) as n, greatest(var_pop(x), var_pop(y)) as most from h where not held group by i),
      sc as (select s.e, h.i, h.id, h.label as actual, st.label as c, ln(st.n / w.n)
          - 0.5 * (ln(2 * pi() * (vx + e * most)) + ln(2 * pi() * (vy + e * most)))
          - 0.5 * ((x - mx) * (x - mx) / (vx + e * most) + (y - my) * (y - my) / (vy + e * most)) as score
        from h join st on st.i = h.i join whole w on w.i = h.i,
          (values (1e-9::double), (1e-8::double), (1e-7::double)) s(e) where held),
      p as (select e, i, actual, c from sc qualify row_number() over (partition by e, i, id order by score desc, c) = 1),
      k as (select e, i, l, count(*) filter (actual = l) as support, count(*) filter (c = l) as guessed,
        count(*) filter (actual = l and c = l) as hits from p, (values ('p'), ('q')) t(l) group by all),
      f as (select e, i, sum(support * case when support + guessed > 0 then 2 * hits / (support + guessed) else 0 end)
        / sum(support) as f1 from k group by all),
      m as (select row_number() over (order by e) as combo_idx, round(avg(f1), 6) as f1 from f group by e)
      select g.model, g.combo_idx, m.f1, 5::bigint as holdouts, true as in_bounds,
        g.model in ('Decision Tree', 'Random Forest') as limits_matter
      from g left join m on g.model = 'Naive Bayes' and m.combo_idx = g.combo_idx""",
    "g3_gaussian_nb": f"""with v as (select vec_id, label,
        embedding[1:{DIMS}]::double[] as x,
        row_number() over (partition by label order by md5(concat(vec_id, '-', 42)), vec_id)
          <= round_even(count(*) over (partition by label) * 0.2::double, 0) as held from embeddings),
      d as (select vec_id, label, held, unnest(range(1, {DIMS + 1})) as i, unnest(x) as x from v),
      eps as (select {SMOOTHING}::double * max(s) as e from (select var_pop(x) as s from d where not held group by i)),
      st as (select label, i, avg(x) as mu, var_pop(x) + any_value(e) as s2, count(*) as n
        from d, eps where not held group by label, i),
      pri as (select label, ln(max(n)::double / (select count(*) from v where not held)) as lp from st group by 1),
      sc as (select d.vec_id, d.label, st.label as c, any_value(lp)
          - 0.5 * sum(ln(2 * pi() * s2)) - 0.5 * sum((x - mu) * (x - mu) / s2) as score
        from d join st on st.i = d.i join pri on pri.label = st.label where held group by 1, 2, 3)
      select vec_id, label as label_idx, c::bigint as prediction from sc
      qualify row_number() over (partition by vec_id order by score desc, c) = 1""",
    "g7_weighted_f1": f"""with {_CLASSES} select lang, round(sum(support * f1) / sum(support), 6) as f1
      from pc group by 1""",
    "g8_confusion_matrix": f"""with {_JUDGED} select lang, quality as actual, toxic as predicted,
      count(*) as n from j group by all""",
    "g8_per_class_scores": f"""with {_CLASSES} select lang, label, support, predicted,
      round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1 from pc""",
    "g9_mean_score": f"""with {RUNS} select experiment_id, model, combo_idx, round(avg(f1), 6) as f1,
      count(*) as holdouts from runs group by all""",
    "g10_best_per_model": f"""with {TRIALS}, {BEST} select experiment_id, model, combo_idx,
      {_PARAMS} as params, round(f1_score, 6) as f1_score from best""",
    "g11_running_best": f"""with {TRIALS} select experiment_id, model, combo_idx, round(max(f1) over (
      partition by experiment_id, model order by combo_idx), 6) as best_so_far from trials""",
    "g12_failed_trials": f"""with {TRIALS}, {GRID_SQL} select s_suppkey as experiment_id, g.model, g.combo_idx,
      round(coalesce(f1, 0), 6) as f1, case when f1 is null then 'no score' end as error
      from supplier cross join g left join trials t on t.experiment_id = s_suppkey
        and t.model = g.model and t.combo_idx = g.combo_idx""",
    "h1_score_progression": f"""with {TRIALS}, r as (select *,
        row_number() over (partition by experiment_id, model order by combo_idx) as position,
        row_number() over (partition by experiment_id, model order by f1 desc, combo_idx) as rk from trials)
      select experiment_id, model, combo_idx, position, round(f1, 6) as f1, rk = 1 as is_best from r""",
    "h2_compare_models": f"""with {TRIALS}, {BEST} select experiment_id, model, round(f1_score, 6) as f1_score,
      round(avg(f1_score) over (partition by experiment_id), 6) as mean_f1 from best""",
    "h3_stability": f"""with {TRIALS} select experiment_id, model, round({_STABLE}, 6) as stability
      from trials group by 1, 2""",
    "h4_simplicity": f"with {TRIALS}, {BEST} select experiment_id, model, 0.75::double as simplicity from best",
    "h5_model_profile": f"""with {TRIALS}, {BEST},
      st as (select experiment_id, model, {_STABLE} as stability from trials group by 1, 2)
      select experiment_id, model, round(f1_score, 6) as f1_score, round(stability, 6) as stability,
        0.75::double as simplicity, {_SPEED} as speed from best join st using (experiment_id, model)""",
    "h6_param_sensitivity": f"""with {_SENSITIVITY} select experiment_id, model, param,
      round(s, 6) as sensitivity, {_TIER} as tier from sens""",
    "h6_last_model_wins": f"""with {_SENSITIVITY} select experiment_id, param, model,
      round(s, 6) as sensitivity, {_TIER} as tier from sens
      qualify row_number() over (partition by experiment_id, param order by model_idx desc) = 1""",
    "h7_score_vs_complexity": f"""with {TRIALS} select experiment_id, model, combo_idx,
      2::bigint as n_params, round(f1, 6) as f1, row_number() over (
        partition by experiment_id, model order by f1 desc, combo_idx) = 1 as is_best from trials""",
    "h8_rank_configs": f"""with {TRIALS}, {BEST}, p as (select *, row_number() over (
        partition by experiment_id order by f1_score desc, model) as place from best)
      select experiment_id, place, model, round(f1_score, 6) as f1_score, 'C' as param, p_c::varchar as value from p
      union all select experiment_id, place, model, round(f1_score, 6), 'max_iter', p_iter::varchar from p""",
    "h9_results_summary": f"""with {TRIALS} select experiment_id, count(distinct model) as n_models,
      count(*) as n_combos, round(max(f1), 6) as best_score from trials group by 1""",
}

ORACLES["s3_models_by_name"] = ORACLES["g10_best_per_model"]
ORACLES["s4_models_by_score"] = ORACLES["h2_compare_models"]
ORACLES["s5_first_best"] = ORACLES["g10_best_per_model"]
