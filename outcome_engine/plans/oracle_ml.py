"""DuckDB SQL for the modelling half (features, selection, split, metrics, scoring, report)."""

from __future__ import annotations

from . import oracle_values as C
from .oracle_sql import _any_substring, _q, bucket_sql, labels_values, pct, ratio, top_k_sql, with_base, pearson_sql

CUR_YEAR = C.CURRENT_YEAR
WINSORIZED = C.WINSORIZED
INT_FEATURES = ("has_funding", "has_location", "has_homepage", "is_tech_startup", "tier1_country", "emerging_market",
                "founded_in_recession", "market_density", "high_risk_profile", "low_risk_profile")
CANDS = list(C.CANDIDATE_FEATURES)


def clip(x: str, lo=None, hi=None) -> str:
    out = x
    if lo is not None:
        out = f"(case when {out} < {lo} then {lo} else {out} end)"
    if hi is not None:
        out = f"(case when {out} > {hi} then {hi} else {out} end)"
    return out


def sd(num: str, den: str, default: str = "0.0") -> str:
    return clip(f"(case when ({den}) is null or ({den}) = 0 then {default} else ({num})::double / ({den})::double end)",
                "-10000000000.0", "10000000000.0")


def safe_log(x: str) -> str:
    return clip(f"log10({clip(x, '1e-10')})", "-10.0", "10.0")


def feature_ctes(rows: str, fit: str, p: str) -> list[str]:
    """CTEs ending in ``{p}feat``: features of ``rows`` with statistics fitted on ``fit``."""
    years = ", ".join(f"{y}.0" for y in C.RECESSION_YEARS)

    def stage_a(src: str, name: str) -> list[str]:
        return [
            f"{name}0 as (select {src}.* exclude (company_age_years, is_tech_startup, founded_in_recession), "
            f"coalesce(funding_total_usd, f_med, 0.0) as funding_total_usd_filled, "
            f"coalesce(funding_per_round, fpr_med, 0.0) as funding_per_round_filled, "
            f"{clip('coalesce(company_age_years, 0.0)', '0', str(C.MAX_AGE_YEARS))} as company_age_years, "
            f"{clip('coalesce(cast(year(founded_at) as double), coalesce(year_med, 2010.0))', '1990', str(CUR_YEAR))} "
            "as founded_year_filled, "
            f"{clip('coalesce(cast(days_to_first_funding as double), coalesce(days_med, 365.0))', '0', '3650')} "
            "as days_to_first_funding_filled, "
            "case when max_cc is null or max_cc = 0 then 1 else max_cc end as _mcc from " + src + f", {p}fs)",
            f"{name} as (select {name}0.* exclude (_mcc), {safe_log('funding_total_usd_filled + 1')} as funding_log, "
            f"{sd('funding_total_usd_filled', 'company_age_years + 1')} as funding_intensity, "
            f"{sd('funding_total_usd_filled', clip('company_age_years', '0.1'))} as funding_velocity, "
            "cast(floor(founded_year_filled / 10) * 10 as double) as founded_decade, "
            f"{sd('1.0', 'days_to_first_funding_filled + 1')} as funding_speed_score, "
            f"cast(coalesce(founded_year_filled in ({years}), false) as integer) as founded_in_recession, "
            f"{_any_substring('category_list', C.TECH_KEYWORDS_MODEL)} as is_tech_startup, "
            f"{sd('category_count', '_mcc')} as category_diversity from {name}0)",
        ]

    def stage_b(src: str, name: str) -> list[str]:
        return [
            f"{name}0 as (select s.*, cast({clip('coalesce(d._density, 1)', '1', '1000')} as bigint) as market_density, "
            f"cast({clip('coalesce(cr._cat_rate, 0.1)', '0', '1')} as double) as category_success_rate, "
            f"cast({clip('coalesce(yr._cty_rate, 0.1)', '0', '1')} as double) as country_success_rate, r._p90 "
            f"from {src} s left join {p}dens d on d.primary_category = s.primary_category "
            "and d.founded_year_filled = s.founded_year_filled "
            f"left join {p}crate cr on cr.primary_category = s.primary_category "
            f"left join {p}yrate yr on yr.country_code = s.country_code cross join {p}risk r)",
            f"{name} as (select {name}0.* exclude (_p90), funding_log * tier1_country as funding_country_interaction, "
            "is_tech_startup * funding_log as tech_funding_interaction, "
            "company_age_years * funding_log as age_funding_interaction, "
            "cast(coalesce(funding_total_usd_filled > _p90 and founded_in_recession = 1, false) as integer) "
            "as high_risk_profile, "
            "cast(coalesce(tier1_country = 1 and category_success_rate > 0.2 and has_funding = 1, false) as integer) "
            f"as low_risk_profile from {name}0)",
        ]

    ws = ", ".join(f"quantile_cont({c}, 0.01) as {c}__lo, quantile_cont({c}, 0.5) as {c}__med, "
                   f"quantile_cont({c}, 0.99) as {c}__hi" for c in WINSORIZED)
    repl = ", ".join(
        f"coalesce(case when {c}__lo is not null and {c}__hi is not null then {clip(c, f'{c}__lo', f'{c}__hi')} "
        f"else {c} end, case when {c}__lo is not null and {c}__hi is not null then "
        f"{clip(f'{c}__med', f'{c}__lo', f'{c}__hi')} else {c}__med end, 0.0)::double as {c}" for c in WINSORIZED)
    drop = ", ".join(f"{c}__lo, {c}__med, {c}__hi" for c in WINSORIZED)
    return [
        f"{p}fs as (select quantile_cont(funding_total_usd, 0.5) as f_med, quantile_cont(funding_per_round, 0.5) as fpr_med, "
        "quantile_cont(year(founded_at), 0.5) as year_med, quantile_cont(days_to_first_funding, 0.5) as days_med, "
        f"max(category_count) as max_cc from {fit})",
        *stage_a(fit, f"{p}fa"),
        f"{p}dens as (select primary_category, founded_year_filled, count(*) as _density from {p}fa "
        "where primary_category is not null and founded_year_filled is not null group by 1, 2)",
        f"{p}crate as (select primary_category, avg(target) as _cat_rate from {p}fa where primary_category is not null "
        "group by 1)",
        f"{p}yrate as (select country_code, avg(target) as _cty_rate from {p}fa where country_code is not null group by 1)",
        f"{p}risk as (select coalesce(quantile_cont(funding_total_usd_filled, 0.9), max(funding_total_usd_filled)) "
        f"as _p90 from {p}fa)",
        *stage_b(f"{p}fa", f"{p}fb"),
        f"{p}ws as (select {ws} from {p}fb)",
        *stage_a(rows, f"{p}xa"),
        *stage_b(f"{p}xa", f"{p}xb"),
        f"{p}feat as (select * exclude ({drop}) replace ({repl}) from {p}xb, {p}ws)",
    ]


TRAIN = ("c as (select *, cast(status in ('acquired', 'ipo') as integer) as target from ventures "
         "where status in ('acquired', 'ipo', 'closed'))")
OPERATING = "op as (select * from ventures where status = 'operating')"
TRAIN_FEAT = [TRAIN, *feature_ctes("c", "c", "t_")]
OP_FEAT = [TRAIN, OPERATING, *feature_ctes("op", "c", "o_")]


def _feat_select(src: str) -> str:
    cols = ", ".join(c if c in INT_FEATURES else f"round({c}, 6) as {c}" for c in CANDS)
    return f"select venture_id, target, {cols} from {src}"


def _prepared_ctes() -> list[str]:
    q = ", ".join(f"quantile_cont({f}::double, 0.01) as {f}__lo, quantile_cont({f}::double, 0.5) as {f}__med, "
                  f"quantile_cont({f}::double, 0.99) as {f}__hi" for f in CANDS)
    cols = []
    for f in CANDS:
        ok = f"{f}__lo is not null and {f}__hi is not null and {f}__hi > {f}__lo"
        cols.append(f"coalesce(case when {ok} then {clip(f + '::double', f'{f}__lo', f'{f}__hi')} else {f}::double end, "
                    f"case when {ok} then {clip(f'{f}__med', f'{f}__lo', f'{f}__hi')} else {f}__med end, 0.0) as {f}")
    return [*TRAIN_FEAT, f"sq as (select {q} from t_feat)",
            f"prep as (select venture_id, target, {', '.join(cols)} from t_feat, sq)"]


def _corr_sql() -> str:
    parts = [f"select '{f}' as feature, {i} as position, {pearson_sql(f, 'target')} as c from prep"
             for i, f in enumerate(CANDS)]
    return with_base(
        "select feature, round(c, 6) as corr, round(abs(round(c, 12)), 6) as abs_corr, cast(position as integer) as position, "
        "cast(row_number() over (order by abs(round(c, 12)) desc, position) as integer) as rank "
        f"from ({' union all '.join(parts)}) where c is not null", *_prepared_ctes())


def _variance_sql() -> str:
    parts = [f"select '{f}' as feature, var_pop({f}) as v from prep" for f in CANDS]
    e = "(case when v > 0 then cast(floor(log10(v)) as integer) else 0 end)"
    return with_base(
        f"select feature, round(case when {e} >= 0 then v / pow(10.0, {e}) else v * pow(10.0, -{e}) end, 6) "
        f"as variance_mantissa, {e} as variance_exponent, cast(v > {C.VARIANCE_THRESHOLD} as integer) as selected "
        f"from ({' union all '.join(parts)})", *_prepared_ctes())


def _split_sql() -> str:
    k = "floor(n * 0.2::double + 0.5::double)"
    return with_base(
        f"select venture_id, target, cast(rk <= {k} as integer) as is_test, "
        f"case when rk > {k} then cast((rk - {k} - 1) % 5 as integer) end as fold from "
        "(select venture_id, target, row_number() over (partition by target order by "
        f"md5(concat('{C.SEED}', '-', cast(venture_id as varchar)))) as rk, "
        "count(*) over (partition by target) as n from t_feat)", *TRAIN_FEAT)


def _scaler_sql() -> str:
    parts = [f"select '{f}' as feature, quantile_cont({f}, 0.5) as center, "
             f"case when abs(quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25)) < 1e-12 then 1.0 "
             f"else quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) end as scale from t_feat" for f in CANDS]
    return with_base(f"select feature, round(center, 6) as center, round(scale, 6) as scale from "
                     f"({' union all '.join(parts)})", *TRAIN_FEAT)


def _score(src: str) -> str:
    s = ("0.5::double * category_success_rate + 0.3::double * country_success_rate "
         "+ 0.2::double * funding_log / 10.0::double")
    return f"round({clip(s, '0.0', '1.0')}, 4)"


PRED = [*TRAIN_FEAT,
        f"pr as (select 'baseline' as model, venture_id, target as label, {_score('t_feat')} as score from t_feat)",
        "pr2 as (select *, cast(score > 0.5 as integer) as pred from pr)",
        "sc as (select model, score, cast(count_if(label = 1) as bigint) as pos, cast(count_if(label <> 1) as bigint) as neg "
        "from pr2 group by model, score)",
        "cum as (select *, cast(coalesce(sum(pos) over (partition by model order by score rows between unbounded preceding "
        "and 1 preceding), 0) as bigint) as pos_before, cast(coalesce(sum(neg) over (partition by model order by score "
        "rows between unbounded preceding and 1 preceding), 0) as bigint) as neg_before, "
        "cast(sum(pos) over (partition by model) as bigint) as P, cast(sum(neg) over (partition by model) as bigint) as N "
        "from sc)"]

AUC_SELECT = ("select model, max(P) as n_pos, max(N) as n_neg, "
              "sum(pos * (neg_before + 0.5::double * neg)) / (max(P) * max(N)) as auc, "
              "round(sum((pos::double / P) * ((P - pos_before)::double / ((P - pos_before) + (N - neg_before)))), 9) "
              "as average_precision from cum group by model")

SUMMARY_SELECT = (
    "select s.*, a.auc, a.average_precision from (select model, count(*) as n, "
    "cast(count_if(label = 1 and pred = 1) as bigint) as tp, cast(count_if(label = 0 and pred = 1) as bigint) as fp, "
    "cast(count_if(label = 1 and pred = 0) as bigint) as fn, "
    f"{ratio('count_if(label = pred)', 'count(*)')} as accuracy, "
    f"coalesce({ratio('count_if(label = 1 and pred = 1)', 'count_if(pred = 1)')}, 0.0) as precision, "
    f"coalesce({ratio('count_if(label = 1 and pred = 1)', 'count_if(label = 1)')}, 0.0) as recall, "
    f"coalesce({ratio('2 * count_if(label = 1 and pred = 1)', '2 * count_if(label = 1 and pred = 1) + count_if(label = 0 and pred = 1) + count_if(label = 1 and pred = 0)')}, 0.0) as f1 "
    f"from pr2 group by model) s join ({AUC_SELECT}) a using (model)")

OP_SCORED = [*OP_FEAT, f"osc as (select *, {_score('o_feat')} as success_probability from o_feat)",
             "os as (select *, cast(success_probability > 0.5 as integer) as predicted_success, "
             f"{bucket_sql('success_probability', C.CONFIDENCE_BUCKETS)} as confidence_category from osc)"]

CONC = "status in ('acquired', 'ipo', 'closed')"
WON = "status in ('acquired', 'ipo')"
OPP = (f"(select t.primary_category, cast(t.rank as integer) as rank, t.n as competition, r.nc as n_concluded, "
       f"{pct('r.ns', 'r.nc')} as success_rate from ({top_k_sql('(select primary_category, count(*) as n from ventures group by 1)', 'n', 'primary_category', 20)}) t "
       f"join (select primary_category, count(*) as nc, cast(count_if({WON}) as bigint) as ns from ventures where {CONC} "
       f"group by 1) r on t.primary_category = r.primary_category where r.nc > {C.MIN_OPPORTUNITY_CONCLUDED})")
QUAD = ("(select quantile_cont(competition, 0.5) as median_competition, quantile_cont(success_rate, 0.5) as "
        f"median_success_rate from {OPP})")
HIGH_OPP = top_k_sql(f"(select o.primary_category, o.success_rate, o.competition from {OPP} o, {QUAD} q "
                     "where o.success_rate > q.median_success_rate and o.competition < q.median_competition)",
                     "success_rate", "primary_category", 5)
GEO = (f"select * from ({top_k_sql(f'(select country_code, count(*) as n, cast(count_if({WON}) as bigint) as n_success, {pct(f"count_if({WON})", "count(*)")} as success_rate from ventures where {CONC} and country_code is not null group by 1)', 'success_rate', 'country_code', 5)}) "
       f"where n > {C.MIN_REPORT_COUNTRY}")
KEY = (f"select count(*) as n_total, cast(count_if({CONC}) as bigint) as n_concluded, "
       f"{pct(f'count_if({CONC} and {WON})', f'count_if({CONC})')} as success_rate, "
       "count(distinct country_code) as n_countries, count(distinct primary_category) as n_categories from ventures")
RISK = (f"select count(*) as n_failed, {pct('count_if(has_funding = 0)', 'count(*)')} as pct_no_funding, "
        f"{pct('count_if(has_location = 0)', 'count(*)')} as pct_no_location, "
        f"{pct('count_if(category_count = 1)', 'count(*)')} as pct_single_category, "
        f"{pct('count_if(has_homepage = 0)', 'count(*)')} as pct_no_website, "
        "round(avg(company_age_years), 4) as mean_age_at_failure from ventures where status = 'closed'")
_W = pct(f"count_if(has_funding = 1 and {WON})", "count_if(has_funding = 1)")
_WO = pct(f"count_if(has_funding = 0 and {WON})", "count_if(has_funding = 0)")
FUNDING = (f"select round(avg(case when {WON} then funding_total_usd end), 2) as mean_funding_success, "
           "round(avg(case when status = 'closed' then funding_total_usd end), 2) as mean_funding_failed, "
           f"{_W} as rate_with_funding, {_WO} as rate_without_funding, round(({_W}) - ({_WO}), 6) as funded_lift_pp "
           f"from ventures where {CONC}")
TIMING = ("select quantile_cont(company_age_years, 0.5) as median_age_at_success, "
          f"{pct('count_if(company_age_years < 2)', 'count(*)')} as pct_early_exit, "
          f"{pct('count_if(company_age_years > 10)', 'count(*)')} as pct_late_exit from ventures where {CONC} and {WON}")
_TR = pct(f"count_if(is_tech_startup = 1 and {WON})", "count_if(is_tech_startup = 1)")
TECH = (f"select cast(count_if(is_tech_startup = 1) as bigint) as n_tech_concluded, {_TR} as tech_success_rate, "
        f"round(({_TR}) - ({pct(f'count_if({WON})', 'count(*)')}), 6) as tech_vs_overall_pp from ventures where {CONC}")


def _lines(sql: str, section: str, metrics: list[str]) -> str:
    return " union all ".join(f"select '{section}' as section, '{m}' as metric, round(cast({m} as double), 6) as value "
                              f"from ({sql})" for m in metrics)


REPORT = " union all ".join([
    _lines(KEY, "key_statistics", ["n_total", "n_concluded", "success_rate", "n_countries", "n_categories"]),
    _lines(RISK, "risk_factors", ["pct_no_funding", "pct_no_location", "pct_single_category", "pct_no_website",
                                  "mean_age_at_failure"]),
    _lines(FUNDING, "funding", ["mean_funding_success", "mean_funding_failed", "rate_with_funding",
                                "rate_without_funding", "funded_lift_pp"]),
    _lines(TIMING, "timing", ["median_age_at_success", "pct_early_exit", "pct_late_exit"]),
    _lines(TECH, "technology", ["n_tech_concluded", "tech_success_rate", "tech_vs_overall_pp"]),
    f"select 'geography' as section, country_code as metric, round(success_rate, 6) as value from ({GEO})",
    f"select 'high_opportunity' as section, primary_category as metric, round(success_rate, 6) as value from ({HIGH_OPP})",
])

EXIT_TIMING = (
    f"select l.age_group, cast(l.bucket_order as integer) as bucket_order, coalesce(a.n, 0) as n, coalesce(a.ns, 0) as n_success, "
    f"{pct('coalesce(a.ns, 0)', 'coalesce(a.n, 0)')} as success_rate from {labels_values(C.AGE_GROUPS_EXIT[1], 'age_group')} l "
    f"left join (select {bucket_sql('company_age_years', C.AGE_GROUPS_EXIT)} as age_group, count(*) as n, "
    f"cast(count_if({WON}) as bigint) as ns from ventures where {CONC} and company_age_years is not null "
    "and company_age_years > 0 and company_age_years < 20 group by 1) a on l.age_group = a.age_group")

PRED_COLS = ("name, primary_category, country_code, funding_total_usd, company_age_years, predicted_success, "
             "success_probability, confidence_category")

# The families by their names in the results, written out here on purpose.
MODEL_NAMES = ("Random Forest", "XGBoost (GBT preset)", "LightGBM (GBT preset)", "CatBoost (GBT preset)", "Gradient Boosting",
               "Extra Trees (RF preset)", "Logistic Regression", "Ensemble")
_TEST_ROWS = ("(select target as label, count(*) as n from (select target, row_number() over (partition by target order by "
              "md5(concat('42-', cast(venture_id as varchar)))) as rk, count(*) over (partition by target) as size from t_feat) "
              "where rk <= floor(size * 0.2::double + 0.5::double) group by 1)")
INVARIANTS = ("ensemble is the mean of its members", "best model has the largest AUC", "AUC equals the evaluator's area",
              "seven families and the ensemble")

IMPUTED = ("funding_total_usd", "funding_rounds", "funding_per_round", "company_age_years", "days_to_first_funding",
           "funding_duration_days", "category_count")


def _knn_sql() -> str:
    """All pairs of a row with nulls and a concluded one; the nearest five per column, ties to the smaller id."""
    n = len(IMPUTED)
    cells = ", ".join(f"{c}::double as {c}" for c in IMPUTED)
    both = " + ".join(f"cast(r.{c} is not null and d.{c} is not null as integer)" for c in IMPUTED)
    squares = " + ".join(f"coalesce((r.{c} - d.{c}) * (r.{c} - d.{c}), 0.0::double)" for c in IMPUTED)
    mean = "(" + " + ".join(f"coalesce(max(case when k = {j} then v end), 0.0::double)" for j in range(1, 6)) + ") / count(*)::double"
    near = [f"n_{c} as (select rid, {mean} as v from (select rid, d_{c} as v, row_number() over (partition by rid order by dist, did) as k "
            f"from pairs where r_{c} is null and d_{c} is not null) where k <= 5 group by rid)" for c in IMPUTED]
    filled = ", ".join(f"round(coalesce(a.{c}, n_{c}.v, m.{c}), 6) as {c}" for c in IMPUTED)
    joins = " ".join(f"left join n_{c} on n_{c}.rid = a.venture_id" for c in IMPUTED)
    return with_base(
        f"select a.venture_id, {filled} from everyone a cross join means m {joins}",
        f"everyone as (select venture_id, {cells} from ventures)",
        f"donors as (select venture_id, {cells} from ventures where {CONC})",
        f"means as (select {', '.join(f'avg({c}) as {c}' for c in IMPUTED)} from donors)",
        f"pairs as (select r.venture_id as rid, d.venture_id as did, {', '.join(f'r.{c} as r_{c}, d.{c} as d_{c}' for c in IMPUTED)}, "
        f"({squares}) * {n}.0::double / ({both}) as dist from everyone r join donors d on ({both}) > 0 "
        f"where {' or '.join(f'r.{c} is null' for c in IMPUTED)})", *near)


def _oof_sql() -> str:
    """The definition: the mean over the other training rows of the key, by self-join on the key."""
    def rate(key: str, other: str) -> str:
        return (f"round({clip(f'coalesce((select avg(t.target::double) from rows t where t.fold is not null and t.{key} = r.{key} and {other}), 0.1)', '0.0', '1.0')}, 6)")

    out_of_fold, but_one = "(r.fold is null or t.fold <> r.fold)", "t.venture_id <> r.venture_id"
    k = "floor(n * 0.2::double + 0.5::double)"
    return with_base(
        f"select venture_id, fold, {rate('primary_category', out_of_fold)} as category_oof, {rate('primary_category', but_one)} as category_loo, "
        f"{rate('country_code', out_of_fold)} as country_oof, {rate('country_code', but_one)} as country_loo from rows r",
        *TRAIN_FEAT,
        f"rows as (select venture_id, primary_category, country_code, target, case when rk > {k} then cast((rk - {k} - 1) % 5 as integer) end as fold from "
        "(select *, row_number() over (partition by target order by "
        f"md5(concat('{C.SEED}', '-', cast(venture_id as varchar)))) as rk, count(*) over (partition by target) as n from t_feat))")


ML_SQL: dict[str, str] = {
    "mdl_confusion_totals": with_base(
        f"select m.model, t.label, cast(t.n as bigint) as n from (values {', '.join(f"('{n}')" for n in MODEL_NAMES)}) m(model), {_TEST_ROWS} t",
        *TRAIN_FEAT),
    "mdl_invariants": "select invariant, 1 as holds from (values " + ", ".join(f"({_q(x)})" for x in INVARIANTS) + ") v(invariant)",
    "sco_model_rows": with_base("select venture_id, name, primary_category, country_code, funding_total_usd, company_age_years from o_feat", *OP_FEAT),
    "fea_features": with_base(_feat_select("t_feat"), *TRAIN_FEAT),
    "fea_oof": _oof_sql(),
    "fea_extra": with_base("select venture_id, round(funding_total_usd_filled / (company_age_years + 1), 6) as funding_per_year, "
                           "has_homepage * has_location as web_and_place from t_feat", *TRAIN_FEAT),
    "sel_correlation": _corr_sql(),
    "sel_variance": _variance_sql(),
    "prp_split": _split_sql(),
    "prp_scaler": _scaler_sql(),
    "prp_knn": _knn_sql(),
    "met_auc": with_base(AUC_SELECT, *PRED),
    "met_roc_curve": with_base("select model, score as threshold, P - pos_before as tps, N - neg_before as fps, "
                               f"{ratio('N - neg_before', 'N')} as fpr, {ratio('P - pos_before', 'P')} as tpr from cum",
                               *PRED),
    "met_pr_curve": with_base("select model, score as threshold, "
                              f"{ratio('P - pos_before', '(P - pos_before) + (N - neg_before)')} as precision, "
                              f"{ratio('P - pos_before', 'P')} as recall from cum", *PRED),
    "met_confusion": with_base(
        "select m.model, c.label, c.pred, cast(count_if(p.label = c.label and p.pred = c.pred) as bigint) as n "
        "from (select distinct model from pr2) m cross join (values (0, 0), (0, 1), (1, 0), (1, 1)) c(label, pred) "
        "join pr2 p on p.model = m.model group by m.model, c.label, c.pred", *PRED),
    "met_summary": with_base(SUMMARY_SELECT, *PRED),
    "sco_summary": with_base(
        "select count(*) as n_scored, cast(sum(predicted_success) as bigint) as n_predicted_success, "
        f"{pct('sum(predicted_success)', 'count(*)')} as pct_predicted_success, "
        "round(avg(success_probability), 6) as mean_probability from os", *OP_SCORED),
    "sco_confidence": with_base(
        f"select confidence_category, count(*) as n, {pct('count(*)', 'max(t.total)')} as pct from os, "
        "(select count(*) as total from os) t where confidence_category is not null group by confidence_category",
        *OP_SCORED),
    "sco_top_promising": with_base(top_k_sql(
        "(select venture_id, name, primary_category, country_code, funding_total_usd, company_age_years, "
        "success_probability, confidence_category from os)", "success_probability", "venture_id", 20), *OP_SCORED),
    "sco_category_rollup": with_base(top_k_sql(
        "(select primary_category, count(*) as \"Total\", cast(sum(predicted_success) as bigint) as \"Predicted_Success\", "
        f"round({ratio('sum(predicted_success)', 'count(*)')}, 3) as \"Success_Rate\", "
        "round(avg(success_probability), 3) as \"Avg_Probability\" from os group by primary_category "
        f"having count(*) >= {C.MIN_SCORED_CATEGORY})", '"Avg_Probability"', "primary_category", 15), *OP_SCORED),
    "sco_predictions": with_base(f"select venture_id, {PRED_COLS} from os", *OP_SCORED),
    "ins_key_stats": with_base(KEY),
    "ins_risk_factors": with_base(RISK),
    "ins_opportunity": with_base(f"select * from {OPP}"),
    "ins_quadrants": with_base(f"select * from {QUAD}"),
    "ins_high_opportunity": with_base(HIGH_OPP),
    "ins_exit_timing": with_base(EXIT_TIMING),
    "ins_geography": with_base(GEO),
    "ins_funding": with_base(FUNDING),
    "ins_timing": with_base(TIMING),
    "ins_tech": with_base(TECH),
    "ins_report": with_base(REPORT),
}
