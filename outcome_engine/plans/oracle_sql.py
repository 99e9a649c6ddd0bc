"""Independent SQL (DuckDB dialect) for every registered query.

The driver runs these next to the Spark plans on the same parquet tables.  The
first CTEs rebuild the venture fixture and the cleaned table in plain SQL; each
query then adds its own SELECT.  Nothing here is executed by the engine.
"""

from __future__ import annotations

from ..sources.fixture import VENTURES_RAW_SQL
from . import oracle_values as C

WS = r"'^\s+|\s+$'"
AS_OF = C.AS_OF


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(e: str) -> str:
    return f"regexp_replace({e}, {WS}, '', 'g')"


def _clean_text(e: str) -> str:
    return f"nullif({_strip(e)}, 'nan')"


def _title(e: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({e}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
            f"lambda r: upper(r[1]) || lower(r[2:])), '')")


def _fixes(e: str) -> str:
    for old, new in C.CATEGORY_FIXES:
        e = f"replace({e}, {_q(old)}, {_q(new)})"
    return e


def _clean_categories(e: str) -> str:
    item = _fixes(_title(f"regexp_replace({_strip('x')}, '\\s+', ' ', 'g')"))
    return (f"nullif(array_to_string(list_filter(list_transform(string_split({e}, '|'), lambda x: {item}), "
            f"lambda y: y <> ''), '|'), '')")


def _in(e: str, values) -> str:
    return f"coalesce({e} in ({', '.join(_q(v) if isinstance(v, str) else str(v) for v in values)}), false)"


def _any_substring(e: str, words) -> str:
    return "cast(coalesce(" + " or ".join(f"contains({e}, {_q(w)})" for w in words) + ", false) as integer)"


def bucket_sql(e: str, bucket_def) -> str:
    edges, labels, lowest = bucket_def
    parts = []
    for i, lab in enumerate(labels):
        lo, hi = edges[i], edges[i + 1]
        lower = f"{e} >= {lo}" if (lowest and i == 0) else f"{e} > {lo}"
        upper = "true" if hi == float("inf") else f"{e} <= {hi}"
        parts.append(f"when {lower} and {upper} then {_q(lab)}")
    return "case " + " ".join(parts) + " end"


def bucket_order_sql(e: str, labels) -> str:
    return "case " + " ".join(f"when {e} = {_q(lab)} then {i}" for i, lab in enumerate(labels)) + " end"


def pct(num: str, den: str) -> str:
    """100*num/den from integer counts; 0/0 -> null."""
    return f"case when ({den}) = 0 then null else (100.0::double * ({num})) / ({den}) end"


def ratio(num: str, den: str) -> str:
    return f"case when ({den}) = 0 then null else ({num})::double / ({den}) end"


_DOMAIN = ("case when homepage_url is null then 'No Website' "
           + " ".join(f"when contains(lower(homepage_url), {_q(n)}) then {_q(lbl)}" for n, lbl in C.DOMAIN_RULES)
           + " else 'Other' end")

_NUM = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"


def _to_number(e: str) -> str:
    s = _strip(f"cast({e} as varchar)")
    return f"case when regexp_full_match({s}, {_NUM}) then try_cast({s} as double) end"


def _to_date(e: str) -> str:
    s = _strip(e)
    return (f"coalesce(try_strptime({s}, '%Y-%m-%d'), try_strptime({s}, '%Y/%m/%d'), "
            f"try_strptime({s}, '%m/%d/%Y'), try_strptime({s}, '%Y-%m-%d %H:%M:%S'), "
            f"try_strptime({s}, '%Y-%m-%dT%H:%M:%S'), try_strptime({s}, '%d-%b-%Y'), try_strptime({s}, '%Y%m%d'), try_strptime({s}, '%Y-%m'))::date")


# Missing-value texts, written out here and not taken from the engine.
_NA = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', "
       "'None', 'n/a', 'nan', 'null'")
_TEXT_COLUMNS = ("name", "homepage_url", "category_list", "funding_total_usd", "status", "country_code", "state_code", "city", "founded_at",
                 "first_funding_at", "last_funding_at")


TYPED = f"""
cells as (select * replace ({', '.join(f"case when {c} not in ({_NA}) then {c} end as {c}" for c in _TEXT_COLUMNS)}) from ventures_raw),
typed as (
  select k as venture_id,
    {_clean_text('name')} as name,
    {_clean_text('homepage_url')} as homepage_url,
    {_clean_categories(_clean_text('category_list'))} as category_list,
    {_to_number('funding_total_usd')} as funding_total_usd,
    status,
    {_strip('upper(country_code)')} as country_code,
    {_strip('upper(state_code)')} as state_code,
    city,
    {_to_number('funding_rounds')} as funding_rounds,
    {_to_date('founded_at')} as founded_at,
    {_to_date('first_funding_at')} as first_funding_at,
    {_to_date('last_funding_at')} as last_funding_at
  from cells),
kept as (select * from typed where status is not null and name is not null),
fstats as (select quantile_cont(funding_total_usd, 0.25) q1, quantile_cont(funding_total_usd, 0.75) q3,
                  quantile_cont(funding_total_usd, {C.CAP_QUANTILE}) cap from kept),
capped as (select kept.* replace (case when funding_total_usd > cap then cap else funding_total_usd end
                                   as funding_total_usd) from kept, fstats)"""

DERIVED = f"""
derived as (
  select *,
    cast(coalesce(funding_total_usd > 0, false) as integer) as has_funding,
    round(datediff('day', founded_at, date '{AS_OF}') / 365.25::double, 2) as company_age_years,
    cast(datediff('day', founded_at, first_funding_at) as integer) as days_to_first_funding,
    cast(datediff('day', first_funding_at, last_funding_at) as integer) as funding_duration_days,
    cast(case when category_list is null then 0 else len(string_split(category_list, '|')) end as integer)
      as category_count,
    coalesce(split_part(category_list, '|', 1), 'Unknown') as primary_category,
    cast(country_code is not null as integer) as has_location,
    cast(city is not null and state_code is not null as integer) as has_detailed_location,
    cast(homepage_url is not null as integer) as has_homepage,
    {_DOMAIN} as domain_type,
    case when funding_rounds = 0 or isinf(funding_total_usd / funding_rounds) or isnan(funding_total_usd / funding_rounds)
         then null else funding_total_usd / funding_rounds end as funding_per_round,
    {_any_substring('category_list', C.TECH_KEYWORDS_BASIC)} as is_tech_startup,
    cast({_in('country_code', C.TIER1_COUNTRIES)} as integer) as tier1_country,
    cast({_in('country_code', C.EMERGING_MARKETS)} as integer) as emerging_market,
    cast({_in('year(founded_at)', C.RECESSION_YEARS)} as integer) as founded_in_recession,
    {bucket_sql('coalesce(funding_total_usd, 0.0)', C.FUNDING_BRACKET_ALL)} as funding_bracket
  from capped),
ventures as (
  select * replace (
      case when funding_total_usd > 0 and funding_rounds is null then 1.0 else funding_rounds end as funding_rounds,
      case when first_funding_at < founded_at then founded_at else first_funding_at end as first_funding_at,
      case when lower(status) in ('operating', 'acquired', 'closed', 'ipo') then lower(status) end as status),
    case lower(status) when 'acquired' then 'Success' when 'ipo' then 'Success' when 'closed' then 'Failed'
      when 'operating' then 'Operating' end as success_category
  from derived)"""

BASE = f"with ventures_raw as ({VENTURES_RAW_SQL}),{TYPED},{DERIVED}"


def with_base(select_sql: str, *extra_ctes: str) -> str:
    """The base CTEs, optional extra CTEs, then the final SELECT."""
    extra = "".join(f",\n{c}" for c in extra_ctes)
    return f"{BASE}{extra}\n{select_sql}"


# --------------------------------------------------------------------------- helpers for panels
CLEAN_COLUMNS = (
    "venture_id", "name", "homepage_url", "category_list", "funding_total_usd", "status", "country_code",
    "state_code", "city", "funding_rounds", "founded_at", "first_funding_at", "last_funding_at", "has_funding",
    "company_age_years", "days_to_first_funding", "funding_duration_days", "category_count", "primary_category",
    "has_location", "has_detailed_location", "has_homepage", "domain_type", "funding_per_round", "is_tech_startup",
    "tier1_country", "emerging_market", "founded_in_recession", "funding_bracket", "success_category",
)
CONCLUDED = "success_category in ('Success', 'Failed')"
SUCCESS = "success_category = 'Success'"
FAILED = "success_category = 'Failed'"


def _edge(j: str, bins: int) -> str:
    return f"(case when {j} = {bins} then _hi else ({j})::double * ((_hi - _lo) / {bins}.0::double) + _lo end)"


def hist_ctes(src: str, x: str, bins: int, by=(), shared: bool = False, density: bool = False,
              where: str = "true", out: str = "hist") -> list[str]:
    """CTEs computing a numpy-style equal-width histogram into CTE ``out``."""
    by = list(by)
    byc = "".join(f"{b}, " for b in by)
    rk = [] if shared else by
    rkc = ", ".join(rk)
    grp = f"group by {rkc}" if rk else ""
    using = f"using ({rkc})" if rk else "on true"
    i0 = f"least(cast(floor((_x - _lo) * ({bins}.0::double / (_hi - _lo))) as integer), {bins - 1})"
    i1 = f"(case when _x < {_edge(i0, bins)} then {i0} - 1 else {i0} end)"
    binx = f"(case when _x >= {_edge(f'{i1} + 1', bins)} and {i1} <> {bins - 1} then {i1} + 1 else {i1} end)"
    frame = (f"select {byc}_lo, _hi from h_rng" if not (by and shared)
             else f"select {byc}_lo, _hi from (select distinct {', '.join(by)} from h_data) g, h_rng")
    ctes = [
        f"h_data as (select {byc}cast({x} as double) as _x from {src} where ({where}) and ({x}) is not null)",
        f"h_rng as (select {rkc + ', ' if rk else ''}case when min(_x) = max(_x) then min(_x) - 0.5 else min(_x) end _lo, "
        f"case when min(_x) = max(_x) then max(_x) + 0.5 else max(_x) end _hi from h_data {grp})",
        f"h_cnt as (select {byc}bin, count(*) as n from (select {byc}{binx} as bin from h_data join h_rng {using}) "
        f"group by {byc}bin)",
        f"h_all as (select {byc}cast(b.range as integer) as bin, {_edge('b.range', bins)} as bin_lo, "
        f"{_edge('b.range + 1', bins)} as bin_hi from ({frame}) f, range(0, {bins}) b)",
    ]
    dens = ""
    if density:
        tot_using = f"using ({', '.join(by)})" if by else "on true"
        ctes.append(f"h_tot as (select {byc}sum(n) as _tot from h_cnt {'group by ' + ', '.join(by) if by else ''})")
        dens = (", round(case when _tot * (bin_hi - bin_lo) = 0 then null else coalesce(n, 0)::double / "
                "(_tot * (bin_hi - bin_lo)) end, 6) as density")
        join_tot = f" join h_tot {tot_using}"
    else:
        join_tot = ""
    on = " and ".join([f"a.{b} = c.{b}" for b in by] + ["a.bin = c.bin"])
    sel_by = "".join(f"a.{b}, " for b in by)
    ctes.append(
        f"{out} as (select {sel_by}a.bin, round(a.bin_lo, 6) as bin_lo, round(a.bin_hi, 6) as bin_hi, "
        f"coalesce(c.n, 0) as n{dens.replace('bin_hi - bin_lo', 'a.bin_hi - a.bin_lo').replace('coalesce(n', 'coalesce(c.n')} "
        f"from h_all a left join h_cnt c on {on}{join_tot.replace('using', 'using') if not by else ''}"
        + (f" join h_tot t on {' and '.join(f'a.{b} = t.{b}' for b in by)}" if (density and by) else "")
        + ")")
    return ctes


def rate_cols(n: str = "count(*)", s: str = f"count_if({SUCCESS})") -> str:
    return f"{n} as n, cast({s} as bigint) as n_success, {pct(f'cast({s} as bigint)', n)} as success_rate"


def labels_values(labels, name: str) -> str:
    rows = ", ".join(f"({_q(lab)}, {i})" for i, lab in enumerate(labels))
    return f"(select * from (values {rows}) t({name}, bucket_order))"


def rate_by_bucket_sql(src_where: str, x: str, bucket_def, name: str) -> str:
    edges, labels, lowest = bucket_def
    agg = (f"select {bucket_sql(x, bucket_def)} as {name}, count(*) as n, cast(count_if({SUCCESS}) as bigint) as ns "
           f"from ventures where {src_where} group by 1")
    return with_base(
        f"select l.{name}, cast(l.bucket_order as integer) as bucket_order, coalesce(a.n, 0) as n, "
        f"coalesce(a.ns, 0) as n_success, {pct('coalesce(a.ns, 0)', 'coalesce(a.n, 0)')} as success_rate "
        f"from {labels_values(labels, name)} l left join ({agg}) a on l.{name} = a.{name}")


def top_k_sql(src: str, value: str, key: str, k: int, rank_name: str = "rank") -> str:
    return (f"select *, cast(row_number() over (order by {value} desc nulls last, {key} asc) as integer) as {rank_name} "
            f"from {src} order by {value} desc nulls last, {key} asc limit {k}")


def pearson_sql(a: str, b: str) -> str:
    both = f"{a} is not null and {b} is not null"
    a2, b2 = f"case when {both} then {a}::double end", f"case when {both} then {b}::double end"
    den = f"sqrt(var_pop({a2}) * var_pop({b2}))"
    return f"case when {den} > 0 then covar_pop({a2}, {b2}) / {den} end"


def quantile_sql(x: str, p: float) -> str:
    return f"quantile_cont({x}, {p})"


AGE = "company_age_years"
FUND = "funding_total_usd"
YEAR = "cast(year(founded_at) as integer)"
TEMPORAL = "founded_at is not null and year(founded_at) between 1990 and 2023"
EXPLODED = ("select venture_id, category_list, founded_at, "
            f"{_strip('unnest(string_split(category_list, chr(124)))')} as category "
            "from ventures where category_list is not null")
CAT_COUNTS = f"(select category, count(*) as n from ({EXPLODED}) group by category)"
TOP10_CATS = f"({top_k_sql(CAT_COUNTS, 'n', 'category', 10)})"
CAT_MATCH = (f"(select v.*, t.category, t.rank from ventures v join {TOP10_CATS} t "
             "on v.category_list is not null and contains(v.category_list, t.category))")
CAT_FUNDING = (f"(select category, round(avg({FUND}), 2) as mean_funding from {CAT_MATCH} group by category "
               "having avg(funding_total_usd) is not null)")
CORR_COLS = list(C.CORR_COLUMNS) + ["is_success"]
CORR_SRC = (f"(select {', '.join(C.CORR_COLUMNS)}, cast(coalesce({SUCCESS}, false) as integer) as is_success "
            "from ventures)")
GEO_COUNTS = "(select country_code, count(*) as n from ventures where country_code is not null group by country_code)"


def _hist_query(x: str, bins: int, where: str, by=(), shared=False, density=False) -> str:
    ctes = hist_ctes("ventures", x, bins, by=by, shared=shared, density=density, where=where)
    return with_base("select * from hist", *ctes)


def _box_query(x: str, by: str, where: str) -> str:
    q = (f"q as (select {by}, count(*) as n, quantile_cont(_x, 0.25) as q1, quantile_cont(_x, 0.5) as median, "
         f"quantile_cont(_x, 0.75) as q3, min(_x) as min, max(_x) as max from d group by {by})")
    d = f"d as (select {by}, ({x})::double as _x from ventures where ({where}) and ({x}) is not null)"
    w = (f"w as (select q.*, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as flo, q3 + 1.5 * (q3 - q1) as fhi from q)")
    a = (f"a as (select w.{by}, min(case when _x >= flo then _x end) as wlo, max(case when _x <= fhi then _x end) as whi, "
         f"cast(count_if(_x < flo or _x > fhi) as bigint) as n_outliers from d join w using ({by}) group by w.{by})")
    sel = (f"select w.{by}, n, min, q1, median, q3, max, iqr, "
           "case when wlo is null or wlo > q1 then q1 else wlo end as whisker_lo, "
           "case when whi is null or whi < q3 then q3 else whi end as whisker_hi, n_outliers "
           f"from w join a using ({by})")
    return with_base(sel, d, q, w, a)


def _missing_sql() -> str:
    parts = [f"select '{c}' as column_name, cast(count_if({c} is null) as bigint) as n_missing, count(*) as _n "
             "from ventures" for c in CLEAN_COLUMNS]
    return with_base(f"select column_name, n_missing, {pct('n_missing', '_n')} as missing_pct from "
                     f"({' union all '.join(parts)}) where n_missing > 0")


def _completeness() -> str:
    nulls = " + ".join(f"cast({c} is null as integer)" for c in CLEAN_COLUMNS)
    return f"(1.0::double - ({nulls})::double / {float(len(CLEAN_COLUMNS))}::double) * 100.0::double"


def _funded_status_stats() -> str:
    return with_base(
        f"select status, count(*) as n, round(avg({FUND}), 2) as mean_funding, quantile_cont({FUND}, 0.5) as median_funding "
        f"from ventures where {FUND} is not null and status is not null group by status")


PANEL_SQL: dict[str, str] = {
    "d1_missing_pct": _missing_sql(),
    "d1_completeness_hist": _hist_query(_completeness(), 20, "true"),
    "d1_age_hist": _hist_query(AGE, 30, f"{AGE} between 0 and 50"),
    "d1_overview_stats": with_base(
        f"select count(*) as n_rows, {len(CLEAN_COLUMNS)}::integer as n_columns, round(avg({AGE}), 4) as mean_age, "
        f"cast(sum(has_funding) as bigint) as n_funded, {pct('sum(has_funding)', 'count(*)')} as pct_funded, "
        f"cast(sum(has_location) as bigint) as n_located, {pct('sum(has_location)', 'count(*)')} as pct_located, "
        "round(avg(funding_rounds), 4) as mean_rounds from ventures"),
    "d1_dtype_counts": with_base(
        "select kind, cast(count(*) as integer) as n_columns from (select case when t = 'VARCHAR' then 'text' when t in ('DATE', 'TIMESTAMP') then 'date' "
        "when t in ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'HUGEINT', 'FLOAT', 'DOUBLE') or t like 'DECIMAL%' then 'number' else 'other' end as kind "
        f"from (select unnest([{', '.join(f'typeof({c})' for c in CLEAN_COLUMNS)}]) as t from (select * from ventures limit 1))) group by kind"),
    "d1_funding_status": with_base("select cast(has_funding as integer) as has_funding, count(*) as n from ventures group by 1"),
    "d1_location_status": with_base("select cast(has_location as integer) as has_location, count(*) as n from ventures group by 1"),
    "d4_diversity": with_base(
        "select m.measure, case m.measure when 'diversity' then 1.0::double - "
        f"{ratio('sum(t.n * t.n)', 'max(g.total) * max(g.total)')} "
        f"when 'top3_share' then {ratio('sum(case when t.rank <= 3 then t.n end)', 'max(g.total)')} "
        f"when 'top5_share' then {ratio('sum(case when t.rank <= 5 then t.n end)', 'max(g.total)')} "
        f"else {ratio('sum(case when t.rank <= 10 then t.n end)', 'max(g.total)')} end as value "
        f"from (values ('diversity'), ('top3_share'), ('top5_share'), ('top10_share')) m(measure), ({top_k_sql(GEO_COUNTS, 'n', 'country_code', 15)}) t, "
        "(select count(*) as total from ventures where country_code is not null) g group by m.measure"),
    "d2_status_counts": with_base("select status, count(*) as n, cast(row_number() over (order by count(*) desc, status) as integer) as position from ventures where status is not null group by status"),
    "d2_success_split": with_base(
        f"select success_category, count(*) as n, cast(row_number() over (order by count(*) desc, success_category) as integer) as position from ventures where {CONCLUDED} group by success_category"),
    "d2_rate_by_age": rate_by_bucket_sql(f"{CONCLUDED} and {AGE} is not null", AGE, C.AGE_GROUPS, "age_group"),
    "d2_outcome_age_hist": _hist_query(AGE, 20, f"{CONCLUDED} and {AGE} > 0 and {AGE} < 30",
                                       by=["success_category"], shared=True),
    "d2_rate_by_funded": with_base(f"select has_funding, {rate_cols()} from ventures where {CONCLUDED} group by has_funding"),
    "d2_success_metrics": with_base(
        f"select cast(count_if({CONCLUDED}) as bigint) as n_concluded, "
        f"{pct(f'count_if({SUCCESS})', f'count_if({CONCLUDED})')} as success_rate, "
        f"coalesce(round(avg(case when {SUCCESS} and {AGE} > 0 and {AGE} < 30 then {AGE} end), 4), 0.0) as avg_age_success, "
        f"coalesce(round(avg(case when {FAILED} and {AGE} > 0 and {AGE} < 30 then {AGE} end), 4), 0.0) as avg_age_failed, "
        f"{pct(f'count_if({SUCCESS} and has_funding = 1)', f'count_if({CONCLUDED} and has_funding = 1)')} as rate_funded, "
        f"{pct(f'count_if({SUCCESS} and has_funding <> 1)', f'count_if({CONCLUDED} and has_funding <> 1)')} as rate_unfunded "
        "from ventures"),
    "d3_funding_density": _hist_query(f"log10({FUND} + 1)", 25, f"{FUND} is not null and status is not null",
                                      by=["status"], density=True),
    "d3_efficiency_box": _box_query("funding_per_round", "status",
                                    f"{FUND} is not null and funding_per_round is not null and status is not null"),
    "d3_first_funding_hist": _hist_query("days_to_first_funding / 365.25::double", 20,
                                         "days_to_first_funding between 0 and 3650 and status in ('acquired', 'ipo', 'closed')",
                                         by=["status"]),
    "d3_rate_by_bracket": rate_by_bucket_sql(f"{FUND} is not null and {CONCLUDED}", FUND, C.FUNDING_BRACKET_PANEL,
                                             "funding_bracket"),
    "d3_rate_by_rounds": with_base(
        f"select funding_rounds, {rate_cols()} from ventures where funding_rounds is not null and funding_rounds <= 10 "
        f"and {CONCLUDED} group by funding_rounds having count(*) > {C.MIN_ROUNDS_GROUP}"),
    "d3_funding_stats": _funded_status_stats(),
    "d3_funding_summary": with_base(
        f"select count(*) as n, round(avg({FUND}), 2) as mean_funding, quantile_cont({FUND}, 0.5) as median_funding "
        f"from ventures where {FUND} is not null"),
    "d4_top_countries": with_base(top_k_sql(GEO_COUNTS, "n", "country_code", 15)),
    "d4_country_success": with_base(
        f"select v.country_code, t.rank, {rate_cols()} from ventures v join ({top_k_sql(GEO_COUNTS, 'n', 'country_code', 10)}) t "
        f"on v.country_code = t.country_code where {CONCLUDED} group by v.country_code, t.rank "
        f"having count(*) > {C.MIN_COUNTRY_CONCLUDED}"),
    "d4_country_funding": with_base(top_k_sql(
        f"(select country_code, round(avg({FUND}), 2) as mean_funding from ventures where country_code is not null "
        "group by country_code)", "mean_funding", "country_code", 10)),
    "d4_concentration": with_base(
        f"select t.*, {pct('t.n', 'g.total')} as pct from ({top_k_sql(GEO_COUNTS, 'n', 'country_code', 10)}) t, "
        "(select count(*) as total from ventures where country_code is not null) g"),
    "d4_geo_summary": with_base(
        "select g.n_countries, arg_max(t.country_code, t.n * 1000 - t.rank) as top_country, max(t.n) as top_count, "
        f"{ratio('sum(t.n * t.n)', 'max(g.total) * max(g.total)')} as hhi, "
        f"1.0::double - {ratio('sum(t.n * t.n)', 'max(g.total) * max(g.total)')} as diversity, "
        f"{ratio('sum(case when t.rank <= 3 then t.n end)', 'max(g.total)')} as top3_share, "
        f"{ratio('sum(case when t.rank <= 5 then t.n end)', 'max(g.total)')} as top5_share, "
        f"{ratio('sum(case when t.rank <= 10 then t.n end)', 'max(g.total)')} as top10_share "
        f"from ({top_k_sql(GEO_COUNTS, 'n', 'country_code', 15)}) t, "
        "(select count(*) as total, count(distinct country_code) as n_countries from ventures where country_code is not null) g "
        "group by g.n_countries"),
    "d5_top_categories": with_base(top_k_sql(CAT_COUNTS, "n", "category", 15)),
    "d5_category_success": with_base(
        f"select category, rank, {rate_cols()} from {CAT_MATCH} where {CONCLUDED} group by category, rank "
        f"having count(*) > {C.MIN_CATEGORY_CONCLUDED}"),
    "d5_category_funding": with_base(top_k_sql(CAT_FUNDING, "mean_funding", "category", 8)),
    "d5_diversity_by_year": with_base(
        f"select s.year, s.n_ventures, coalesce(c.n_categories, 0) as n_categories from "
        f"(select {YEAR} as year, count(*) as n_ventures from ventures where year(founded_at) between 2000 and 2020 "
        f"group by 1 having count(*) > {C.MIN_YEAR_VENTURES}) s left join "
        f"(select {YEAR} as year, count(distinct category) as n_categories from ({EXPLODED}) "
        "where year(founded_at) between 2000 and 2020 group by 1) c on s.year = c.year"),
    "d5_category_count_dist": with_base(
        "select category_count, count(*) as n, cast(row_number() over (order by category_count) as integer) as position from ventures where category_count <= 10 group by category_count"),
    "d5_category_insights": with_base(
        "select c.n_categories, p.category as most_popular, p.n as most_popular_n, m.mean_category_count, "
        "b.category as best_rate_category, b.success_rate as best_rate, "
        "f.category as top_funded_category, f.mean_funding as top_funded_mean "
        f"from (select count(*) as n_categories from {CAT_COUNTS}) c "
        f"cross join ({top_k_sql(CAT_COUNTS, 'n', 'category', 1)}) p "
        "cross join (select round(avg(category_count), 4) as mean_category_count from ventures) m "
        f"left join ({top_k_sql(f'(select category, rank, {pct(f"count_if({SUCCESS})", "count(*)")} as success_rate from {CAT_MATCH} where {CONCLUDED} group by category, rank having count(*) > {C.MIN_CATEGORY_CONCLUDED})', 'success_rate', 'rank', 1, '_k')}) b on true "
        f"left join ({top_k_sql(CAT_FUNDING, 'mean_funding', 'category', 1)}) f on true"),
    "d6_year_counts": with_base(f"select year, n, cast(row_number() over (order by year) as integer) as position from (select {YEAR} as year, count(*) as n from ventures where {TEMPORAL} group by 1)"),
    "d6_rate_by_year": with_base(
        f"select {YEAR} as year, {rate_cols()} from ventures where {TEMPORAL} and {CONCLUDED} "
        f"and year(founded_at) between 1995 and 2019 group by 1 having count(*) > {C.MIN_YEAR_CONCLUDED}"),
    "d6_median_funding_year": with_base(
        f"select {YEAR} as year, count(*) as n, quantile_cont({FUND}, 0.5) as median_funding from ventures "
        f"where {TEMPORAL} and {FUND} is not null and year(founded_at) >= 1995 group by 1"),
    "d6_month_counts": with_base(
        "select cast(m.range as integer) as month, coalesce(c.n, 0) as n from range(1, 13) m left join "
        f"(select month(founded_at) as month, count(*) as n from ventures where {TEMPORAL} group by 1) c "
        "on m.range = c.month"),
    "d6_rate_by_era": with_base(
        f"select l.economic_era, cast(l.bucket_order as integer) as bucket_order, coalesce(a.s, 0) as n_success, "
        "coalesce(a.f, 0) as n_failed, "
        f"coalesce({pct('coalesce(a.s, 0)', 'coalesce(a.s, 0) + coalesce(a.f, 0)')}, 0.0) as success_rate "
        f"from {labels_values(C.ECONOMIC_ERAS[1], 'economic_era')} l left join "
        f"(select {bucket_sql('year(founded_at)', C.ECONOMIC_ERAS)} as economic_era, cast(count_if({SUCCESS}) as bigint) as s, "
        f"cast(count_if({FAILED}) as bigint) as f from ventures where {TEMPORAL} group by 1) a on l.economic_era = a.economic_era"),
    "d6_time_to_success": _hist_query(AGE, 20, f"{TEMPORAL} and {SUCCESS} and {AGE} > 0 and {AGE} < 25"),
    "d6_temporal_summary": with_base(
        "select y.peak_year, y.peak_count, m.top_month, s.mean_time_to_success, s.median_time_to_success from "
        f"(select arg_max(year, n * 10000 - year) as peak_year, max(n) as peak_count from "
        f"(select {YEAR} as year, count(*) as n from ventures where {TEMPORAL} group by 1)) y, "
        f"(select arg_max(month, n * 100 - month) as top_month from "
        f"(select cast(month(founded_at) as integer) as month, count(*) as n from ventures where {TEMPORAL} group by 1)) m, "
        f"(select round(avg({AGE}), 4) as mean_time_to_success, quantile_cont({AGE}, 0.5) as median_time_to_success "
        f"from ventures where {TEMPORAL} and {SUCCESS} and {AGE} > 0 and {AGE} < 25) s"),
    "d7_corr_matrix": with_base(" union all ".join(
        f"select '{CORR_COLS[i]}' as col_a, '{CORR_COLS[j]}' as col_b, round({pearson_sql(CORR_COLS[i], CORR_COLS[j])}, 6) "
        f"as corr from {CORR_SRC}" for i in range(len(CORR_COLS)) for j in range(len(CORR_COLS)) if i > j)),
    "d7_corr_ranked": with_base(
        "select * from (" + " union all ".join(
            f"select '{c}' as feature, round({pearson_sql(c, 'is_success')}, 6) as corr, "
            f"abs(round({pearson_sql(c, 'is_success')}, 6)) as abs_corr from {CORR_SRC}" for c in C.CORR_COLUMNS)
        + ") where abs_corr > 0.05"),
}


CLEAN_REPORT_SQL = with_base(
    "select r.rows_in, k.rows_kept, r.rows_in - k.rows_kept as rows_removed, k.funding_outliers, k.cap_value, "
    "k.capped_rows, k.suspicious_rounds, k.date_fixes, u.unparsed_dates from (select count(*) as rows_in from typed) r, "
    "(select cast(coalesce(sum(" + " + ".join(f"cast({c} is not null and {_to_date(c)} is null as integer)" for c in ("founded_at", "first_funding_at", "last_funding_at"))
    + "), 0) as bigint) as unparsed_dates from cells) u, "
    "(select count(*) as rows_kept, "
    f"cast(count_if(funding_total_usd < q1 - {C.OUTLIER_IQR_FACTOR} * (q3 - q1) or "
    f"funding_total_usd > q3 + {C.OUTLIER_IQR_FACTOR} * (q3 - q1)) as bigint) as funding_outliers, "
    "max(cap) as cap_value, cast(count_if(funding_total_usd > cap) as bigint) as capped_rows, "
    "cast(count_if((case when (case when funding_total_usd > cap then cap else funding_total_usd end) > 0 and funding_rounds is null then 1.0 else funding_rounds end) > 0 "
    "and funding_total_usd is null) as bigint) as suspicious_rounds, "
    "cast(count_if(first_funding_at is not null and founded_at is not null and first_funding_at < founded_at) as bigint) "
    "as date_fixes from kept, fstats) k")

CLEAN_TABLE_SQL = with_base(
    "select * replace (cast(founded_at as varchar) as founded_at, cast(first_funding_at as varchar) as first_funding_at, "
    "cast(last_funding_at as varchar) as last_funding_at) from ventures")


def ml_sql() -> dict[str, str]:
    """SQL of the feature / metric / insight queries (filled in by ``oracle_ml``)."""
    from . import oracle_ml
    return oracle_ml.ML_SQL
