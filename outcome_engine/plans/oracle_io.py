"""DuckDB SQL of the source and sink queries: what must be read back."""

from __future__ import annotations

from ..sources.fixture import VENTURES_RAW_SQL
from .oracle_ml import ML_SQL
from .oracle_sql import CLEAN_TABLE_SQL, EXPLODED, PANEL_SQL, with_base

_CELL = "name || chr(10) || 'known as \"' || cast(k as varchar) || '\",' || chr(10) || chr(10) || 'of ' || coalesce(city, 'nowhere')"

IO_SQL: dict[str, str] = {
    "src_multiline_csv": f"select cast(k as varchar) as k, {_CELL} as name, category_list, funding_total_usd, status, cast(founded_at as varchar) as founded_at "
                         f"from ({VENTURES_RAW_SQL})",
    "snk_cleaned_table": CLEAN_TABLE_SQL,
    "snk_predictions_csv": ML_SQL["sco_predictions"],
    "snk_dashboard": " union all ".join(f"select '{name}' as panel, count(*) as n_rows from ({sql})" for name, sql in PANEL_SQL.items()),
    "agg_distinct_sketches": with_base(
        "select cast(year(x.founded_at) as integer) as year, count(distinct category) as n_categories, count(distinct v.country_code) as n_countries, "
        f"1 as categories_near, 1 as countries_near from ({EXPLODED}) x join ventures v on v.venture_id = x.venture_id "
        "where x.founded_at is not null group by 1"),
}
