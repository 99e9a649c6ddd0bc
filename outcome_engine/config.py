"""Settings, column roles and the fixed values the analysis depends on.

Everything that must equal the original analysis for equal results (word lists,
country lists, bin edges, labels, sample gates) is stated once, in plain text and
natural order, in the "fixed values" block below.  Runtime knobs that only change
*how* Spark computes (quantile strategy, block count, ...) live in ``Settings``.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values (must equal the original analysis for equal results)
# ---------------------------------------------------------------------------

# Ordered literal substring replacements applied to each title-cased category.
CATEGORY_FIXES: tuple[tuple[str, str], ...] = (
    ("Saas", "SaaS"),
    ("Ai", "AI"),
    ("Iot", "IoT"),
    ("B2b", "B2B"),
    ("B2c", "B2C"),
    ("Api", "API"),
    ("Crm", "CRM"),
    ("Hr", "HR"),
    ("It", "IT"),
)

# Technology keywords of the cleaned table (15 words).
TECH_KEYWORDS_BASIC: tuple[str, ...] = (
    "Software", "Biotechnology", "Artificial Intelligence", "Machine Learning",
    "Data Analytics", "Cybersecurity", "Blockchain", "IoT", "API", "SaaS",
    "Mobile", "Apps", "Web Development", "Cloud Computing", "Big Data",
)

# Technology keywords of the model features (the first 10 of the list above).
TECH_KEYWORDS_MODEL: tuple[str, ...] = (
    "Software", "Biotechnology", "Artificial Intelligence", "Machine Learning",
    "Data Analytics", "Cybersecurity", "Blockchain", "IoT", "API", "SaaS",
)

TIER1_COUNTRIES: tuple[str, ...] = ("USA", "GBR", "CAN", "DEU", "FRA", "AUS", "JPN", "KOR", "SGP")
EMERGING_MARKETS: tuple[str, ...] = ("IND", "CHN", "BRA", "RUS", "MEX", "ZAF", "TUR")
RECESSION_YEARS: tuple[int, ...] = (2001, 2002, 2008, 2009, 2020)

# status -> outcome label
OUTCOME_OF_STATUS: dict[str, str] = {
    "acquired": "Success",
    "ipo": "Success",
    "closed": "Failed",
    "operating": "Operating",
}
KNOWN_STATUSES: tuple[str, ...] = ("operating", "acquired", "closed", "ipo")
SUCCESS_STATUSES: tuple[str, ...] = ("acquired", "ipo")
CONCLUDED_STATUSES: tuple[str, ...] = ("acquired", "ipo", "closed")

# URL substring -> domain type, first match wins; null url -> "No Website", no match -> "Other".
DOMAIN_RULES: tuple[tuple[str, str], ...] = (
    (".com", "Commercial"),
    (".org", "Organization"),
    (".net", "Network"),
    (".io", "Tech"),
    (".co", "Company"),
)

INF = float("inf")

# Bucket definitions: (edges, labels, include_lowest).  Buckets are right-closed.
FUNDING_BRACKET_ALL = ((0.0, 50_000.0, 500_000.0, 5_000_000.0, 50_000_000.0, INF),
                       ("No/Low Funding", "Seed", "Series A/B", "Growth", "Late Stage"), True)
FUNDING_BRACKET_PANEL = ((0.0, 50_000.0, 500_000.0, 5_000_000.0, 50_000_000.0, INF),
                         ("<50K", "50K-500K", "500K-5M", "5M-50M", ">50M"), False)
AGE_GROUPS = ((0.0, 2.0, 5.0, 10.0, INF), ("0-2 years", "2-5 years", "5-10 years", "10+ years"), False)
AGE_GROUPS_EXIT = ((0.0, 2.0, 5.0, 10.0, 20.0), ("0-2 years", "2-5 years", "5-10 years", "10+ years"), False)
ECONOMIC_ERAS = ((1989.0, 1999.0, 2007.0, 2009.0, 2019.0, 2023.0),
                 ("Dot-com Era (1990-1999)", "Pre-Crisis (2000-2007)", "Financial Crisis (2008-2009)",
                  "Recovery (2010-2019)", "Recent (2020+)"), False)
CONFIDENCE_BUCKETS = ((0.0, 0.3, 0.7, 1.0), ("Low Probability", "Medium Probability", "High Probability"), False)

# Columns of the correlation panel (plus the success flag).
CORR_COLUMNS: tuple[str, ...] = (
    "funding_total_usd", "funding_rounds", "company_age_years", "days_to_first_funding",
    "funding_duration_days", "category_count", "has_funding", "has_location", "has_homepage",
)

# The 26 candidate model features, in order.
CANDIDATE_FEATURES: tuple[str, ...] = (
    "funding_total_usd_filled", "funding_log", "funding_rounds", "has_funding",
    "company_age_years", "category_count", "has_location", "has_homepage",
    "funding_velocity", "funding_intensity", "funding_speed_score",
    "is_tech_startup", "category_diversity", "tier1_country", "emerging_market",
    "founded_in_recession", "market_density", "category_success_rate", "country_success_rate",
    "funding_country_interaction", "tech_funding_interaction", "age_funding_interaction",
    "high_risk_profile", "low_risk_profile",
    "founded_decade", "days_to_first_funding_filled",
)

# Sample-size gates (strictly greater than, unless noted).
MIN_ROUNDS_GROUP = 5          # rate by round count
MIN_COUNTRY_CONCLUDED = 10    # country success panel
MIN_CATEGORY_CONCLUDED = 15   # category success panel
MIN_YEAR_VENTURES = 50        # category diversity by year
MIN_YEAR_CONCLUDED = 20       # success rate by year
MIN_SCORED_CATEGORY = 20      # scored roll-up (greater or equal)
MIN_OPPORTUNITY_CONCLUDED = 30
MIN_REPORT_COUNTRY = 50

# Feature defaults.
DEFAULT_RATE = 0.1            # target-encoding fallback
DEFAULT_MEDIAN_YEAR = 2010
DEFAULT_MEDIAN_DAYS = 365
FIRST_YEAR = 1990
MAX_DAYS_TO_FUNDING = 3650
MAX_AGE_YEARS = 100
MARKET_DENSITY_MAX = 1000
SAFE_DIVIDE_LIMIT = 1e10
SAFE_LOG_FLOOR = 1e-10
SAFE_LOG_LIMIT = 10.0
WINSOR_LOW, WINSOR_HIGH = 0.01, 0.99
CAP_QUANTILE = 0.999
OUTLIER_IQR_FACTOR = 3.0
VARIANCE_THRESHOLD = 0.01
TOP_CORR_FEATURES = 15
TOP_RF_FEATURES = 15
MAX_SELECTED, MIN_SELECTED, FILL_SELECTED = 20, 10, 15


# ---------------------------------------------------------------------------
# Column roles: the engine is not tied to ventures; any entity table with an
# outcome can be mapped onto these logical names.
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Roles:
    entity_id: str = "venture_id"
    name: str = "name"
    url: str = "homepage_url"
    tags: str = "category_list"
    amount: str = "funding_total_usd"
    rounds: str = "funding_rounds"
    status: str = "status"
    region: str = "country_code"
    subregion: str = "state_code"
    city: str = "city"
    start: str = "founded_at"
    first: str = "first_funding_at"
    last: str = "last_funding_at"

    def rename_map(self) -> dict[str, str]:
        """Map input column names to the canonical names used by the engine."""
        canon = Roles()
        return {getattr(self, f): getattr(canon, f) for f in self.__dataclass_fields__
                if getattr(self, f) != getattr(canon, f)}


# The cell texts that a CSV reader of the original analysis takes as missing.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
             "NaN", "None", "n/a", "nan", "null")


@dataclass(frozen=True)
class Settings:
    """Runtime settings.

    ``as_of`` replaces the wall clock of the original analysis so results are
    reproducible.  ``quantile_mode='exact'`` runs a distributed exact quantile
    (``quantile_blocks`` cut points a round until a segment has at most
    ``select_rows`` values, which one task ranks), ``'approx'`` uses
    ``percentile_approx`` with ``approx_accuracy``.
    """

    as_of: str = "2025-01-01"
    quantile_mode: str = "exact"
    quantile_blocks: int = 64
    select_rows: int = 1_000_000
    # corrected forms of what surprises in the original analysis
    whole_word: bool = False  # category fixes replace whole words only ("Ai" in "Air" stays)
    recompute: bool = False   # durations and amount per round anew after the repairs
    distinct_mode: str = "exact"  # or "approx": mergeable sketches
    approx_accuracy: int = 10000
    # date formats tried in order when coercing text to dates
    date_formats: tuple[str, ...] = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
                                     "yyyy-MM-dd'T'HH:mm:ssXXX", "dd-MMM-yyyy", "yyyyMMdd", "yyyy-MM", "yyyy")
    roles: Roles = field(default_factory=Roles)
    seed: int = 42

    @property
    def current_year(self) -> int:
        return _dt.date.fromisoformat(self.as_of).year

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)

    def for_rows(self, n: int, rows_per_block: int = 2_000_000) -> "Settings":
        """As many quantile and rank blocks as keep one block a modest task: from the row count, at least the set number."""
        return self.with_(quantile_blocks=min(1 << 16, max(self.quantile_blocks, -(-n // rows_per_block))))


DEFAULT = Settings()
