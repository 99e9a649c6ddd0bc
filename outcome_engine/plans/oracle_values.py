"""Fixed values of the original analysis as the oracle's SQL uses them.

Written out here a second time and never taken from the engine, so that a wrong
word, edge or gate on one side shows as a difference.
"""

from __future__ import annotations

AS_OF, CURRENT_YEAR, SEED = "2025-01-01", 2025, 42

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
TECH_KEYWORDS_BASIC: tuple[str, ...] = (
    "Software", "Biotechnology", "Artificial Intelligence", "Machine Learning",
    "Data Analytics", "Cybersecurity", "Blockchain", "IoT", "API", "SaaS",
    "Mobile", "Apps", "Web Development", "Cloud Computing", "Big Data",
)
TECH_KEYWORDS_MODEL: tuple[str, ...] = (
    "Software", "Biotechnology", "Artificial Intelligence", "Machine Learning",
    "Data Analytics", "Cybersecurity", "Blockchain", "IoT", "API", "SaaS",
)
TIER1_COUNTRIES: tuple[str, ...] = ("USA", "GBR", "CAN", "DEU", "FRA", "AUS", "JPN", "KOR", "SGP")
EMERGING_MARKETS: tuple[str, ...] = ("IND", "CHN", "BRA", "RUS", "MEX", "ZAF", "TUR")
RECESSION_YEARS: tuple[int, ...] = (2001, 2002, 2008, 2009, 2020)
DOMAIN_RULES: tuple[tuple[str, str], ...] = (
    (".com", "Commercial"),
    (".org", "Organization"),
    (".net", "Network"),
    (".io", "Tech"),
    (".co", "Company"),
)
INF = float("inf")
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
CORR_COLUMNS: tuple[str, ...] = (
    "funding_total_usd", "funding_rounds", "company_age_years", "days_to_first_funding",
    "funding_duration_days", "category_count", "has_funding", "has_location", "has_homepage",
)
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
MIN_ROUNDS_GROUP = 5
MIN_COUNTRY_CONCLUDED = 10
MIN_CATEGORY_CONCLUDED = 15
MIN_YEAR_VENTURES = 50
MIN_YEAR_CONCLUDED = 20
MIN_SCORED_CATEGORY = 20
MIN_OPPORTUNITY_CONCLUDED = 30
MIN_REPORT_COUNTRY = 50
MAX_AGE_YEARS = 100
CAP_QUANTILE = 0.999
OUTLIER_IQR_FACTOR = 3.0
VARIANCE_THRESHOLD = 0.01
WINSORIZED = (
    "funding_total_usd", "funding_rounds", "company_age_years", "days_to_first_funding", "funding_duration_days",
    "category_count", "funding_per_round", "funding_total_usd_filled", "funding_log", "funding_per_round_filled",
    "funding_intensity", "funding_velocity", "founded_year_filled", "founded_decade",
    "days_to_first_funding_filled", "funding_speed_score", "category_diversity", "category_success_rate",
    "country_success_rate", "funding_country_interaction", "tech_funding_interaction", "age_funding_interaction",
)
