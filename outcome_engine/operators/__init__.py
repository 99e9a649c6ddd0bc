"""DataFrame -> DataFrame operators: cleaning, cohorts, statistics, features, models, metrics."""
