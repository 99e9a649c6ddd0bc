"""Query plans: dashboard panels, the end-to-end run, the query catalog and its SQL oracle."""
