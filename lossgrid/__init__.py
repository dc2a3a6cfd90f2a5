"""lossgrid: set-at-a-time claim intake, triage and retrieval on Spark."""
