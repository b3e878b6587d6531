"""Table plans: observations from the event table, predictor and bucket columns."""
