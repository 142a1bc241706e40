"""Spark-first analytics toolkit: composable DataFrame operators with defined null, tie and rounding rules."""
