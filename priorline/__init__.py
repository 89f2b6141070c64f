"""Lookahead-safe sequential analytics on Spark."""
