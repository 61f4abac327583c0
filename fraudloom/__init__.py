"""Fraud surveillance analytics as functions over Spark DataFrames and streams."""
