"""Declarative datasets, features, tables, rollups, incremental refresh, models and checks on Spark DataFrames."""
