"""Audit, split, score and summarise labelled datasets with Spark DataFrames."""
