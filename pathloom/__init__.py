"""Skill mapping, skill and course graphs, course recommendation, training sets and retrieval metrics on Spark DataFrames."""
