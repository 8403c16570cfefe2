"""Spark-native table operators: change logs, current state, history, facts, marts and checks."""
