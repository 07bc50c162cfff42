"""Spark-native search and analytics over libraries of structured source text."""
