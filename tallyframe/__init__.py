"""Spark-native distribution analytics: tables in, compact distributions and their comparisons out."""
