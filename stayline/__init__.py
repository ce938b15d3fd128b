"""Audience-retention analytics as Spark DataFrame jobs keyed by video."""
