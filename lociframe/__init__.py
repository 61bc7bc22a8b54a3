"""Interval, graph and variant analytics as Spark DataFrame operators."""
