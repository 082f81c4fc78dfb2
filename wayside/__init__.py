"""Interval, linear-network and text analytics as Spark DataFrame plans."""
