"""Scholarloom: a research-intelligence corpus built and queried with Spark.

Every job takes DataFrames and returns DataFrames, takes ``as_of`` instead of reading the
clock, and leaves the physical plan to Catalyst and AQE.
"""
