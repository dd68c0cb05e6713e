"""Tarmac: road-network style analytics as Spark DataFrames."""
