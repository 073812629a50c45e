"""Plumeworks: analytics over roadside emission observations, on Spark."""
