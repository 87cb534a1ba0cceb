"""Trusted-facts analytics on Spark."""
