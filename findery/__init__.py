"""Findery: document search and ranking on Spark."""
