"""Listing intelligence as Spark jobs: land, standardize, validate, dedupe, merge, score, rank, export."""
