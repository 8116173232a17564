"""Verification of facts from technical documents, on Spark."""
