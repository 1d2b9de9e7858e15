"""Queries, questions, answers and the registered plans."""
