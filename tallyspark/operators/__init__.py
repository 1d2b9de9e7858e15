"""Operators on facts, texts, retrieval and evaluation."""
