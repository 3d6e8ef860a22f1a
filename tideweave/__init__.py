"""Replicated data types as relations: merges are one union and one aggregate, never pairwise joins."""
