"""Analyses of statements: facts from Catalyst plans, proofs, failure modes and rules."""
