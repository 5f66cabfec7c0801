"""Chains of operators for whole tasks."""
