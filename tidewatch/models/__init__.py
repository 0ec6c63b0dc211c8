"""Outlier models."""
