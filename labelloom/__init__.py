"""Multilabel text classification as DataFrame operators."""
