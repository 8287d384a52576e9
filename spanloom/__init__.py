"""Interval, series, fingerprint, trust and admission analytics as Spark plans."""
