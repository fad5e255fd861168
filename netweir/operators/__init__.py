"""Operators: packets to flows, labels, sampling, features, thresholds, scans, reports, history."""
