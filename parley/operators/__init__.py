"""Relational operators: interval joins, sequence windows, voice scoring, decisions."""
