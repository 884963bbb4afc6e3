"""Dialogue analytics on Spark: interval joins, sequence windows, voice identification and workflow replay."""
