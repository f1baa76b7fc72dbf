"""Waveform analytics on Spark."""
