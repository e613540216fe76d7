"""Timing, plan facts, result cache and layout advice."""
