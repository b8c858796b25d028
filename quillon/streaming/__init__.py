"""Structured Streaming operators and their batch replays."""
