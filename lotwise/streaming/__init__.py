"""Streaming intake of scenes."""
