"""Readers and writers for panels and edge lists."""
