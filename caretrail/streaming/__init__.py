"""Delivery events and the list of recent interactions, as streams."""
