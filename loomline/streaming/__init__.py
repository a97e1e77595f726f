"""Streams: matching, mining into a versioned catalog."""
