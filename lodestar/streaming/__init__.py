"""Keeping the search tables current: change queue, backfill, embedding tasks, and the stream that drives them."""
