"""Timed-sequence analytics on Spark: frames, words, speakers, turns, cues and live captions."""
