"""Streaming.

The reference analysis is batch only: every input is a closed monthly report
or a bounded query over a time window, and nothing watermarks, windows by
event time or keeps state across batches. No streaming operator is built.
"""
