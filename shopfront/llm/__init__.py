"""Operators that prepare text for training: thirteen methods, their queries and the corpus pipeline's parts."""
