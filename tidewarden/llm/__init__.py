"""Corpus operators for training data: every module here stands beside the engine, which imports none of them."""
