"""Operators that prepare crawled text for training corpora."""
