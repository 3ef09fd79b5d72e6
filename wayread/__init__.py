"""Passage search and reading paths over large text corpora, on Spark DataFrames."""
