"""Readers and writers for text corpora, score vectors and generated text."""
