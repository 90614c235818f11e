"""Text analytics on Spark DataFrames: term statistics, lexicon sentiment,
word transitions, seeded Markov generation and evaluation."""
