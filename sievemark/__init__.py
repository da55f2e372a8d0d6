"""sievemark: information-theoretic curation of speech and text corpora on Spark DataFrames."""
