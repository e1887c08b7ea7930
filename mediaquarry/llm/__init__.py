"""Training-data operators: ten distributed text, archive and page operators."""
