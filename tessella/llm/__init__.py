"""Training-data operators: archives, token files, de-duplication, privacy, licences, contamination, toxicity."""
