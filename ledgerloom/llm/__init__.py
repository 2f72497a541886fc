"""Training-data operators: de-duplication, filtering, decontamination, sharding, tokens."""
