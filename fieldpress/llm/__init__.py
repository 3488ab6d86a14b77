"""Training-data operators: scoring, packing, quality, token output, dedup, decontamination, chat."""
