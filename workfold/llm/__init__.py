"""Training-data operators: formatting, tokens, packing, privacy, de-duplication, decontamination."""
