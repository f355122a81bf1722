"""Training-data operators: mixing, dedup, sharding, chat formatting, language ID, search, packing, LM scoring."""
