"""Preparation of training text: tokens, secrets, toxicity, quality, copies, media, packing, shards."""
