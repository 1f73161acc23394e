"""Operators of a training-data pipeline: de-duplication, filters, token files, packing, chat, vector search."""
