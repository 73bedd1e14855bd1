"""Training-data operators: packing, pseudonyms, line and document de-duplication,
tokenizer codecs, fingerprints, quality and toxicity models, licence scans.

Nothing outside this folder imports it; it imports nothing from the rest of the library.
"""
