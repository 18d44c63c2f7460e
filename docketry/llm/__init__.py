"""Training-data operators: near-duplicate removal, quality, sharding, mixing, tokenizing, toxicity.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; words are
runs of characters other than space and U+0009 to U+000D.
"""
