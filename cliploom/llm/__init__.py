"""Training-data operators: quality, media, dedup, tokenising, HTML, mixing, URLs, packing, chat.

Nothing else in the library imports this subpackage.
"""
