"""Training-data operators: licences, archives, packing, chat tools, deduplication, tokens, toxicity.

One module per operator, each with a general DataFrame interface; ``queries`` holds the thin
registered queries and their SQL. Nothing else in the library imports this subpackage.
"""
