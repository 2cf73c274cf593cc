"""Training-data operators: packing, near-dedup, sharding, decontamination, filters, token files, LM scores.

Nothing outside this folder imports it; its queries and their SQL are in
``shelfwise.llm.queries``.
"""
