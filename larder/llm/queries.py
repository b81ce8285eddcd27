"""Importing this module registers the queries of all operators."""

from larder.llm import q_alignment, q_capfilters, q_fingerprints, q_langid, q_linededup, q_mtree, q_packing, q_repair, q_secrets, q_sentencepieces, q_simhash, q_toxicity, q_warc  # noqa: F401
from larder.llm.registry import ORACLE, QUERIES  # noqa: F401
