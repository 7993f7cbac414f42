"""Training-data operators: filtering, de-duplication, mixing, tokenising and writing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
