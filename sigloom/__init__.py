"""Signature and provenance analytics on Spark DataFrames.

Core operators live in :mod:`sigloom.operators`; readers and publishers in
:mod:`sigloom.sources`; column helpers in :mod:`sigloom.functions`; registered
queries in :mod:`sigloom.plans`; streaming jobs in :mod:`sigloom.streaming`.
The subpackage ``llm`` is optional: nothing else imports it.
"""
