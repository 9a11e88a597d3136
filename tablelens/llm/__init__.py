"""Operators of a training-data pipeline (dedup, tokens, language, decontamination,
quality, mixing, sharding).  Nothing else in the library imports this package;
its registered queries are in :mod:`tablelens.llm.queries`."""
