"""Scoring streams needs nothing of its own.

``GBTModel.predict`` and ``LinearModel.predict`` are column expressions without state, so they
take a streaming DataFrame as they take any other, in append mode. There is no windowed or
stateful operator.
"""
