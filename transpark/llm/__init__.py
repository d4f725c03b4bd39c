"""Operators of a training-data pipeline: near-duplicate joins, tokenising, sketches, scans, scores, packing.

Every operator takes and returns DataFrames and names the columns it reads; other columns of its
input are ignored, so extra columns with clashing names cannot disturb it. A null text counts as the
empty text unless the operator says otherwise.
"""
