"""Readers of landed payloads and writers of the results.

A reader takes payloads (source, page_no, body) and returns two DataFrames: raw
reports with `record_ord`, and failures (source, page_no, status, message) for
payloads that make their source unusable.
"""
