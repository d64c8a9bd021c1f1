"""Bilingual corpus work as Spark DataFrame jobs.

functions/  column expressions (no DataFrame, no shuffle)
operators/  DataFrame -> DataFrame jobs
sources/    readers and writers
plans/      the test views, the registered queries and their SQL oracles
"""
