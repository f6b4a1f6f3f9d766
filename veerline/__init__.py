"""veerline: account-timeline analytics as Spark DataFrame operators.

Layout:
    functions/  Column -> Column helpers (text cleaning, counts, vectors)
    operators/  DataFrame -> DataFrame steps (timeline, docs, sampling, evaluate, model)
    sources/    readers and writers
    plans/      composed flagship queries and the query / oracle registry
    streaming/  the stateless steps applied to streaming DataFrames
"""

__all__ = ["session"]
