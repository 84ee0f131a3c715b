"""Training-data operators: ten building blocks for corpus preparation on Spark.

Nothing outside this folder imports it; `queries.py` registers one query per operator.
"""
