"""quillon: retrieval, temporal facts, budgets, evaluation and integrity rules as Spark DataFrames."""
