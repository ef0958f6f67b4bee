"""Study material (cards, quizzes, keywords, summaries) from document tables, on Spark DataFrames."""

__version__ = "0.2.0"
