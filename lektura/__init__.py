"""lektura: DataFrame operators for question-and-answer corpora on Spark."""
