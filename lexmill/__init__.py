"""DataFrame operators for corpus preparation and language-model evaluation on Spark."""
