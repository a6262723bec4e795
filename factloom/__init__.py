"""Evidence-grounded facts in technical documents, as DataFrame operators on Spark."""
