"""larkspur: entity reconciliation analytics and corpus preparation on PySpark."""
