"""Payment-claim reconciliation and corpus preparation as PySpark DataFrame plans."""
