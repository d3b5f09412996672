"""tallyforge: a Spark-first engine for document-grounded billing audits."""
