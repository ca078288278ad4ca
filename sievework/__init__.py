"""sievework: analytics over decision-model corpora, expressed as Spark plans."""
