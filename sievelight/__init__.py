"""Secret detection and redaction, expressed as Spark plans."""
