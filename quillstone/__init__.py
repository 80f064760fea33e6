"""quillstone: document analytics as Spark DataFrame operators."""
