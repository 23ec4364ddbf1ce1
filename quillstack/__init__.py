"""quillstack: document preparation, segmentation and retrieval as Spark DataFrame plans."""

__version__ = "0.1.0"
