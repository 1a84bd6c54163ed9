"""A document retrieval engine on Spark: scan, extract, chunk, embed, index, search and read."""

VERSION = "0.1.0"
