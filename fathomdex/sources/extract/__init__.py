"""Extractors: the pages of a file, by format."""

from .base import Extracted, Options, Page, UnsupportedFormat, extract, provider, register_provider

__all__ = ["Extracted", "Options", "Page", "UnsupportedFormat", "extract", "provider", "register_provider"]
