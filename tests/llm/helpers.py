"""Shared by the tests of the training-data operators."""

#: Texts that any operator must bear.
ODD = [None, "", " ", "\t\n", "word", "!!! ###", "é" * 40, "a b " * 60_000, "x" * 300_000, "\x00 nul", "日本語 のテキスト", "same text here", "same text here"]
