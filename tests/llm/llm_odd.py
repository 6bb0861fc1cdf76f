"""Texts that every operator must take."""

ODD = [None, "", " ", "\n\n", "a", "a b c d e", "é" * 300, "x" * 5000, "漢字 かな 😀", "same text here " * 20, "same text here " * 20, "tab\tand\rreturn\x0b\x0c end", "a+b@c.de [at] (at) + 1 2 3 4", "0" * 400, "<s>[INST] x [/INST]</s>"]
