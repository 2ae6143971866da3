"""What the odd tables are made of."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD_TEXTS = ["", None, " \n\t", "one", "Ä ß é 漢字 🙂 ▁ x", "a  b\n\n c d ", "word " * 30000, "x" * 50000, "<|endoftext|> tail", "same text twice over here", "same text twice over here"]
#: Names that operators use, or might use, for columns of their own.
CLASHES = """shard block blocks fp words lines score _score ids row rows _row shards edge begin end count n n_words _doc _id _spans spans _text hash _hash digest size _size
    place target taken source_size copy component component_id first class other toxic quality label band bands key kept cut unit residual h node a b x band_key uni""".split()
