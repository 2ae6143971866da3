"""The answer parsers on arbitrary strings against a plain statement of their rules."""

import random
import re

from pyspark.sql import functions as F

from corpusmill.functions import text as T

STRICT = re.compile(r"(?im)^ANSWER\s*:\s*([A-Za-z\d ,]+)\s*(?:$|\n|\.)")
LOOSE = re.compile(r"(?i)ANSWER\s*:\s*([A-Za-z\d ,]+)(?:\W|$)")
BARE = re.compile(r"\s*([A-Ea-e])(?:[).:,\s]|$)")


def letter(text, n, bare):
    """The last strict match, else the last loose one, else what the text begins with; one of the first n letters or nothing."""
    found = STRICT.findall(text or "") or LOOSE.findall(text or "")
    if not found and bare and (m := BARE.match(text or "")):
        found = [m.group(1)]
    said = found[-1].strip().upper() if found else ""
    return said if said and said in [chr(65 + i) for i in range(n)] else ""


def test_parsers_on_arbitrary_strings(spark):
    rng = random.Random(1)
    parts = ["ANSWER", "answer", "Answer", ":", " :", ": ", "B", "c", "E", "A", "d", "1", ",", ".", ")", "(", "*", "**", " ", "  ", "\n", "\t", " ", " ", "because", "foo", "é", "²", "_", "-", "\x1c", "x", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(6000)] + ["".join(["ANSWER", *(rng.choice(parts) for _ in range(rng.randint(1, 5)))]) for _ in range(4000)]
    texts += ["B", "B because", "B, since", "ANSWER: B)", "ANSWER:\nB", "**ANSWER: B**", "ANSWER: B (foo)", "ANSWER: B - yes", "x\nA) foo\nB) bar", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", T.parse_letter(F.col("t"), F.lit(4)).alias("lenient"), T.parse_letter(F.col("t"), F.lit(4), bare=False).alias("official")).collect()
    for r in rows:
        assert r["lenient"] == letter(texts[r["i"]], 4, True), repr(texts[r["i"]])
        assert r["official"] == letter(texts[r["i"]], 4, False), repr(texts[r["i"]])
    assert sum(r["lenient"] != "" for r in rows) > 300


def test_recovery(spark):
    cases = {
        "the correct answer is **B**.": "B", "Correct answer is (c) here": "C", "I say the answer is D.": "D", "**A) yes": "A", "  (E) it is": "E", "so option **B** as said is the correct one": "B", "Option C is correct": "C",
        "ANSWER: **D**": "D", "answer: b": "", "option B. It is correct": "", "ANSWER: Bee": "", "": "", None: "",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", T.recover_letter(F.col("t")).alias("x")).collect()} == cases
