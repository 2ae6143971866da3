"""Substring dedup against brute force, planted passages and rows that share a doc_id."""

import re

import numpy as np
import xxhash
from odd_tables import CLASHES, DOCS

from corpusmill.llm import substring


def test_substring(spark, odd, empty):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(60) for _ in range(40)]
    rows, clean = [], [(i, text(200)) for i in range(40)]
    for k, p in enumerate(passages):
        rows += [(100 + 2 * k, f"{text(30 + k)} {p} {text(20)}"), (101 + 2 * k, f"{text(11 + k)} {p} {text(25)}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in clean + rows], DOCS)
    found = substring.repeats(docs).collect()
    hit = {r["doc_id"] for r in found}
    assert not {x for r in found for x in (r["doc_id"], r["first_doc_id"])} & set(range(40))
    assert len(hit) >= 39 and all(d % 2 == 1 for d in hit)
    raw = {i: t.encode() for i, t in clean + rows}
    for r in found:
        assert raw[r["doc_id"]][r["begin"] : r["end"]] in raw[r["first_doc_id"]]
    out = {r["doc_id"]: r["text"] for r in substring.deduplicated(docs).collect()}
    assert all(out[i] == t for i, t in clean) and len(out) == 120
    assert all(len(out[d].split()) < len(raw[d].split()) - 20 for d in hit)
    copies = spark.createDataFrame([(i, clean[0][1] + " é ü", "en", "s", 0) for i in (5, 9, 7)], DOCS)
    assert [r["doc_id"] for r in substring.deduplicated(copies).collect()] == [5]
    kept = substring.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert all(r[c] == f"own {c}" for r in kept.collect() for c in CLASHES)
    assert substring.deduplicated(empty).count() == 0


def test_gear_is_local():
    data = np.random.default_rng(8).integers(0, 256, 500, dtype=np.uint8)
    assert (substring.gear(data)[100:] == substring.gear(data[100 - substring.GEAR_BYTES + 1 :])[substring.GEAR_BYTES - 1 :]).all()


def brute_chunks(text):
    """Begin and end of every chunk of one text, by the rule, byte by byte."""
    raw = (text or "").encode()
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    padded = b"\n" * substring.GEAR_BYTES + raw

    def cut(end):
        h = 0
        for age in range(substring.GEAR_BYTES):
            h += int(substring._GEAR[padded[substring.GEAR_BYTES + end - 1 - age]]) << age
        return h % 2**32 < 2**32 // substring.CUT_EVERY

    cuts = [i for i, (_, e) in enumerate(words) if cut(e) or i == len(words) - 1]
    out, last = [], None
    for first in [0] + [c + 1 for c in cuts[:-1]] if words else []:
        stop = next((c for c in cuts if c >= first + substring.WORDS - 1), None)
        if stop is not None:
            out.append((words[first][0], words[stop][1]))
            last = first
    if last is not None and out[-1][1] != words[-1][1]:
        out.append((words[last][0], words[-1][1]))
    return out


def brute_repeats(rows):
    """What each row loses: spans that touch or overlap are one."""
    first, held = {}, {}
    for row, (doc, text) in enumerate(rows):
        raw = (text or "").encode()
        held[row] = [(a, b, (xxhash.xxh3_64_intdigest(raw[a:b]), b - a)) for a, b in brute_chunks(text)] if doc is not None else []
        for _, _, c in held[row]:
            first[c] = min(first.get(c, doc), doc)
    out = set()
    for row, (doc, _) in enumerate(rows):
        runs = []
        for a, b, c in sorted(held[row]):
            if first[c] < doc:
                if runs and a <= runs[-1][1]:
                    runs[-1] = [runs[-1][0], max(b, runs[-1][1]), min(first[c], runs[-1][2])]
                else:
                    runs.append([a, b, first[c]])
        out |= {(doc, *r) for r in runs}
    return out


def test_substring_meets_brute_force(spark):
    rng = np.random.default_rng(17)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopé漢"), rng.integers(1, 9)))
    text = lambda n: " ".join(word() + str(rng.choice(["", "", ",", ".\n"])) for _ in range(n))
    passages = [text(n) for n in (20, 35, 60, 90, 150)]
    rows = []
    for i in range(150):
        parts = [text(rng.integers(0, 80)) for _ in range(3)]
        for p in rng.choice(passages, rng.integers(0, 3)):
            parts.insert(rng.integers(0, 4), p)
        rows.append((int(rng.integers(0, 90)) if i % 10 else None, " ".join(parts)))
    rows += [rows[3], rows[14], (500, rows[5][1]), (501, rows[5][1].replace(" ", "  ", 3)), (502, ""), (503, None)]
    got = substring.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_repeats(rows)
    assert len(want) > 60 and {tuple(r[c] for c in ("doc_id", "begin", "end", "first_doc_id")) for r in got} == want


def test_rows_that_share_a_doc_id(spark):
    """A row loses what stands in its own text alone."""
    rng = np.random.default_rng(18)
    text = lambda n: " ".join("".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9))) for _ in range(n))
    shared, other = text(80), text(150)
    rows = [(1, f"{shared} {text(20)}"), (7, f"{text(30)} {shared}"), (7, other), (7, f"{text(30)} {shared}"), (None, shared), (None, shared)]
    out = [(r["doc_id"], r["text"]) for r in substring.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(out) == 6 and (7, other) in out and (1, rows[0][1]) in out and out.count((None, shared)) == 2
    assert sum(len(t.split()) < 60 for d, t in out if d == 7) == 2
