"""Documents to sections and chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T
from .dedup import pack
from .gates import first_reason


#: Headings of what stands before a document's matter.
FRONT_MATTER = r"(?Ui)\b(foreword|scope|references|definitions,? symbols and abbreviations|abbreviations|contents|copyright|change history|document history|introduction|modal verbs terminology)\b"


def chunk_gate(chunks: DataFrame, excluded: list[str], least: int = 40) -> DataFrame:
    """chunks (series, headings, text) with reason: excluded, front_matter, too_short (null: kept)."""
    words = F.size(T.plain_words(F.col("text")))
    return first_reason(chunks, [("excluded", F.col("series").isin(*excluded)), ("front_matter", F.col("headings").rlike(FRONT_MATTER)), ("too_short", words < least)])


#: Where the matter of a specification begins, in markdown and in plain text; lines of images and of contents; headings of clauses and annexes.
SCOPE_HEADING = r"(?Ui)^#+\s*\**\s*(1\.?\s+)?scope\b"
SCOPE_LINE = r"(?Ui)^(\d+(?:\.\d+)*\s+Scope\b.*|Scope)$"
IMAGE = r"^!\[[^\]]*\]\([^)]*\)\s*$"
CONTENTS_LINE = r"\.{5,}"
CLAUSE = r"(?U)^(\d+(?:\.\d+){0,4}\s+\S.*|Annex\s+[A-Z][\w.]*\s*[:(]?\s*.*)$"


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _from(lines: DataFrame, start: str) -> DataFrame:
    """Lines from the first one on that matches start; all lines of a document without one."""
    first = F.min(F.when(F.col("line").rlike(start), F.col("pos"))).over(W.partitionBy("doc_id"))
    return lines.withColumn("_first", F.coalesce(first, F.lit(0))).where("pos >= _first").drop("_first")


def _bodies(lines: DataFrame, *more: str) -> DataFrame:
    """doc_id, section, more, text of sections with a body. lines: head (boolean) marks those that are no body."""
    g = lines.groupBy("doc_id", "section").agg(*[F.max(c).alias(c) for c in more], F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("body"))
    return g.where(F.size("body") > 0).select("doc_id", "section", *more, F.array_join(F.transform("body", lambda x: x["line"]), "\n").alias("text"))


def sections(docs: DataFrame, heading: str = r"^(#{1,4})[ \t]+(.*)$", start: str | None = None, drop: str | None = None) -> DataFrame:
    """doc_id, section, trail (headings from the top level down), text: a section for each heading, and one (0) for what stands before the first; those without a line are none.

    start: the line where the document begins; drop: lines that count for nothing. A document is one group: its lines are ordered.
    """
    lines = _from(_lines(docs), start) if start else _lines(docs)
    if drop:
        lines = lines.where(~F.col("line").rlike(drop))
    w = W.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", heading, 1))).withColumn("title", F.trim(F.regexp_replace(F.regexp_extract("line", heading, 2), r"\*+", "")))
    lines = lines.withColumn("head", F.col("level") > 0).withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    # A level's heading holds until a heading of that level or above comes.
    heads = []
    for n in range(1, 5):
        last = F.last(F.when(F.col("level").between(1, n), F.struct("level", "title")), ignorenulls=True).over(w)
        heads.append(F.when(last["level"] == n, last["title"]))
    return _bodies(lines.withColumn("trail", F.array_compact(F.array(*heads))), "trail")


def clauses(docs: DataFrame, most_words: int = 12) -> DataFrame:
    """doc_id, section, heading, text of plain specifications: from the first Scope on, without blank lines and lines of contents; a clause or annex heading has most_words words at most."""
    lines = _from(_lines(docs).withColumn("line", T.norm_ws(F.col("line"))), SCOPE_LINE).where((F.col("line") != "") & ~F.col("line").rlike(CONTENTS_LINE))
    lines = lines.withColumn("head", F.col("line").rlike(CLAUSE) & (F.size(F.split("line", " ")) <= most_words))
    w = W.partitionBy("doc_id").orderBy("pos")
    lines = lines.withColumn("section", F.sum(F.col("head").cast("int")).over(w)).withColumn("heading", F.coalesce(F.last(F.when(F.col("head"), F.col("line")), ignorenulls=True).over(w), F.lit("")))
    return _bodies(lines, "heading")


def spec_of_path(path: Column) -> tuple[Column, Column]:
    """Release and specification of .../Rel-18/23_series/23501/...: 18 and 23.501; null and the path itself, if it has another form."""
    part = lambda i: F.regexp_extract(path, r"Rel-(\d+)/(\d+)_series/(\d+)", i)
    known = part(1) != ""
    n = F.length(part(2))
    spec = F.concat(F.substr(part(3), F.lit(1), n), F.lit("."), F.substr(part(3), n + 1))
    return F.when(known, part(1).cast("int")), F.when(known, spec).otherwise(path)


def spec_of_file(series: Column, name: Column) -> Column:
    """29.557 of series 29 and file 29557-i20; the series, or ?, without digits."""
    digits, own = F.regexp_extract(name, r"^(\d+)", 1), F.trim(F.coalesce(series, F.lit("")))
    split = lambda n: F.concat(F.substr(digits, F.lit(1), n), F.lit("."), F.substr(digits, n + 1))
    out = F.when(digits == "", F.when(own == "", "?").otherwise(own)).when((own != "") & digits.startswith(own), F.concat(own, F.lit("."), F.substr(digits, F.length(own) + 1)))
    return out.when(F.length(digits) > 2, split(F.lit(2))).otherwise(digits)


def prompt_windows(rows: DataFrame, prompt: str, id_col: str, rule: str = "\n\n---\n\n") -> DataFrame:
    """id_col, place, text of the windows in a prompt "[1] ...", before the rule that parts them from the question."""
    body = F.substring_index(prompt, rule, 1)
    cut = F.split(body, r"(?m)^\[\d+\][ \t\n]")
    return rows.select(id_col, F.posexplode(cut).alias("place", "text")).where("place > 0").select(id_col, "place", F.rtrim(F.regexp_replace("text", r"[\n ]+$", "")).alias("text"))


def heading_chunks(docs: DataFrame, most: int = 800, least: int = 60, share: float = 0.7) -> DataFrame:
    """doc_id, chunk, words, text: sections (or the whole text, with fewer than two headings) cut in pieces of most words, packed until share of it is reached; chunks of fewer than least words go."""
    marks = F.split("text", r"(?m)(?=^#{1,4}[ \t]+\S)")
    parts = docs.select("doc_id", F.when(F.size(marks) < 3, F.array("text")).otherwise(marks).alias("parts")).select("doc_id", F.posexplode("parts").alias("part", "t"))
    words = parts.select("doc_id", "part", T.words(F.col("t")).alias("w")).where("size(w) > 0")
    pieces = words.select("doc_id", "part", F.posexplode(F.expr(f"transform(sequence(0, size(w) - 1, {most}), i -> slice(w, i + 1, {most}))")).alias("piece", "w"))
    g = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece", F.size("w").alias("n"), F.array_join("w", " ").alias("t")))).alias("s")).withColumn("sizes", F.transform("s", lambda x: x["n"]))
    g = g.withColumn("bins", pack("sizes", most * share, 1 << 30)).select("doc_id", F.explode(F.arrays_zip("s", "bins")).alias("x"))
    out = g.groupBy("doc_id", F.col("x.bins").alias("chunk")).agg(F.sum("x.s.n").alias("words"), F.array_sort(F.collect_list(F.struct("x.s.part", "x.s.piece", "x.s.t"))).alias("t"))
    return out.where(F.col("words") >= least).select("doc_id", "chunk", "words", F.array_join(F.transform("t", lambda x: x["t"]), "\n").alias("text"))


def segments(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, place, words, text: pieces of size words, cut after the last sentence that ends in a piece's second half, where one does.

    Each cut depends on the one before it, so a document is worked off in one loop; documents go to Python in Arrow batches.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for doc, words in zip(batch.column("doc_id").to_pylist(), batch.column("w").to_pylist()):
                at = place = 0
                while at < len(words):
                    end = min(at + size, len(words))
                    if end < len(words):
                        end = next((j for j in range(end, at + size // 2, -1) if words[j - 1].endswith(".")), end)
                    rows.append((doc, place, end - at, " ".join(words[at:end])))
                    at, place = end, place + 1
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "place", "words", "text"])

    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), T.words(F.col("text")).alias("w"))
    return w.mapInArrow(run, "doc_id long, place int, words int, text string")


def packed(sections: DataFrame, target: int, most: int) -> DataFrame:
    """doc_id, chunk, words, text: sections of a document packed greedily in order."""
    s = sections.withColumn("words", F.size(T.plain_words(F.col("text"))))
    g = s.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section", "words", "text"))).alias("s")).withColumn("sizes", F.transform("s", lambda x: x["words"]))
    g = g.withColumn("bins", pack("sizes", target, most)).select("doc_id", F.explode(F.arrays_zip("s", "bins")).alias("x"))
    out = g.groupBy("doc_id", F.col("x.bins").alias("chunk")).agg(F.sum("x.s.words").alias("words"), F.array_sort(F.collect_list(F.struct("x.s.section", "x.s.text"))).alias("t"))
    return out.select("doc_id", "chunk", "words", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))


def without_running_lines(pages: DataFrame, share: float = 0.2, edge: int = 3) -> DataFrame:
    """doc_id, page, text: pages without lines that stand in the first or last lines of more than the share of a document's pages; words hyphenated over lines are joined."""
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("n", F.count("*").over(W.partitionBy("doc_id", "page")))
    lines = lines.withColumn("edge", (F.col("pos") < edge) | (F.col("pos") >= F.col("n") - edge))
    total = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    running = lines.where("edge AND trim(line) <> ''").groupBy("doc_id", "line").agg(F.countDistinct("page").alias("on")).join(total, "doc_id").where(F.col("on") > F.greatest(F.lit(1.0), share * F.col("pages"))).select("doc_id", "line", F.lit(True).alias("edge"))
    kept = lines.join(running, ["doc_id", "line", "edge"], "left_anti")
    g = kept.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return g.select("doc_id", "page", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"-\n(?=[a-z])", "").alias("text"))
