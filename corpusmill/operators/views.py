"""Prompts and views of items: templates, rotations, renderings, paraphrase checks, features of an item's shape, JSON out of a model's text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T

RULE = "\n\n---\n\n"


def option_lines(choices: str | Column) -> Column:
    return F.array_join(F.transform(choices, lambda c, i: F.concat(F.chr(i + 65), F.lit(") "), c)), "\n")


def prompts(question: Column, choices: Column, gold: Column, context: Column) -> dict[str, Column]:
    """Variants of one item's prompt: step by step, with a worked example, yes or no for its gold, after a reference note, after retrieved windows, with its gold masked."""
    lines, letters = option_lines(choices), F.array_join(F.transform(choices, lambda c, i: F.chr(i + 65)), ",")
    plain = F.concat(question, F.lit("\n"), lines)
    masked = F.concat(question, F.lit("\n"), option_lines(F.transform(choices, lambda c, i: F.when(i == gold, F.lit("[MASK]")).otherwise(c))))
    return {
        "steps": F.concat(F.lit("Think step by step; the last line is ANSWER: and one of "), letters, F.lit(".\n\n"), plain),
        "example": F.concat(F.lit("Which is first?\nA) one\nB) two\nANSWER: A\n\n"), plain),
        "verify": F.concat(F.lit("Is this true? Reply YES or NO.\n\n"), question, F.lit("\n"), choices[gold]),
        "note": F.concat(F.lit("Reference note:\n"), context, F.lit("\n\n"), plain),
        "windows": F.concat(F.lit("Reference material.\n\n[1] "), context, F.lit(RULE), plain),
        "masked": masked,
    }


def rotations(rows: DataFrame, id_col: str = "sample_id", salt: str = "salt", shift: int = 1) -> DataFrame:
    """convention, shift, choices, answer for each of four conventions: left by a hash of the id, left by a salted one, right by a constant, and every left shift."""
    n = F.size("choices")
    left = lambda s: (F.expr(f"transform(sequence(0, size(choices) - 1), i -> choices[(i + {s}) % size(choices)])"), F.expr(f"pmod(answer - {s}, size(choices))"))
    right = lambda s: (F.expr(f"transform(sequence(0, size(choices) - 1), i -> choices[pmod(i - {s}, size(choices))])"), F.expr(f"(answer + {s}) % size(choices)"))
    rows = rows.withColumn("_own", T.sha_byte(F.col(id_col)) % n).withColumn("_salted", T.sha_byte(F.concat(F.lit(f"{salt}:"), id_col)) % n)
    one = lambda name, s, made: F.struct(F.lit(name).alias("convention"), F.expr(str(s)).cast("int").alias("shift"), made[0].alias("choices"), made[1].alias("answer"))
    fixed = F.array(one("own", "_own", left("_own")), one("salted", "_salted", left("_salted")), one("right", shift, right(shift)))
    every = F.expr("transform(sequence(0, size(choices) - 1), s -> named_struct('convention', 'every', 'shift', s, 'choices', transform(sequence(0, size(choices) - 1), i -> choices[(i + s) % size(choices)]), 'answer', CAST(pmod(answer - s, size(choices)) AS INT)))")
    return rows.select(id_col, F.explode(F.concat(fixed, every)).alias("x")).select(id_col, "x.*")


def rendered(items: DataFrame) -> DataFrame:
    """item_id, view, prompt, completion: qa, reverse and statement of each item (question, evidence, answer, choices, gold, why_wrong), cloze where the evidence has the answer, and mcq with a reason for each wrong option."""
    clean = lambda c: F.regexp_replace(T.norm_ws(T.markup_free(c)), r"[. ]+$", "")
    rows = items.withColumns({"_e": clean(F.col("evidence")), "_a": clean(F.col("answer"))})
    e, a, q = F.col("_e"), F.col("_a"), F.col("question")
    at = F.instr(F.lower(e), F.lower(a))
    has = at > 0
    blank = F.concat(F.expr("substring(_e, 1, instr(lower(_e), lower(_a)) - 1)"), F.lit("____"), F.expr("substring(_e, instr(lower(_e), lower(_a)) + length(_a))"))
    body = lambda joint: F.concat(F.when(has, e).otherwise(F.concat(e, F.lit(joint), a)), F.lit("."))
    reasons = F.array_compact(F.transform("choices", lambda c, i: F.when(i != F.col("gold"), F.concat(F.chr(i + 65), F.lit(") "), c, F.lit(" is wrong.")))))
    options = F.concat(q, F.lit("\n"), option_lines("choices"))
    answer = F.concat(e, F.lit(". "), F.array_join(reasons, " "), F.lit(" ANSWER: "), T.letter(F.col("gold")))
    view = lambda name, prompt, completion: F.struct(F.lit(name).alias("view"), prompt.alias("prompt"), completion.alias("completion"))
    views = F.array(
        view("qa", F.concat(F.lit("Answer in one short phrase.\n\n"), q), body(". ")),
        view("reverse", F.concat(F.lit("It is stated: "), e, F.lit(".\n\nWhat question does this answer?")), q),
        view("statement", F.concat(F.lit("State what settles this: "), q), body(". In short: ")),
        F.when(has & (F.length(a) >= 3), view("cloze", F.concat(F.lit("Complete this. Reply with the missing text only.\n\n"), blank), a)),
        view("mcq", options, answer),
    )
    return rows.select("item_id", F.explode(F.array_compact(views)).alias("x")).select("item_id", "x.*")


def paraphrase_reason(original: Column, rewritten: Column) -> Column:
    """Why a paraphrase is none: empty, multiline, identical, length_ratio, lost_tag, lost_acronym, leaks_answer_language; null if it is fine."""
    found = lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))
    tags, acronyms = r"\[[^\]]+\]", r"(?U)\b[A-Z][A-Z0-9\-]{2,}\b"
    ratio = F.length(rewritten) / F.greatest(F.lit(1), F.length(original))
    out = F.when(F.coalesce(rewritten, F.lit("")) == "", "empty").when(F.trim(rewritten).contains("\n"), "multiline").when(T.norm_tokens(rewritten) == T.norm_tokens(original), "identical").when((ratio < 0.5) | (ratio > 2), "length_ratio")
    out = out.when(~F.forall(found(original, tags), lambda x: rewritten.contains(x)), "lost_tag").when(F.size(F.array_except(found(original, acronyms), found(rewritten, acronyms))) > 0, "lost_acronym")
    return out.when(rewritten.rlike(r"(?Ui)\b(answer|option [A-E1-5]|correct)\b"), "leaks_answer_language")


CATCH_ALL = r"(?Ui)\b(all|none|both) of the (above|these)\b|^(all|none) of them"
NEGATED = r"(?Ui)\b(not|never|cannot|except|incorrect|false|un\w+ed)\b"


def item_shape(rows: DataFrame) -> DataFrame:
    """Adds what an item's form gives away: n_options, catch_all, numeric, negated, gold_longest, gold_shortest, length_ratio, near_duplicates (two options alike to 0.7), overlap_option (the one option most like the question, if there is one) and gold_overlap."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))
    n = F.size("choices")
    lengths = F.transform("choices", F.length)
    rows = rows.withColumn("_w", F.transform("choices", words)).withColumn("_o", F.transform("choices", lambda c: F.size(F.array_intersect(words(c), words(F.col("question"))))))
    top = F.array_max("_o")
    sole = (top > 0) & (F.size(F.filter("_o", lambda x: x == top)) == 1)
    pairs = F.expr("exists(sequence(0, size(_w) - 1), i -> exists(sequence(0, size(_w) - 1), j -> i < j AND size(array_union(_w[i], _w[j])) > 0 AND size(array_intersect(_w[i], _w[j])) >= 0.7 * size(array_union(_w[i], _w[j]))))")
    return rows.withColumns(
        {
            "n_options": n,
            "catch_all": F.exists("choices", lambda c: c.rlike(CATCH_ALL)),
            "numeric": F.size(F.filter("choices", lambda c: c.rlike("[0-9]"))) >= F.greatest(F.lit(2), n - 1),
            "negated": F.col("question").rlike(NEGATED),
            "gold_longest": F.get(lengths, F.col("gold")) == F.array_max(lengths),
            "gold_shortest": F.get(lengths, F.col("gold")) == F.array_min(lengths),
            "length_ratio": F.round(F.array_max(lengths) / F.greatest(F.lit(1), F.array_min(lengths)), 6),
            "near_duplicates": F.when(n > 1, pairs).otherwise(False),
            "overlap_option": F.when(sole, F.array_position("_o", top) - 1).cast("int"),
            "gold_overlap": F.coalesce(F.get("_o", F.col("gold")) == top, F.lit(False)) & (top > 0),
        }
    ).drop("_w", "_o")


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def _scan(text: str):
    """The first balanced [...] outside of strings, parsed; None if it isn't JSON."""
    start = text.find("[")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "[]":
            depth += 1 if c == "[" else -1
            if not depth:
                try:
                    return json.loads(text[start : i + 1])
                except ValueError:
                    return None
    return None


def _last_list(text: str):
    """The last list of objects that begins anywhere, else a stream of bare objects; None if there is neither."""
    decoder = json.JSONDecoder()
    for m in reversed(list(re.finditer(r"\[", text))):
        try:
            value = decoder.raw_decode(text[m.start() :])[0]
        except ValueError:
            continue
        if value and isinstance(value, list) and all(isinstance(x, dict) for x in value):
            return value
    found, at = [], text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text[at:])
        except ValueError:
            break
        found.append(value)
        at = text.find("{", at + end)
    return found or None


@F.pandas_udf(StringType())
def recovered_json(text: pd.Series) -> pd.Series:
    """The list that a model's text holds, as JSON: that of a fenced block or the first balanced one, else the last list of objects or a stream of them; null if there is none. A state machine, so it isn't built of column functions."""

    def find(t: str | None) -> str | None:
        fenced = _FENCE.search(t or "")
        value = _scan(fenced.group(1) if fenced else t or "")
        value = _last_list(t or "") if value is None else value
        return None if value is None else json.dumps(value, sort_keys=True)

    return text.map(find, na_action=None)
