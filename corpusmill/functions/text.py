"""Column builders for text: normalisers, tokens, shingles, windows, hashes, answer parsing, option rotation."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

LETTERS = "ABCDEFGHIJ"
#: White space as scripts see it, Unicode's and four separators; in a Java pattern after (?U).
SPACE = r"[\s\x1c-\x1f]"


# Normalisers. They differ on purpose; each operator names the one it uses.
def norm_ws(c: Column) -> Column:
    """White space (Unicode's, too) collapsed and stripped; case kept."""
    return F.trim(F.regexp_replace(c, f"(?U){SPACE}+", " "))


def norm_ws_lower(c: Column) -> Column:
    return norm_ws(F.lower(c))


def norm_tag_deleted(c: Column) -> Column:
    """[tags] removed, then as norm_ws, lower case."""
    return F.lower(norm_ws(F.regexp_replace(c, r"\[[^\]]*\]", "")))


def norm_tag_spaced(c: Column) -> Column:
    """[tags] replaced by a space, then as norm_ws, lower case."""
    return F.lower(norm_ws(F.regexp_replace(c, r"\[[^\]]*\]", " ")))


def norm_punct(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}_\s.\-]", " "), f"(?U){SPACE}+", " "))


def norm_tokens(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), " ")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def norm_nfkc(c: Column) -> Column:
    """NFKC, lower case, collapsed; Spark has no NFKC, so an Arrow function does that part."""
    return norm_ws(F.lower(_nfkc(c)))


# Tokens. The stop lists are fixed values; each operator names the one it uses.
COVERAGE_STOP = """the and for with that this from are was were has have been which what
when where how why can could should would may might must not all any each between
following true false none above about into over under more most less least other
than then them they their there here also does doing done being its it's used use
using two one three four five per only such same different means term terms refer
refers defined define definition option options answer question correct""".split()
RETRIEVAL_STOP = """the and for that with this are was which from has have not can may shall will its their than
when what which where how why who does did any all one two following above below used use using
purpose main key type types based into such other""".split()
CONTAINMENT_STOP = """the and for that with this are was which from has have not can may shall will its their than
when what where how why who does did any all one two following above below used use using such
purpose main key type types based into other correct answer option because refers statement true false""".split()
CEILING_STOP = """the and for are that this with from not can used use which when what does his her its was were has have had
will would should could may might must shall all any other than then there these those such only also more most some one
two into over under between within during after before above below each both same different using based provide provides
provided following above.""".split()


def all_terms(c: Column) -> Column:
    """Tokens of three or more characters with dots and hyphens inside, stop words included."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9][a-z0-9.\-]{2,}"), F.lit(0))


def content_terms(c: Column, stop: list[str] = RETRIEVAL_STOP) -> Column:
    """all_terms, distinct, without stop words."""
    return F.array_except(all_terms(c), F.array(*[F.lit(w) for w in dict.fromkeys(stop)]))


def coverage_terms(c: Column) -> Column:
    """Distinct terms of a text without its [tags], by the coverage stop list."""
    return content_terms(F.regexp_replace(c, r"\[[^\]]*\]", " "), COVERAGE_STOP)


def scan_words(c: Column) -> Column:
    """Words of a text whose [tags] are deleted, lower case, between any white space."""
    return F.array_remove(F.split(norm_tag_deleted(c), " "), "")


def plain_words(c: Column) -> Column:
    """Lower-cased words between white space."""
    return F.array_remove(F.split(F.lower(c), r"[ \t\n\r\f]+"), "")


def words(c: Column) -> Column:
    """Words between any white space, case kept."""
    return F.array_remove(F.split(norm_ws(c), " "), "")


def shingles(words: str, k: int) -> Column:
    """Runs of k words of the array column, space-joined, repeats included; none if there are fewer words."""
    return F.expr(f"CASE WHEN size({words}) < {k} THEN array() ELSE transform(sequence(1, size({words}) - {k - 1}), i -> array_join(slice({words}, i, {k}), ' ')) END")


def tail(words: str, k: int) -> Column:
    """The last k words (all, if fewer), space-joined."""
    return F.expr(f"array_join(slice({words}, greatest(1, size({words}) - {k - 1}), {k}), ' ')")


def word_windows(words: str, size: int, stride: int) -> Column:
    """Array of (start, words) windows; a short last one stays if it has a third of the size, the first one always."""
    return F.expr(
        f"""CASE WHEN size({words}) = 0 THEN array() ELSE filter(transform(sequence(0, size({words}) - 1, {stride}), s -> struct(s AS start, slice({words}, s + 1, {size}) AS words)),
            x -> x.start = 0 OR size(x.words) * 3 >= {size}) END"""
    )


# Keyed draws: they depend on a salt and an id only, never on order or partitioning.
def h01(salt: str | Column, key: Column) -> Column:
    """Uniform in [0, 1): the first 64 bits of SHA-256 of salt|key."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.sha2(F.concat(salt, F.lit("|"), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def sha_byte(text: Column) -> Column:
    """The first byte of SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int")


def hash_order(salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt + "|"), key.cast("string")), 256)


def content_id(c: Column) -> Column:
    """Id made of the content: 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def content_key(question: Column, choices: Column) -> Column:
    """MD5 over the normalised question and its sorted normalised options."""
    return F.md5(F.concat_ws("|", norm_ws_lower(question), F.array_join(F.array_sort(F.transform(choices, norm_ws_lower)), "|")))


# Answers. What the patterns accept is fixed by the published harness: the capture is letters, digits, blanks and commas, white
# space may be a line feed, and only a text's start is looked at for a bare letter.
STRICT = rf"(?Uimd)^ANSWER{SPACE}*:{SPACE}*([A-Za-z\p{{Nd}} ,]+){SPACE}*(?:$|\n|\.)"
LOOSE = rf"(?Uid)ANSWER{SPACE}*:{SPACE}*([A-Za-z\p{{Nd}} ,]+)(?:[^\p{{L}}\p{{N}}_]|$)"
BARE = r"(?Ud)^[\s\x1c-\x1f]*([A-Ea-e])(?:[).:,\s\x1c-\x1f]|$)"


def parse_letter(completion: Column, n: Column, bare: bool = True) -> Column:
    """What the last strict match says, else the last loose one, else (bare) a letter that the text begins with; '' unless it is one of the first n letters."""
    text = F.coalesce(completion, F.lit(""))
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))
    found = F.upper(F.trim(F.coalesce(*[last(x) for x in (STRICT, LOOSE, *([BARE] if bare else []))], F.lit(""))))
    place = F.instr(F.lit(LETTERS), found)
    return F.when((F.length(found) == 1) & (place > 0) & (place <= n), found).otherwise("")


#: Places where a broken completion names its letter, in the order in which they are tried.
_OPTION = rf"{SPACE}*\**{SPACE}*\(?([A-E])"
RECOVERY = [
    rf"(?U)\bANSWER:{SPACE}*\**{SPACE}*([A-E])\b",
    rf"(?Ui)correct answer is{_OPTION}\)?[).*: ]",
    rf"(?Ui)answer is{_OPTION}\)?[).*: ]",
    rf"(?Umd)^{_OPTION}\)[\s\x1c-\x1f*]",
    rf"(?Ui)option{_OPTION}\)?\b[^.]{{0,40}}\bis (?:the )?correct",
]


def recover_letter(completion: Column) -> Column:
    """Letter of a broken format: the first pattern that hits, and its first hit; '' if none does."""
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(completion, p, 1), F.lit("")) for p in RECOVERY], F.lit("")))


#: A shorter contract: letters A to E only, at a line's begin or anywhere after the marker.
KIT_STRICT = rf"(?Uimd)^ANSWER{SPACE}*:{SPACE}*([A-E]){SPACE}*(?:$|\n|\.)"
KIT_LOOSE = rf"(?Ui)ANSWER{SPACE}*:{SPACE}*([A-E])"
KIT_ABSTAIN = rf"(?U)ANSWER{SPACE}*:{SPACE}*\**{SPACE}*([A-EX])\b"


def parse_kit(completion: Column, n: Column) -> Column:
    """0-based place of the last letter of the shorter contract, -1 if there is none among the first n."""
    text = F.coalesce(completion, F.lit(""))
    last = lambda pattern: F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))
    found = F.ascii(F.upper(F.coalesce(last(KIT_STRICT), last(KIT_LOOSE)))) - 65
    return F.when(found.between(0, n - 1), found).otherwise(-1)


def parse_abstaining(completion: Column) -> Column:
    """The last letter A to E, or X for an abstention; ? if there is none."""
    found = F.regexp_extract_all(F.upper(F.coalesce(completion, F.lit(""))), F.lit(KIT_ABSTAIN), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit("?"))


#: Buckets of provenance, in the order in which they are tried.
BUCKETS = [("3gpp", r"(?Ui)\[3gpp\b|\brelease\s+\d{1,2}\b"), ("ieee", r"(?Ui)\[ieee\b|\b802\.\d"), ("tcpip", r"(?Ui)\[tcp/ip\]|\brfc\s*\d+")]


def bucket(question: Column) -> Column:
    out = F
    for name, pattern in BUCKETS:
        out = out.when(question.rlike(pattern), F.lit(name))
    return out.otherwise("untagged")


def last_tag(question: Column) -> Column:
    """3GPP, IEEE and the standard's name, or the first 24 characters of a question's last [tag]; "(no tag)" without one."""
    tag = F.try_element_at(F.regexp_extract_all(question, F.lit(r"\[([^\]]+)\]"), F.lit(1)), F.lit(-1))
    named = F.when(tag.contains("Release") | tag.contains("3GPP"), "3GPP").when(tag.contains("IEEE"), F.concat(F.lit("IEEE "), F.element_at(F.split(F.trim(tag), r"\s+"), -1)))
    return F.coalesce(named.otherwise(F.substring(tag, 1, 24)), F.lit("(no tag)"))


def release(question: Column) -> Column:
    """The release number of a [3GPP Release N] tag; null without one."""
    found = F.regexp_extract(question, r"\[3GPP Release (\d+)\]", 1)
    return F.when(found != "", found.cast("int"))


def giveaway(explanation: Column, gold: Column, distractors: Column, stop: list[str] = CEILING_STOP) -> tuple[Column, Column]:
    """Share of the gold's terms that the explanation has, and how much that is above the best distractor's; 0 and 0 if the gold has no terms."""
    e, g = content_terms(explanation, stop), content_terms(gold, stop)
    share = lambda x: F.when(F.size(x) > 0, F.size(F.array_intersect(x, e)) / F.size(x)).otherwise(0.0)
    best = F.greatest(F.lit(0.0), F.array_max(F.transform(distractors, lambda d: share(content_terms(d, stop)))))
    none = F.size(g) == 0
    return F.when(none, 0.0).otherwise(F.bround(share(g), 4)), F.when(none, 0.0).otherwise(F.bround(share(g) - best, 4))


def span_prefix(text: Column, span: Column, least: int = 15) -> Column:
    """What stands before the span's first place, from the last sentence's or line's end on; null if the span isn't there or that is shorter than least."""
    at = F.instr(F.lower(text), F.lower(span))
    before = F.substr(text, F.lit(1), at - 1)
    stop, feed = F.instr(F.reverse(before), " ."), F.instr(F.reverse(before), "\n")
    start = F.greatest(F.lit(1), F.when(stop > 0, F.length(before) - stop + 1), F.when(feed > 0, F.length(before) - feed + 2))
    found = F.regexp_replace(F.substr(before, start), f"(?U)^{SPACE}+|{SPACE}+$", "")
    return F.when((at > 0) & (F.length(found) >= least), found)


def letter(index: Column) -> Column:
    return F.chr(index + 65)


def render_prompt(question: Column, choices: Column, separator: str = ",") -> Column:
    lines = F.transform(choices, lambda c, i: F.concat(F.chr(i + 65), F.lit(") "), c))
    names = F.array_join(F.transform(choices, lambda c, i: F.chr(i + 65)), separator)
    return F.concat(F.lit("Answer with one of "), names, F.lit(".\n\n"), question, F.lit("\n"), F.array_join(lines, "\n"))


def rotate_left(choices: str, shift: str) -> Column:
    return F.expr(f"transform(sequence(0, size({choices}) - 1), i -> {choices}[(i + {shift}) % size({choices})])")


def rotate_right(choices: str, shift: str) -> Column:
    return F.expr(f"transform(sequence(0, size({choices}) - 1), i -> {choices}[pmod(i - {shift}, size({choices}))])")


def heuristic_index(choices: str) -> Column:
    """No model: the first "All of the above", else the first "Both ...", else the longest option that isn't "None of the above" (ties: the first)."""
    return F.expr(
        f"""coalesce(nullif(array_position(transform({choices}, c -> lower(c) LIKE 'all of the above%'), true), 0) - 1,
            nullif(array_position(transform({choices}, c -> lower(c) LIKE 'both %'), true), 0) - 1,
            -array_max(transform({choices}, (c, i) -> struct(CASE WHEN lower(c) LIKE 'none of the above%' THEN -1 ELSE length(c) END AS n, -i AS i))).i)"""
    ).cast("int")


# Overlap of token sets.
def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def support(terms: Column, context: Column) -> Column:
    """Share of distinct terms that the context has; null without terms."""
    own = F.array_distinct(terms)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, context)) / F.size(own))


def token_f1(a: str, b: str) -> Column:
    """F1 of two token arrays as multisets; 0 if they share none."""
    both = f"aggregate(array_distinct({a}), 0D, (s, t) -> s + least(size(filter({a}, x -> x = t)), size(filter({b}, x -> x = t))))"
    return F.expr(f"CASE WHEN size({a}) + size({b}) = 0 THEN 0D ELSE 2 * {both} / (size({a}) + size({b})) END")


def markup_free(c: Column) -> Column:
    """LaTeX and markdown marks removed."""
    return norm_ws(F.regexp_replace(F.regexp_replace(c, r"\\[a-zA-Z]+\{([^}]*)\}", "$1"), r"[*_`$#]+", ""))


def drop_sentences(c: Column, pattern: str) -> Column:
    return F.array_join(F.filter(F.split(c, r"(?<=[.!?])\s+|\n+"), lambda x: ~x.rlike(pattern)), " ")


def json_lines(c: Column) -> Column:
    """The lines that are JSON objects, without the commas between them."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^[ ,]+|[ ,]+$", ""))
    return F.filter(lines, lambda x: x.startswith("{") & x.endswith("}") & F.try_parse_json(x).isNotNull())
