"""Column expressions over token and sentence text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from stayline.functions import lexicon as lex
from stayline.sources.watch_log import WS

CJK = r"[\x{3400}-\x{9FFF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"


#: ``WS`` for Java: one test rules out nearly all other characters, where ``WS`` alone goes through its ranges for each
SPACE = r"[[^!-~\x{a1}-\x{167f}\x{3001}-\x{d7ff}]&&" + WS + "]"


def strs(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


#: the characters of ``WS``, for trimming without a regex
WS_CHARS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def words_of(text: Column) -> Column:
    """Whitespace-separated pieces, empty ones removed."""
    return F.filter(F.split(text, SPACE + "+"), lambda x: x != "")


def tokens(text: Column) -> Column:
    """Lower-cased pieces without surrounding punctuation."""
    bare = F.transform(F.split(text, SPACE + "+"), lambda x: F.lower(F.btrim(x, F.lit(lex.PUNCT))))
    return F.filter(bare, lambda x: x != "")


def join_tokens(words: Column) -> Column:
    """Space-join, except between two CJK characters."""
    joined = F.array_join(words, " ")
    # one byte a character: none is CJK
    return F.when(F.octet_length(joined) == F.length(joined), joined).otherwise(
        F.regexp_replace(joined, f"(?<={CJK}) (?={CJK})", "")
    )


def is_terminal(token: Column) -> Column:
    """Ends a sentence: last character after closing marks, abbreviations excluded."""
    # most tokens are told by their last character alone
    may = token.substr(F.lit(-1), F.lit(1)).isin([*lex.TERMINALS, *lex.CLOSERS])
    bare = F.rtrim(token, F.lit(lex.CLOSERS))
    return may & F.right(bare, F.lit(1)).isin(lex.TERMINALS) & ~F.lower(bare).isin(lex.ABBREVIATIONS) & (bare != "")


def bround3(t: Column) -> Column:
    """As ``bround(t, 3)``. Away from ties a whole number of thousandths is the same double, without decimal digits."""
    x = t * 1000
    plain = (F.abs(t) < 1e6) & (F.abs(x - F.rint(x)) < 0.499)
    return F.when(plain, F.rint(x) / 1000 + 0.0).otherwise(F.bround(t, 3))


def filler_pattern() -> str:
    """One alternation over space-padded tokens: phrases (longest first), words, opening words.
    Leftmost-first matching is exactly the greedy left-to-right scan."""
    phrases = sorted({tuple(p.split()) for p in lex.flat(lex.FILLER_PHRASES)}, key=lambda p: (-len(p), p))
    parts = [" " + "  ".join(re.escape(w) for w in p) + " " for p in phrases]
    parts += [f" {re.escape(w)} " for w in lex.flat(lex.FILLER_WORDS)]
    parts += [f"^ {re.escape(w)} " for w in lex.flat(lex.FILLER_INITIAL)]
    # re.escape protects spaces, which regex engines other than Python's may refuse
    return "(" + "|".join(parts).replace("\\ ", " ").replace("\\'", "'") + ")"


def fillers(toks: Column) -> Column:
    padded = F.concat(F.lit(" "), F.array_join(toks, "  "), F.lit(" "))
    found = F.regexp_extract_all(padded, F.lit(filler_pattern()), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(F.trim(x), "  ", " "))


def repeated_words(toks: Column) -> Column:
    """Adjacent equal tokens."""
    return F.size(F.filter(F.zip_with(toks, F.slice(toks, F.lit(2), F.greatest(F.size(toks), F.lit(1))), lambda a, b: a == b), lambda x: x))


def is_question(text: Column) -> Column:
    s = F.rtrim(strip(text), F.lit(lex.QUESTION_CLOSERS))
    toks = tokens(s)
    first, last = F.get(toks, F.lit(0)), F.get(toks, F.size(toks) - 1)
    opened = first.isin(lex.flat(lex.INTERROGATIVES)) | last.isin(lex.flat(lex.QUESTION_TAGS))
    return (
        F.when(s.endswith("?"), True)
        .when(F.right(s, F.lit(1)).isin(".", "!", "।"), False)
        .otherwise(F.coalesce(opened, F.lit(False)))
    )


#: digits as Python's str.isdigit sees them: decimal digits plus super- and subscripts
DIGIT = r"[\p{Nd}\x{b2}\x{b3}\x{b9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]"


def has_number_claim(toks: Column) -> Column:
    words = lex.flat(lex.NUMBER_WORDS)
    return F.exists(toks, lambda x: x.rlike(DIGIT) | x.isin(words))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """a / b rounded, NULL when b is 0."""
    return F.bround(F.try_divide(a, F.nullif(b, F.lit(0))), digits)
