"""Column functions on raw text: words, sentences, clean-up, quote offsets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def words(text: str | Column) -> Column:
    """ASCII words in order, lower-cased. Null gives null."""
    return F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.lower)


def sentences(text: str | Column) -> Column:
    """Stretches between full stops, exclamation and question marks that hold a letter, trimmed of blanks and line ends."""
    parts = F.regexp_extract_all(text, F.lit(r"[^.!?]*[A-Za-z][^.!?]*"), F.lit(0))
    return F.transform(parts, lambda s: F.regexp_replace(s, r"^[ \n]+|[ \n]+$", ""))


def count_of(text: Column, part: str) -> Column:
    """Occurrences of one character."""
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


#: Substitutions of the quote normaliser, applied in order: opening quotes by what stands before them, closing ones by what follows.
QUOTE_RULES = (
    (' "', " ``"), ('(?md)^"', "``"), (r'\("', "(``"), ('\t"', "\t``"), ('(?md)"$', "''"), ('" ', "'' "), (r'"\)', "'')"), ('",', "'',"),
)

#: Opt-in clean-up of reports, applied in order: footnotes, strings of dashes, ellipses, labels of questions and answers,
#: line ends with dashes, lines that end in capitals, lines with a speaker's name, titles stuck to the end of a sentence.
CLEANUP_RULES = (
    (r"\\[0-9][0-9]*\\", " "), (r"[-_.]{5,}", " "), (r" \. \. \.", " ... "), (r"Q\.[0-9][0-9]*(\.[a-z])?\.", "."), (r"A\.[0-9][0-9]*\.", " "), (r"(?md)([A-Za-z0-9]-{2,4})$", "$1."),
    (r"(?md)([A-Z][A-Z,. ]{9,})$", "\n$1."), (r"(?md)^([A-Z][A-Za-z. ]{1,55}):$", "$1."), (r"(?md)([A-Za-z]{3,})\.(([A-Z][A-Za-z]*)( [A-Z][A-Za-z]*){1,8}\??)$", "$1.\n\n$2."),
)


def rewrite(text: str | Column, rules) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for pattern, by in rules:
        out = F.regexp_replace(out, pattern, by)
    return out


def before_appendix(text: str | Column) -> Column:
    """The text up to the line with the spaced-out word APPENDIX."""
    return F.regexp_replace(text, r"(?md)^.*A P P E N D I X(?s:.*)", "")


def shift_by_quotes(text: Column, index: Column) -> Column:
    """An offset in a text whose double quotes became two characters each: the offset plus the number of quotes before it."""
    return index + count_of(F.substring(text, F.lit(1), index), '"')


def contiguous(indices: str | Column) -> Column:
    """Whether an index array has no gaps. Empty and null arrays count as contiguous."""
    c = F.col(indices) if isinstance(indices, str) else indices
    return F.coalesce(F.array_max(c) - F.array_min(c) + 1 == F.size(c), F.lit(True))


def log_bin(x: str | Column) -> Column:
    """``round(ln(10 (x + 1)))``, half away from zero."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(F.log(10 * (c + 1))).cast("long")


def distance(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x))


def _dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """One less the cosine; null if either has no length."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return 1 - F.when(norms > 0, _dot(a, b) / norms)


def relative_position(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    return F.when(a_last < b_first, "Before").when(a_first > b_last, "After").otherwise("Overlapping")
