"""Text functions on columns: all of them are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words in the sense of Unicode: letters, digits and the underscore.
WORD = r"[\p{L}\p{N}_]+"

#: Fixed value: short listener responses; "mmmhm" is one entry.
BACKCHANNELS = ("yeah", "yes", "right", "okay", "ok", "sure", "uh-huh", "mm-hmm", "mmmhm", "ja", "genau", "gut", "oui", "voilà", "d'accord")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c: str | Column) -> Column:
    """Lower-case words of a text; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(WORD), F.lit(0))


def token_estimate(c: str | Column) -> Column:
    """Four characters a token."""
    return F.floor(F.length(F.coalesce(col(c), F.lit(""))) / 4).cast("long")


def normalize_answer(c: str | Column) -> Column:
    """Lower case without ASCII punctuation and English articles, single blanks."""
    x = F.regexp_replace(F.lower(col(c)), r"\p{Punct}", "")
    x = F.regexp_replace(x, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def spaced_normal(c: str | Column) -> Column:
    """Lower case with blanks for ASCII punctuation, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"\p{Punct}", " "), r"\s+", " "))


def strip_punctuation(c: str | Column, by: str = "") -> Column:
    return F.regexp_replace(col(c), r"\p{Punct}", by)


def simple_tokens(c: str | Column) -> Column:
    """Lower-case blank-separated tokens, with . , ! ? as blanks."""
    return F.filter(F.split(F.translate(F.lower(col(c)), ".,!?", "    "), r"\s+"), lambda w: w != "")


def after_answer_prefix(c: str | Column) -> Column:
    """What follows "Answer:" on its line, else the first line; trimmed."""
    x = col(c)
    found = F.regexp_extract(x, r"(?i)answer:\s*([^\n]*)", 1)
    picked = F.when(x.rlike(r"(?i)answer:"), found).otherwise(F.substring_index(x, "\n", 1))
    return F.trim(F.regexp_replace(F.trim(picked), r"(?i)^(answer:\s*)+", ""))


def boxed(c: str | Column) -> Column:
    r"""Content of the first \boxed{...} without inner braces, else the trimmed text."""
    x = col(c)
    return F.when(x.rlike(r"\\boxed\{[^}]*\}"), F.trim(F.regexp_extract(x, r"\\boxed\{([^}]*)\}", 1))).otherwise(F.trim(x))


def after_thinking(c: str | Column) -> Column:
    """The part between the first and second </think>; "Empty" where an opened thought never ends."""
    x = col(c)
    rest = F.when(F.contains(x, F.lit("</think>")), F.split_part(x, F.lit("</think>"), F.lit(2))).otherwise(x)
    return F.when(F.contains(rest, F.lit("<think>")), F.lit("Empty")).otherwise(F.trim(rest))


def first_tag(c: str | Column, tag: str) -> Column:
    """Trimmed body of the first <tag>...</tag>; an empty string without one."""
    return F.trim(F.regexp_extract(col(c), rf"(?s)<{tag}>(.*?)</{tag}>", 1))


def last_tag(c: str | Column, tag: str) -> Column:
    """Trimmed body of the last <tag>...</tag>; null without one."""
    found = F.regexp_extract_all(col(c), F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return F.trim(F.try_element_at(found, F.lit(-1)))


def tags_balanced(c: str | Column, tag: str) -> Column:
    """As many opening as closing tags, and the first opening before the first closing one."""
    x = col(c)
    count = lambda t: (F.length(x) - F.length(F.replace(x, F.lit(t), F.lit("")))) / len(t)
    return (count(f"<{tag}>") == count(f"</{tag}>")) & (F.instr(x, f"<{tag}>") <= F.instr(x, f"</{tag}>"))


def backchannel_words(c: str | Column) -> Column:
    """Number of words if a turn has at most four words, all of them listener responses; else 0."""
    w = F.filter(F.split(F.trim(F.regexp_replace(F.lower(col(c)), r"[.,!?]", "")), r"\s+"), lambda x: x != "")
    known = F.forall(w, lambda x: x.isin(*BACKCHANNELS))
    return F.when((F.size(w) >= 1) & (F.size(w) <= 4) & known, F.size(w)).otherwise(0)


def last_number(c: str | Column) -> Column:
    """The number after ####, else the last number of a text, without thousands separators."""
    x = col(c)
    found = F.regexp_extract_all(x, F.lit(r"(-?[0-9][0-9.,]*)"), F.lit(1))
    marked = F.regexp_extract(x, r"####\s*(-?[0-9.,]+)", 1)
    return F.regexp_replace(F.when(marked != "", marked).otherwise(F.try_element_at(found, F.lit(-1))), "[,.]+$|,", "")


def numbered_block(items: Column) -> Column:
    """"1. first", "2. second" ... on lines of their own."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def lines_after_facts(c: str | Column) -> Column:
    """A line break before each numbered fact that follows a sentence."""
    return F.regexp_replace(col(c), r"(\.) (\d+\. )", "$1\n$2")


def capitalized(c: str | Column) -> Column:
    """First character in upper case, the rest in lower case."""
    return F.concat(F.upper(F.substring(col(c), 1, 1)), F.lower(F.substring(col(c), 2, 1_000_000_000)))


def safe_name(c: str | Column) -> Column:
    return F.translate(col(c), ".-", "__")


def keywords(c: str | Column) -> Column:
    """Comma-separated entries, trimmed, blanks left out."""
    return F.filter(F.transform(F.split(col(c), ","), lambda k: F.trim(k)), lambda k: k != "")


def final_answer(c: str | Column) -> Column:
    """A mathematical final answer in a plain form: no units, dollar signs, text commands and thousands separators."""
    x = F.element_at(F.split(col(c), "="), -1)
    x = F.regexp_replace(x, r"\\text\{([^}]*)\}|\\textbf\{([^}]*)\}|\\boxed\{([^}]*)\}|\\overline\{([^}]*)\}", "$1$2$3$4")
    x = F.regexp_replace(x, r"(^| )(?:an|a) | percent| dollars| units| degrees|\\\$|\$|%|\\ ", "$1")
    x = F.regexp_replace(x, r"(\d),(?=\d{3}\b)", "$1")
    return F.trim(x)


def take_last(tokens: Column, n: int) -> Column:
    """The last n tokens of an array."""
    return F.when(F.size(tokens) <= n, tokens).otherwise(F.slice(tokens, -n, n))


def take_middle(tokens: Column, n: int) -> Column:
    """The first and last halves of n tokens."""
    left, right = n // 2, n - n // 2
    return F.when(F.size(tokens) <= n, tokens).otherwise(F.concat(F.slice(tokens, 1, left), F.slice(tokens, -right, right)))
