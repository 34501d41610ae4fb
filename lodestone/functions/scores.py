"""Answer scores as column expressions: prediction and gold are string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import boxed, keywords, last_tag, normalize_answer, simple_tokens, words


def exact_match(p: Column, g: Column) -> Column:
    return (normalize_answer(p) == normalize_answer(g)).cast("double")


def _common(p: Column, g: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda a, t: F.size(F.filter(a, lambda x: x == t))
    return F.aggregate(F.array_distinct(p), F.lit(0), lambda acc, t: acc + F.least(count(p, t), count(g, t)))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_answer(c), " "), lambda t: t != "")


def token_f1(p: Column, g: Column) -> Column:
    """(f1, precision, recall) of normalised tokens; yes, no and noanswer must agree as wholes."""
    # an array of one struct holds what is computed once: expressions inside a lambda are evaluated for every element
    once = F.array(F.struct(normalize_answer(p).alias("p"), normalize_answer(g).alias("g"), _tokens(p).alias("a"), _tokens(g).alias("b")))

    def score(x: Column) -> Column:
        same = _common(x["a"], x["b"]).cast("double")
        closed = (x["p"].isin("yes", "no", "noanswer") | x["g"].isin("yes", "no", "noanswer")) & (x["p"] != x["g"])
        precision, recall = same / F.size(x["a"]), same / F.size(x["b"])
        f1 = 2 * precision * recall / (precision + recall)
        zero = F.lit(0.0)
        none = F.struct(zero.alias("f1"), zero.alias("precision"), zero.alias("recall"))
        return F.when(closed | (same == 0), none).otherwise(F.struct(f1.alias("f1"), precision.alias("precision"), recall.alias("recall")))

    return F.transform(once, score)[0]


def substring_match(p: Column, g: Column) -> Column:
    """The normalised gold answer occurs in the normalised prediction."""
    return F.contains(normalize_answer(p), normalize_answer(g)).cast("double")


def set_f1(p: Column, g: Column) -> Column:
    """F1 of the sets of simple tokens."""
    a, b = F.array_distinct(simple_tokens(p)), F.array_distinct(simple_tokens(g))
    same = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(same == 0, F.lit(0.0)).otherwise(2 * same / (F.size(a) + F.size(b)))


def keyword_recall(p: Column, g: Column) -> Column:
    """Share of the comma-separated gold keywords that occur in the prediction, without case; 0 without keywords."""
    k = keywords(F.lower(g))
    hits = F.size(F.filter(k, lambda x: F.contains(F.lower(p), x)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(k).cast("double")), F.lit(0.0))


def digit_label(p: Column, g: Column) -> Column:
    """The boxed or bare prediction is a number equal to the gold label; what isn't a number counts as 0."""
    x = F.regexp_replace(boxed(p), "^['\"]+|['\"]+$", "")
    return (F.when(x.rlike(r"^[0-9]+$"), x).otherwise("0") == F.trim(g)).cast("double")


def containment(p: Column, g: Column) -> Column:
    """The gold answer occurs in the prediction, without case; an empty gold answer scores 1."""
    return F.when(F.coalesce(g, F.lit("")) == "", F.lit(1.0)).otherwise(F.contains(F.lower(p), F.lower(g)).cast("double"))


def any_containment(p: Column, g: Column, separator: str = ";") -> Column:
    """Share of the separated gold parts that occur in the prediction, all without case."""
    parts = F.filter(F.transform(F.split(F.lower(g), separator), lambda x: F.trim(x)), lambda x: x != "")
    hits = F.size(F.filter(parts, lambda x: F.contains(F.lower(p), x)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(parts).cast("double")), F.lit(0.0))


def all_elements(p: Column, g: Column) -> Column:
    """1 if every gold element occurs in the prediction, without case."""
    return F.forall(keywords(F.lower(g)), lambda x: F.coalesce(F.contains(F.lower(p), x), F.lit(False))).cast("double")


def hierarchical_label(p: Column, g: Column) -> Column:
    """Weights .5, .3, .2 of the levels of "a > b > c", up to the first that differs."""
    level = lambda c, i: F.trim(F.coalesce(F.try_element_at(F.split(F.lower(c), ">"), F.lit(i)), F.lit("")))
    same = [level(p, i) == level(g, i) for i in (1, 2, 3)]
    return F.when(~same[0], 0.0).when(~same[1], 0.5).when(~same[2], 0.8).otherwise(1.0)


def tagged_exact(p: Column, g: Column) -> Column:
    """Exact match of the last <answer> body; 0 without one."""
    return F.coalesce(exact_match(last_tag(p, "answer"), g), F.lit(0.0))


def judge_label(response: Column) -> Column:
    """A judge's yes without no."""
    x = F.lower(response)
    return (F.contains(x, F.lit("yes")) & ~F.contains(x, F.lit("no"))).cast("double")


def word_overlap(p: Column, g: Column) -> Column:
    """Number of different words of both."""
    return F.size(F.array_intersect(words(p), words(g)))


#: Ordered rules (substring of the source, score); the first that fits holds, the default is the substring match.
DISPATCH = (("keyword", keyword_recall), ("label", digit_label), ("detective", containment), ("niah", all_elements), ("multihop", lambda p, g: token_f1(p, g)["f1"]))


def by_source(source: Column, p: Column, g: Column) -> Column:
    """Score of the rule that fits the source."""
    chain = None
    for part, score in DISPATCH:
        hit = F.contains(source, F.lit(part))
        chain = F.when(hit, score(p, g)) if chain is None else chain.when(hit, score(p, g))
    return chain.otherwise(substring_match(p, g))
