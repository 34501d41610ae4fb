"""Text metrics without a built-in expression, as plain functions and Arrow-batched column functions."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"[a-z0-9]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, in memory of the shorter list."""
    if len(a) < len(b):
        a, b = b, a
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _f(same: int, n: int, m: int) -> float:
    return 0.0 if not same else 2 * same / (n + m)


def rouge_l(prediction: str | None, gold: str | None) -> float:
    """F1 of the longest common subsequence of words, without stemming."""
    a, b = tokens(prediction), tokens(gold)
    return _f(lcs_length(a, b), len(a), len(b)) if a and b else 0.0


def rouge_n(prediction: str | None, gold: str | None, n: int) -> float:
    """F1 of the n-grams as multisets."""
    grams = lambda t: Counter(zip(*(t[i:] for i in range(n))))
    a, b = grams(tokens(prediction)), grams(tokens(gold))
    return _f((a & b).total(), a.total(), b.total()) if a and b else 0.0


def rouge_mean(prediction: str | None, gold: str | None) -> float:
    return (rouge_n(prediction, gold, 1) + rouge_n(prediction, gold, 2) + rouge_l(prediction, gold)) / 3


def bleu(prediction: str | None, gold: str | None, order: int = 4) -> float:
    """Sentence BLEU; a precision without any match counts as 0.1 matches."""
    a, b = tokens(prediction), tokens(gold)
    if not a or not b:
        return 0.0
    logs = 0.0
    for n in range(1, order + 1):
        x, y = Counter(zip(*(a[i:] for i in range(n)))), Counter(zip(*(b[i:] for i in range(n))))
        same = (x & y).total()
        if n == 1 and not same:
            return 0.0
        logs += math.log((same or 0.1) / max(1, x.total()))
    return min(1.0, math.exp(1 - len(b) / len(a))) * math.exp(logs / order)


def balanced_box(text: str | None) -> str | None:
    r"""Content of the last \boxed{...} (or \fbox) with matching braces; null without one."""
    text = text or ""
    at = max(text.rfind("\\boxed{"), text.rfind("\\fbox{"))
    if at < 0:
        return None
    start = text.index("{", at)
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "{") - (text[i] == "}")
        if depth == 0:
            return text[start + 1 : i]
    return None


def json_object(text: str | None) -> str | None:
    """The first complete {...} of a text, braces in strings not counting; null without one."""
    text = text or ""
    start = text.find("{")
    depth, inside, escaped = 0, False, False
    for i in range(max(start, 0), len(text)):
        c = text[i]
        if inside:
            inside, escaped = (c != '"' or escaped), (c == "\\" and not escaped)
        elif c == '"':
            inside = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0 and start >= 0:
                return text[start : i + 1]
    return None


def repaired_json(text: str | None) -> str | None:
    """A JSON object with bare values quoted, trailing commas dropped and missing braces closed; null if it still doesn't parse."""
    if text is None:
        return None
    x = text.strip()
    for attempt in range(3):
        try:
            return json.dumps(json.loads(x), ensure_ascii=False, sort_keys=True)
        except ValueError:
            if attempt == 0:
                x = re.sub(r",\s*([}\]])", r"\1", x)
            elif attempt == 1:
                x = re.sub(r'(:\s*)(?!true\b|false\b|null\b|-?\d)([^"\[\]{},\s][^,}\]]*)', lambda m: m[1] + json.dumps(m[2].strip()), x)
                x = re.sub(r",\s*$", "", x) + "}" * max(0, x.count("{") - x.count("}"))
    return None


def plain_latex(text: str | None) -> str | None:
    """Fractions as (a)/(b), roots as sqrt(a), without units, degrees, percent signs and blanks."""
    if text is None:
        return None
    x = re.sub(r"\\(?:left|right|!|,|;|%|\$)", "", text)
    x = re.sub(r"\\[dt]?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", x)
    x = re.sub(r"\\[dt]?frac(\d)(\d)", r"(\1)/(\2)", x)
    x = re.sub(r"\\sqrt\{([^{}]*)\}", r"sqrt(\1)", x)
    x = re.sub(r"\\sqrt(\w)", r"sqrt(\1)", x)
    x = re.sub(r"\\text\{[^{}]*\}|\^\{?\\circ\}?|%|\\%|\s", "", x)
    return re.sub(r"^0+(?=\d)|(?<=\d)\.0+$", "", x)


def same_math(prediction: str | None, gold: str | None) -> float:
    """1 if two final answers are the same text in plain form or the same number."""
    a, b = plain_latex(balanced_box(prediction) or prediction), plain_latex(gold)
    if a is None or b is None:
        return 0.0
    if a == b:
        return 1.0
    try:
        return float(abs(float(a.replace(",", "")) - float(b.replace(",", ""))) < 1e-9)
    except ValueError:
        return 0.0


def objectives_score(prediction: str | None, golds: str | None) -> float:
    """Sum over ;-separated positions of the exact match; 0 where the numbers of positions differ."""
    a, b = [[y.strip().lower() for y in (x or "").split(";")] for x in (prediction, golds)]
    return float(sum(x == y for x, y in zip(a, b))) if len(a) == len(b) else 0.0


def peak_and_dependency(text: str | None) -> tuple[int, int]:
    """Of a trajectory of tagged steps: words of the longest step, and the sum over steps of all words before them."""
    steps = [len(s.split()) for s in re.findall(r"(?s)<(?:think|search|information)>(.*?)</", text or "")]
    before = total = 0
    for n in steps:
        total += before
        before += n
    return max(steps, default=0), total


def of_two(f, kind: str = "double"):  # noqa: ANN001, ANN201
    """A function of two strings as a column function on Arrow batches."""

    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x if isinstance(x, str) else None, y if isinstance(y, str) else None) for x, y in zip(a, b)])

    return run


def of_one(f, kind: str = "string"):  # noqa: ANN001, ANN201
    """A function of one string as a column function on Arrow batches."""

    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([f(x if isinstance(x, str) else None) for x in a], dtype=object if kind == "string" else None)

    return run


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of an array: logsumexp - sum of p x."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    z = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    weighted = F.aggregate(F.zip_with(e, logits, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)
    return F.log(z) + top - weighted / z
