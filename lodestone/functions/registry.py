"""Registries of column functions by name, and scoring functions of the user's own."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import scores
from lodestone.operators import advantages

#: Scores of (prediction, gold).
SCORES: dict[str, Callable[[Column, Column], Column]] = {
    "exact_match": scores.exact_match,
    "substring_match": scores.substring_match,
    "keyword_recall": scores.keyword_recall,
    "containment": scores.containment,
    "token_f1": lambda p, g: scores.token_f1(p, g)["f1"],
    "set_f1": scores.set_f1,
}
#: Advantages of (score, window of the group).
ADVANTAGES: dict[str, Callable] = {"group_relative": advantages.group_relative, "mean_baseline": advantages.mean_baseline, "leave_one_out": advantages.leave_one_out}


def user_score(path: str, name: str = "score") -> Callable[[Column, Column], Column]:
    """The function ``name(prediction, gold) -> float`` of a Python file as a column function; null and errors score 0."""
    spec = importlib.util.spec_from_file_location("lodestone_user_score", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    function = getattr(module, name)

    @F.pandas_udf("double")
    def run(p: pd.Series, g: pd.Series) -> pd.Series:
        def one(a: str, b: str) -> float:
            try:
                return float(function(a, b) or 0.0)
            except Exception:  # noqa: BLE001 - a user's function may fail in any way
                return 0.0

        return pd.Series([one(a, b) for a, b in zip(p, g)])

    return run
