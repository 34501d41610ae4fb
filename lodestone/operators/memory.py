"""Memory stores as folds over a log of operations, in batch and in streams."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words of the core memory, and what marks a cut.
CORE_WORDS, CUT = 512, "… (cut)"

STATE = "instance_id long, memory_type string, memory_id string, content string, position int"
STATUS = "instance_id long, seq long, status string"


class Store:
    """The state of one instance: a core text and ordered lists of (id, content) by type."""

    def __init__(self, state: dict | None = None, types: tuple[str, ...] = ("semantic", "episodic")):
        self.types = types
        self.core: str | None = (state or {}).get("core")
        self.items: dict[str, dict[str, str]] = {t: dict((state or {}).get(t, [])) for t in types}

    def apply(self, op: str, kind: str, key: str | None, content: str | None) -> str:
        """Executes one operation and says what came of it."""
        if kind == "core":
            if op == "insert":
                return "error: core can only be updated"
            self.core = "" if op == "delete" else self._bounded(content or "")
            return "ok"
        if kind not in self.items:
            return "error: unknown type"
        memory = self.items[kind]
        if op == "insert":
            if not content:
                return "error: no content"
            if content in memory.values():
                return "skipped"
            memory[key or f"m{len(memory)}"] = content
            return "ok"
        if op == "update":
            if key not in memory:
                return "error: unknown id"
            memory[key] = content or ""
            return "ok"
        if op == "delete":
            return "ok" if memory.pop(key, None) is not None else "warning: unknown id"
        return "error: unknown operation"

    @staticmethod
    def _bounded(text: str) -> str:
        words = text.split(" ")
        return text if len(words) <= CORE_WORDS else " ".join(words[:CORE_WORDS]) + CUT

    def rows(self, instance: int) -> list[tuple]:
        core = [(instance, "core", "core", self.core, 0)] if self.core is not None else []
        return core + [(instance, t, k, c, i) for t in self.types for i, (k, c) in enumerate(self.items[t].items())]

    def dump(self) -> str:
        return json.dumps({"core": self.core} | {t: list(m.items()) for t, m in self.items.items()})


def fold(log: DataFrame) -> DataFrame:
    """Final stores of (instance_id, seq, op, memory_type, memory_id, content): the log of an instance is folded in order of seq."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        store = Store()
        for row in pdf.sort_values("seq").itertuples(index=False):
            store.apply(row.op, row.memory_type, row.memory_id, row.content)
        return pd.DataFrame(store.rows(int(pdf.instance_id.iloc[0])), columns=["instance_id", "memory_type", "memory_id", "content", "position"])

    return log.groupBy("instance_id").applyInPandas(run, STATE)


def outcomes(log: DataFrame) -> DataFrame:
    """(instance_id, seq, status) of each operation."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        store = Store()
        rows = [(r.instance_id, r.seq, store.apply(r.op, r.memory_type, r.memory_id, r.content)) for r in pdf.sort_values("seq").itertuples(index=False)]
        return pd.DataFrame(rows, columns=["instance_id", "seq", "status"])

    return log.groupBy("instance_id").applyInPandas(run, STATUS)


def latest_content(log: DataFrame) -> DataFrame:
    """Contents by the last operation on each (instance, type, id), where that isn't a delete. Aggregation alone, so any store size will do."""
    last = log.groupBy("instance_id", "memory_type", "memory_id").agg(F.max_by(F.struct("op", "content"), "seq").alias("o"))
    return last.filter("o.op <> 'delete'").select("instance_id", "memory_type", "memory_id", F.col("o.content").alias("content"))


def latest_view(items: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The n latest items of a group; none for n under 1."""
    w = Window.partitionBy(group).orderBy(F.desc(order))
    return items.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")


def recurrent_summary(chunks: DataFrame, group: str, order: list[str], text: str, words: int = 64) -> DataFrame:
    """(group, memory): memory becomes the last words of memory and chunk, chunk by chunk; a stand-in for a model's summary."""
    series = chunks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*order, F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("x"))
    last = lambda s: F.when(F.size(s) <= words, s).otherwise(F.slice(s, -words, words))
    folded = F.aggregate("x", F.array().cast("array<string>"), lambda acc, x: last(F.concat(acc, F.filter(F.split(x["t"], r"\s+"), lambda w: w != ""))))
    return series.select(group, F.array_join(folded, " ").alias("memory"))


def stream_fold(log: DataFrame) -> DataFrame:
    """The same fold over a stream: state of an instance is its store; each batch emits (instance_id, state)."""
    from pyspark.sql.streaming.state import GroupState

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        store = Store(json.loads(state.get[0])) if state.exists else Store()
        for pdf in batches:
            for row in pdf.sort_values("seq").itertuples(index=False):
                store.apply(row.op, row.memory_type, row.memory_id, row.content)
        state.update((store.dump(),))
        yield pd.DataFrame({"instance_id": [key[0]], "state": [store.dump()]})

    return log.groupBy("instance_id").applyInPandasWithState(run, "instance_id long, state string", "state string", "update", "NoTimeout")
