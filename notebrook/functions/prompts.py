"""Prompts for language models as Column expressions, and the parts of responses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notebrook.functions import arrays as A

TASK = "Split the notebook below into pipeline stages and return each stage as one fenced block."
THINK = "Explain step by step how you decide where a stage ends before you answer."


def fenced(code: Column) -> Column:
    return F.concat(F.lit("```python\n"), code, F.lit("\n```"))


def annotated(segments: Column) -> Column:
    """Segments as numbered fenced blocks."""
    return F.array_join(F.transform(segments, lambda s, i: F.concat(F.lit("Stage "), (i + 1).cast("string"), F.lit(":\n"), fenced(s))), "\n")


def prompt(code: Column, think: bool = False, example: Column | None = None) -> Column:
    """The task, an example if there is one, the code, and the request to reason if wanted."""
    parts = [F.lit(TASK)]
    if example is not None:
        parts.append(F.when(example.isNotNull(), F.concat(F.lit("Example:\n"), example)))
    parts += [F.concat(F.lit("Notebook:\n"), fenced(code))] + ([F.lit(THINK)] if think else [])
    return F.concat_ws("\n\n", *parts)


def response_segments(text: Column) -> Column:
    """Segments of a response: its fenced Python blocks, else the lists in its fenced JSON, else its numbered stages."""
    python, data, numbered = A.fenced_blocks(text), A.json_blocks(text), A.stages(text)
    return F.when(F.size(python) > 0, python).when(F.size(data) > 0, F.transform(data, lambda x: F.array_join(x, "\n"))).otherwise(numbered)
