"""What a model's raw outputs become: probabilities, similarities and margins as column expressions, and pandas functions that run an injected model a batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The tokens that an answer may have, and the passage tokens that a constraint is compared with.
MAX_ANSWER, MAX_PASSAGE = 30, 512
Batched = Callable[[list[str], list[str]], list]


def relevance_of(logits: Column) -> Column:
    """The sigmoid of a cross-encoder's only logit; more or fewer are an error."""
    one = F.when(F.size(logits) == 1, F.get(logits, F.lit(0))).otherwise(F.raise_error(F.lit("a cross-encoder has one logit")).cast("double"))
    return 1 / (1 + F.exp(-one))


def entailment_of(logits: Column, at: int) -> Column:
    """The softmax of an NLI model's logits at the place of entailment."""
    top = F.array_max(logits)
    return F.exp(F.get(logits, F.lit(at)) - top) / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def similarity_of(constraint: Column, passage: Column, most: int = MAX_PASSAGE) -> Column:
    """The greatest cosine of a constraint's vector and those of the passage's tokens (the first ``most``); 0 without any."""
    return F.coalesce(F.array_max(F.transform(F.slice(passage, 1, most), lambda v: cosine(constraint, v))), F.lit(0.0))


def margin_of(starts: Column, ends: Column, context: Column, most: int = MAX_ANSWER) -> Column:
    """The best answer's start and end logits less those of no answer (place 0). ``context`` lists the places of the passage in order; an answer has ``most`` at most. Without a passage minus infinity."""
    at = lambda xs, i: F.get(xs, i)
    # the best end for the start at place i of the context is a maximum over a slice
    best = F.transform(context, lambda c, i: at(starts, c) + F.array_max(F.transform(F.slice(context, i + 1, F.lit(most)), lambda e: at(ends, e))))
    return F.when(F.size(context) > 0, F.array_max(best) - (at(starts, F.lit(0)) + at(ends, F.lit(0)))).otherwise(F.lit(float("-inf")))


def answer_margin(starts: np.ndarray, ends: np.ndarray, context: np.ndarray, most: int = MAX_ANSWER) -> float:
    """``margin_of`` for one text, in numpy."""
    if not len(context):
        return float("-inf")
    e = np.concatenate([ends[context], np.full(most - 1, -np.inf)])
    best = np.lib.stride_tricks.sliding_window_view(e, most).max(axis=1)
    return float((starts[context] + best).max() - starts[0] - ends[0])


def scorer(load: Callable[[], Batched]) -> Callable[[Column, Column], Column]:
    """An expression over two texts that runs a model: ``load`` makes, once a task, the function from two lists of texts to their scores. The model sees Arrow batches."""

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for a, b in batches:
            yield pd.Series(model(a.tolist(), b.tolist()), dtype="float64")

    return score
