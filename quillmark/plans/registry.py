"""Configuration, model specs and feature blocks by name."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import tokens as T
from quillmark.operators import attribution as A
from quillmark.operators import chars as CH
from quillmark.operators import delta as D
from quillmark.operators import features as FT
from quillmark.operators import vocabulary as V
from quillmark.sources.files import canonical_hash

WEIGHTINGS = ("none", "work_balanced")


@dataclass(frozen=True)
class Config:
    """Defaults; `overlay` sets dotted names, `digest` leaves out what only shows."""

    seed: int = 42
    chunk_size: int = 500
    chunk_least: int = 100
    chunk_overlap: float = 0.0
    function_words: int = 300
    char_low: int = 3
    char_high: int = 5
    char_most: int = 5000
    bootstrap: int = 1000
    level: float = 0.95
    weighting: str = "none"
    blocks: tuple[str, ...] = ("function_words", "char_ngrams", "length", "punctuation")
    title: str = field(default="", metadata={"shows": True})

    def overlay(self, **values) -> Config:
        known = {f.name: f for f in fields(self)}
        for k, v in values.items():
            if k not in known:
                raise KeyError(k)
            if type(v) is not type(getattr(self, k)):
                raise TypeError(k)
        return replace(self, **values)

    def set(self, *assignments: str) -> Config:
        """`name=value` as given on a command line, read by the type of the default."""
        out = {}
        for a in assignments:
            k, sep, v = a.partition("=")
            if not sep or not hasattr(self, k):
                raise KeyError(a)
            own = getattr(self, k)
            out[k] = tuple(filter(None, v.split(","))) if isinstance(own, tuple) else v == "true" if isinstance(own, bool) else type(own)(v)
        return replace(self, **out)

    def digest(self) -> str:
        return canonical_hash({f.name: getattr(self, f.name) for f in fields(self) if not f.metadata.get("shows")})


@dataclass(frozen=True)
class Cell:
    """Which of the balanced choices hold: loss weights, features fitted by work, relative function words."""

    weights: bool = False
    feature_fit: bool = False
    relative: bool = False

    @property
    def name(self) -> str:
        cells = {(0, 0, 0): "A0", (1, 0, 0): "A1", (0, 1, 0): "A2", (0, 0, 1): "A3", (1, 1, 1): "A4"}
        key = (int(self.weights), int(self.feature_fit), int(self.relative))
        if key not in cells:
            raise ValueError("only the corners and single axes are defined")
        return cells[key]

    def weighting(self) -> str:
        """The production weighting; only the two corners have one."""
        if self.name not in ("A0", "A4"):
            raise ValueError(f"{self.name} is for audits only")
        return "work_balanced" if self.name == "A4" else "none"


@dataclass(frozen=True)
class Model:
    key: str
    pattern: str
    needs_works: bool = False
    deployable: bool = False
    confirmatory: bool = False
    calibrated: bool = False
    reference_only: bool = False
    weightings: tuple[str, ...] = WEIGHTINGS


MODELS = (
    Model("style", "style", needs_works=True, deployable=True, confirmatory=True, calibrated=True),
    Model("delta", r"delta:([1-9][0-9]*)", needs_works=True, deployable=True, confirmatory=True),
    Model("delta_cos", r"delta_cos:([1-9][0-9]*)", needs_works=True, confirmatory=True),
    Model("char_cos", "char_cos", needs_works=True, confirmatory=True),
    Model("bow_lr", "bow_lr", needs_works=True, confirmatory=True, calibrated=True),
    Model("majority", "majority", confirmatory=True),
    Model("style_stack", "style_stack", needs_works=True),
    Model("style_equal_channels", "style_equal_channels", needs_works=True),
    Model("bow_lr_ref_legacy", "bow_lr_ref_legacy", reference_only=True, weightings=("work_balanced",)),
)


def resolve(spec: str) -> tuple[Model, int | None]:
    """The one model that a spec names, and its number if it has one."""
    found = [(m, re.fullmatch(m.pattern, spec)) for m in MODELS]
    found = [(m, x) for m, x in found if x]
    if len(found) != 1:
        raise ValueError(f"unknown model: {spec!r}")
    model, match = found[0]
    return model, int(match[1]) if match.groups() else None


def route(spec: str, weighting: str, confirmatory: bool = False, deploy: bool = False) -> Model:
    """The model, if it exists for this use."""
    model, _ = resolve(spec)
    if weighting not in model.weightings or (confirmatory and not model.confirmatory) or (deploy and not model.deployable):
        raise ValueError(f"{spec!r} is not available here")
    return model


def held_out_scores(spec: str, works: DataFrame, weighting: str = "none", spaces: dict | None = None) -> DataFrame:
    """work_id, author, candidate, score (larger is nearer) of a relational model, every work held out. works: author, work_id, text.
    spaces: those of the same works that other models have made."""
    route(spec, weighting)
    model, n = resolve(spec)
    balanced = weighting == "work_balanced"
    if model.key in ("delta", "delta_cos"):
        how = (n, "events" if balanced else "selected", "work" if balanced else "pooled")
        spaces = {} if spaces is None else spaces
        if how not in spaces:
            spaces[how] = D.space(works, *how)
        if model.key == "delta":
            return D.distances(spaces[how], held_out=True).select("work_id", "author", "candidate", (-F.col("distance")).alias("score"))
        return D.held_out_cosines(spaces[how], "z")
    if model.key == "char_cos":
        return CH.trigram_cosines(works, 5000, balanced)
    if model.key == "majority":
        return works.select("work_id", "author").distinct().crossJoin(F.broadcast(A.majority(works.select("work_id", "author").distinct()).select(F.col("author").alias("candidate")))).withColumn("score", F.lit(1.0))
    raise ValueError(f"{spec!r} is learned: see operators.models")


class FeatureBlock(Protocol):
    """fit returns a state table, transform a long relation (work_id, term, value)."""

    def fit(self, rows: DataFrame) -> DataFrame | None: ...

    def transform(self, rows: DataFrame, state: DataFrame | None) -> DataFrame: ...


@dataclass(frozen=True)
class TermBlock:
    """Term frequencies over a vocabulary that is fitted by work."""

    terms: Callable
    most: int
    tfidf: bool = True

    def fit(self, rows: DataFrame) -> DataFrame:
        return V.work_vocabulary(V.counts(rows, self.terms(F.col("text"))), V.events(rows, self.terms(F.col("text"))), self.most)

    def transform(self, rows: DataFrame, state: DataFrame) -> DataFrame:
        table = V.counts(rows, self.terms(F.col("text")))
        if self.tfidf:
            return V.tfidf(table, state)
        return V.relative(table.join(state.select("term"), "term"), V.events(rows, self.terms(F.col("text"))))


@dataclass(frozen=True)
class ColumnBlock:
    """Scalar columns of each row."""

    columns: Callable

    def fit(self, rows: DataFrame) -> None:
        return None

    def transform(self, rows: DataFrame, state: None = None) -> DataFrame:
        cols = self.columns(F.col("text"))
        return rows.select("work_id", F.explode(F.create_map(*(x for k, c in cols.items() for x in (F.lit(k), c.cast("double"))))).alias("term", "value"))


@dataclass(frozen=True)
class LengthBlock:
    def fit(self, rows: DataFrame) -> None:
        return None

    def transform(self, rows: DataFrame, state: None = None) -> DataFrame:
        return FT.length_histogram(rows).select("work_id", F.concat(F.lit("word_"), "length").alias("term"), F.col("share").alias("value"))


def block_registry(config: Config, only: Iterable[str] | None = None) -> dict[str, FeatureBlock]:
    """The blocks that are on; none is an error."""
    known = {
        "function_words": TermBlock(T.words, config.function_words, tfidf=False),
        "char_ngrams": TermBlock(lambda t: T.char_ngrams(F.lower(t), config.char_low, config.char_high), config.char_most),
        "length": LengthBlock(),
        "punctuation": ColumnBlock(FT.punctuation_rates),
        "lengths_mean": ColumnBlock(FT.mean_lengths),
    }
    out = {n: known[n] for n in (only if only is not None else config.blocks)}
    if not out:
        raise ValueError("no feature block is on")
    return out


def features(rows: DataFrame, blocks: dict[str, FeatureBlock], fit_on: DataFrame | None = None) -> DataFrame:
    """The long relation of all blocks, each fitted on `fit_on`."""
    return V.blocks({n: b.transform(rows, b.fit(rows if fit_on is None else fit_on)) for n, b in blocks.items()})
