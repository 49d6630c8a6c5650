"""The filter algebra over candidates, compiled to boolean columns, and the contracts of selections."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold, decimal_hint, decimal_value

SET = ["doc_id", "field_id"]


class Expr:
    """A node; nodes are JSON-serialisable and never null for a row."""

    def column(self) -> Column:
        raise NotImplementedError

    def prepared(self, df: DataFrame) -> DataFrame:
        """df with the columns that the node needs from the candidate's siblings, the unfiltered set."""
        for child in self.children():
            df = child.prepared(df)
        return df

    def children(self) -> tuple[Expr, ...]:
        return ()

    def reason(self) -> Column:
        return F.lit(type(self).__name__)

    def to_json(self) -> dict:
        plain = lambda v: [plain(x) for x in v] if isinstance(v, (list, tuple)) else v.to_json() if isinstance(v, Expr) else v
        return {"kind": type(self).__name__} | {f.name: plain(getattr(self, f.name)) for f in fields(self)}

    @staticmethod
    def from_json(data: dict) -> Expr:
        build = lambda v: tuple(map(build, v)) if isinstance(v, list) else Expr.from_json(v) if isinstance(v, dict) else v
        kinds = {k.__name__: k for k in (LabelIn, LabelNotIn, ContainedBy, Contains, NumericRange, ContextContains, And, Or, Not)}
        return kinds[data["kind"]](**{k: build(v) for k, v in data.items() if k != "kind"})


def _shown(name: str) -> Column:
    """A text in quotes, None where there is none."""
    quote = F.when(F.contains(F.col(name), F.lit("'")) & ~F.contains(F.col(name), F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
    return F.coalesce(F.concat(quote, F.col(name), quote), F.lit("None"))


def _required(values, what: str) -> None:
    if not values:
        raise ValueError(f"{what} must not be empty")


@dataclass(frozen=True)
class LabelIn(Expr):
    labels: tuple[str, ...]

    def __post_init__(self):
        _required(self.labels, "labels")

    def column(self) -> Column:
        return F.coalesce(F.col("entity_type").isin(*self.labels), F.lit(False))

    def reason(self) -> Column:
        return F.concat(F.lit("entity_type "), _shown("entity_type"), F.lit(f" not in labels={self.labels!r}"))


@dataclass(frozen=True)
class LabelNotIn(LabelIn):
    def column(self) -> Column:
        return ~super().column()  # a candidate without a type isn't in the labels

    def reason(self) -> Column:
        return F.concat(F.lit("entity_type "), _shown("entity_type"), F.lit(f" is excluded by labels={self.labels!r}"))


@dataclass(frozen=True)
class ContainedBy(Expr):
    """Some other candidate of the set, with the label if given, spans more and covers it."""

    label: str | None = None
    inside = True

    @property
    def name(self) -> str:
        return f"__{'in' if self.inside else 'has'}_{self.label or ''}"

    def prepared(self, df: DataFrame) -> DataFrame:
        if self.name in df.columns:
            return df
        other = df if self.label is None else df.where(F.col("entity_type") == self.label)
        other = other.select(*(F.col(c).alias(f"o_{c}") for c in SET), F.col("byte_start").alias("o_start"), F.col("byte_end").alias("o_end"))
        own, far = (F.col("byte_start"), F.col("byte_end")), (F.col("o_start"), F.col("o_end"))
        inner, outer = (own, far) if self.inside else (far, own)
        on = (F.col("doc_id") == F.col("o_doc_id")) & (F.col("field_id") == F.col("o_field_id"))
        on &= (outer[0] <= inner[0]) & (outer[1] >= inner[1]) & ((outer[0] != inner[0]) | (outer[1] != inner[1]))
        found = df.join(other, on, "left_semi").select(*SET, "seq", F.lit(True).alias(self.name)).distinct()
        return df.join(found, [*SET, "seq"], "left").withColumn(self.name, F.coalesce(self.name, F.lit(False)))

    def column(self) -> Column:
        return F.col(self.name)

    def reason(self) -> Column:
        return F.lit(f"{'not contained by' if self.inside else 'does not contain'} label={self.label!r}")


@dataclass(frozen=True)
class Contains(ContainedBy):
    """The mirror image: it covers some other candidate that spans less."""

    inside = False


@dataclass(frozen=True)
class NumericRange(Expr):
    low: float | None = None
    high: float | None = None
    low_inclusive: bool = True
    high_inclusive: bool = True

    def __post_init__(self):
        if self.low is None and self.high is None:
            raise ValueError("a range needs a bound")

    def column(self) -> Column:
        value = decimal_value(F.coalesce("normalized_hint", "text"))
        tests = []
        if self.low is not None:
            tests.append(value >= self.low if self.low_inclusive else value > self.low)
        if self.high is not None:
            tests.append(value <= self.high if self.high_inclusive else value < self.high)
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))

    def reason(self) -> Column:
        value = decimal_value(F.coalesce("normalized_hint", "text"))
        shown = decimal_hint(value)
        low = F.when(~(value >= self.low if self.low_inclusive else value > self.low), F.concat(F.lit("value "), shown, F.lit(f" below lower bound {self.low}"))) if self.low is not None else F.lit(None)
        high = F.when(~(value <= self.high if self.high_inclusive else value < self.high), F.concat(F.lit("value "), shown, F.lit(f" above upper bound {self.high}"))) if self.high is not None else F.lit(None)
        return F.when(value.isNull(), "candidate is not numeric").otherwise(F.coalesce(low, high))


@dataclass(frozen=True)
class ContextContains(Expr):
    any_of: tuple[str, ...] = ()
    all_of: tuple[str, ...] = ()
    case_sensitive: bool = False

    def __post_init__(self):
        _required(self.any_of or self.all_of, "any_of or all_of")

    def _has(self, needle: str) -> Column:
        context = F.col("context") if self.case_sensitive else casefold(F.col("context"))
        return F.coalesce(context.contains(needle if self.case_sensitive else needle.casefold()), F.lit(False))

    def column(self) -> Column:
        tests = [reduce(lambda a, b: a | b, map(self._has, self.any_of))] if self.any_of else []
        return reduce(lambda a, b: a & b, tests + list(map(self._has, self.all_of)))

    def reason(self) -> Column:
        none = F.when(~reduce(lambda a, b: a | b, map(self._has, self.any_of)), f"missing any_of={self.any_of!r}") if self.any_of else F.lit(None)
        missing = F.filter(F.array(*(F.when(~self._has(x), repr(x)) for x in self.all_of) or [F.lit(None).cast("string")]), lambda x: x.isNotNull())
        return F.coalesce(none, F.concat(F.lit("missing all_of=("), F.array_join(missing, ", "), F.when(F.size(missing) == 1, ",").otherwise(""), F.lit(")")))


@dataclass(frozen=True)
class And(Expr):
    of: tuple[Expr, ...]

    def __post_init__(self):
        _required(self.of, "of")

    def children(self):
        return self.of

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (x.column() for x in self.of))

    def reason(self) -> Column:
        return F.coalesce(*(F.when(~x.column(), x.reason()) for x in self.of))


@dataclass(frozen=True)
class Or(And):
    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (x.column() for x in self.of))

    def reason(self) -> Column:
        return F.lit("no child expression matched")


@dataclass(frozen=True)
class Not(Expr):
    of: Expr

    def children(self):
        return (self.of,)

    def column(self) -> Column:
        return ~self.of.column()

    def reason(self) -> Column:
        return F.lit("negated expression matched")


def apply(candidates: DataFrame, expr: Expr) -> DataFrame:
    """The candidates that match, in their order; siblings are those of the whole set."""
    return expr.prepared(candidates).where(expr.column()).select(*candidates.columns)


def drops(candidates: DataFrame, expr: Expr) -> DataFrame:
    """The candidates that don't match, with the reason."""
    return expr.prepared(candidates).where(~expr.column()).withColumn("reason", expr.reason()).select(*candidates.columns, "reason")


def structural_status(df: DataFrame, contract: dict[str, tuple[str, object]]) -> DataFrame:
    """df with passed and failures: contract maps a payload column to ('set', values), ('range', (low, high)) or ('predicate', SQL)."""
    tests = []
    for name, (kind, what) in sorted(contract.items()):
        c = F.col(name)
        ok = {"set": lambda: c.isin(*what), "range": lambda: c.between(*what), "predicate": lambda: F.expr(what)}[kind]()
        tests.append(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("field"), c.cast("string").alias("actual"), F.lit(kind).alias("expected"))))
    failures = F.filter(F.array(*tests), lambda x: x.isNotNull())
    return df.withColumns({"failures": failures, "passed": F.size(failures) == 0})


def selection_violation(outcome: Column, ids: Column, allowed: Column) -> Column:
    """What is wrong with a selection, null if nothing: outcomes and the ids that go with them."""
    return (
        F.when((outcome == "NO_CANDIDATES") != (F.size(allowed) == 0), "no_candidates_mismatch")
        .when(F.size(F.array_except(ids, allowed)) > 0, "unknown_id")
        .when((outcome == "ABSTAINED") & (F.size(ids) > 0), "abstained_with_ids")
        .when((outcome == "AMBIGUOUS") & (F.size(ids) == 0), "ambiguous_without_ids")
        .when(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate_id")
    )


def batch_violations(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, field_id, violation) of answers against what was asked: unknown, duplicate, missing."""
    n = answers.groupBy(*SET).agg(F.count("*").alias("n"))
    both = asked.select(*SET).distinct().withColumn("asked", F.lit(True)).join(n, SET, "full_outer")
    why = F.when(F.col("asked").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return both.select(*SET, why.alias("violation")).where("violation IS NOT NULL")
