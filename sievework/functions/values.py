"""Scalar functions over ids, labels, distributions, dates and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.functions import columns as C


def tier_of(id_: Column) -> Column:
    """What stands before an id's first dash."""
    return F.substring_index(id_, "-", 1)


def _rest(id_: Column) -> Column:
    """What follows an id's third dash."""
    return F.array_join(F.slice(F.split(id_, "-"), 4, 1000), "-")


# fixed values: what a generated item's id says about it
STAGES = (("cf-", "cf"), ("para-state-", "para-state"), ("para-q-", "para-q"), ("shuffle-", "shuffle"), ("neg-", "neg"))


def stage_of(id_: Column) -> Column:
    """The stage that an item was made in, by what follows the third dash of its id: base if it names none."""
    out = None
    for prefix, name in STAGES:
        out = F.when(_rest(id_).startswith(prefix), name) if out is None else out.when(_rest(id_).startswith(prefix), name)
    return out.when(id_.isNotNull(), "base")


def type_of(id_: Column) -> Column:
    """The question type in a generated item's id: noul, choice, score, else unknown."""
    rest = F.regexp_replace(_rest(id_), "^(?:" + "|".join(p for p, _ in STAGES) + ")", "")
    return F.when(rest.startswith("noul"), "noul").when(rest.startswith("choice"), "choice").when(rest.startswith("score"), "score").when(id_.isNotNull(), "unknown")


def type_within(id_: Column, segments: tuple[str, ...] = ("noul", "choice", "score")) -> Column:
    """The first segment that stands between dashes of an id, else unknown."""
    out = None
    for s in segments:
        out = F.when(F.contains(id_, F.lit(f"-{s}-")), s) if out is None else out.when(F.contains(id_, F.lit(f"-{s}-")), s)
    return out.when(id_.isNotNull(), "unknown")


def polarity(label: Column) -> Column:
    """A label as true or false, null if its form is unknown."""
    text = F.lower(F.trim(label.cast("string")))
    return F.when(text.isin("true", "yes", "1", "y"), True).when(text.isin("false", "no", "0", "n"), False)


def resolved(*sources: tuple[str, Column]) -> Column:
    """(value, source) of the first that isn't null."""
    return F.struct(F.coalesce(*(c for _, c in sources)).alias("value"), F.coalesce(*(F.when(c.isNotNull(), n) for n, c in sources)).alias("source"))


def distribution_problem(probs: Column, levels: Column) -> Column:
    """Why a map of levels "0", "1", ... to probabilities can't be used: keys, nonnumeric, range, sum (off 1 by more than 0.02), degenerate (one at 0.99 or more, or fewer than two above 0.01); null if it can."""
    values = F.map_values(probs)
    wanted = F.transform(F.sequence(F.lit(0), levels - 1), lambda i: i.cast("string"))
    return (
        F.when((F.size(probs) != levels) | (F.size(F.array_except(wanted, F.map_keys(probs))) > 0), "keys").when(F.exists(values, lambda v: v.isNull() | F.isnan(v)), "nonnumeric").when(F.exists(values, lambda v: (v < 0) | (v > 1)), "range")
        .when(F.abs(C.total(values) - 1) > 0.02, "sum").when((F.array_max(values) >= 0.99) | (F.size(F.filter(values, lambda v: v > 0.01)) < 2), "degenerate")
    )


def top_level(probs: Column) -> Column:
    """The most probable level as a number; ties to the greater name."""
    best = F.array_max(F.transform(F.map_entries(probs), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k"))))
    return F.expr("0.0D") + best["k"].try_cast("double")


def rounded(probs: Column, places: int = 6) -> Column:
    return F.transform_values(probs, lambda k, v: F.round(v, places))


def corrections(taught: Column, tolerance: float = 1e-6) -> Column:
    """How many of a map's distributions don't sum to 1 and can be put right."""
    return F.size(F.filter(F.map_values(taught), lambda m: (F.abs(C.total(F.map_values(m)) - 1) > tolerance) & (C.total(F.map_values(m)) > 0)))


def log_ratio_interval(a: Column, b: Column, least: float = 1e-12) -> Column:
    """Bounds of log(a / b) for probabilities that were shown rounded to two decimals."""
    x, y = C.interval(a), C.interval(b)
    at = lambda c: F.greatest(c, F.lit(least))
    return F.struct(F.log(at(x["low"]) / at(y["high"])).alias("low"), F.log(at(x["high"]) / at(y["low"])).alias("high"))


def in_place(values: Column, order: Column) -> Column:
    """Values in the order of options, given in the order shown: order says which option stands at each place."""
    return F.transform(F.sequence(F.lit(0), F.size(order) - 1), lambda o: F.element_at(values, F.array_position(order, o).cast("int")))


def combined(logits: Column, masses: Column, weight: float, least: float) -> Column:
    """Log softmax of logits and weight times the log of masses, these not below least."""
    top = F.array_max(logits)
    norm = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    return F.zip_with(logits, masses, lambda z, m: (z - norm) + weight * F.log(F.greatest(m, F.lit(least))))


def span_masses(row: Column, spans: Column) -> Column:
    """(masses, span_sum, preamble, residual, total): sums of a row's stretches (low, high, high exclusive), of what stands before the first, and of the rest."""
    part = lambda low, high: C.total(F.slice(row, low + 1, F.greatest(high - low, F.lit(0))))
    masses = F.transform(spans, lambda s: part(s["low"], s["high"]))
    whole = C.total(row)
    return F.struct(masses.alias("masses"), C.total(masses).alias("span_sum"), part(F.lit(0), F.element_at(spans, 1)["low"]).alias("preamble"), (whole - C.total(masses)).alias("residual"), whole.alias("total"))


def range_bucket(value: Column, edges: tuple[tuple[int, int | None, str], ...]) -> Column:
    """The label of the half-open range that a value lies in, other outside all."""
    out = None
    for low, high, name in edges:
        inside = (value >= low) & (value < high) if high is not None else value >= low
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise("other")


def add_business_days(day: Column, n: Column) -> Column:
    """The date so many days from Monday to Friday later; n is 1 or more. From a weekend the first is Monday."""
    at = F.weekday(day)
    base = F.date_sub(day, F.greatest(at - 4, F.lit(0)))
    return F.date_add(base, n + 2 * F.floor((F.least(at, F.lit(4)) + n) / 5).cast("int"))


def lenient_json(text: Column) -> Column:
    """The JSON in a model's answer, in one form, null if there is none: thoughts are dropped, a code fence around it is taken off."""
    told = F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>\s*", ""))
    inner = F.when(told.startswith("```"), F.trim(F.regexp_replace(F.regexp_replace(told, r"(?s)^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", ""))).otherwise(told)
    return C.strict_json(inner)


def schema_key(instructions: Column, keys: Column) -> Column:
    """Identity of a question's wording and options: a digest of the lower-case instruction, white space collapsed, and the sorted keys, as a JSON list."""
    text = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    listed = F.array_join(F.transform(F.array_sort(keys), text), ", ")
    return F.substring(F.sha2(F.concat(F.lit("["), text(C.collapsed_lower(F.coalesce(instructions, F.lit("")))), F.lit(", ["), listed, F.lit("]]")), 256), 1, 16)


def flattened(messages: Column) -> Column:
    """The contents of an array of messages (content) in one text, a line each, empty ones left out."""
    return F.array_join(F.filter(F.transform(messages, lambda m: F.coalesce(m["content"], F.lit(""))), lambda c: c != ""), "\n")
