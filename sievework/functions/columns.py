"""Scalar functions over Columns, all built from Spark's own expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- text


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal_words(c: Column | str) -> Column:
    """Casefolded letters and digits, every other run (underscores too) one space, trimmed. Texts must be NFC; functions.forms.form_column does more."""
    return F.trim(F.regexp_replace(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]+", " "))


def normal_words_keeping_underscores(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}_]+", " "))


def strict_json(c: Column | str) -> Column:
    """A text that is one JSON value and nothing else, with an object's fields in order of name and no spaces; null for any other. The parser itself passes over what follows a value."""
    one = F.to_json(F.try_parse_json(_col(c)))
    listed = F.to_json(F.try_parse_json(F.concat(F.lit("["), _col(c), F.lit("]"))))
    return F.when(listed == F.concat(F.lit("["), one, F.lit("]")), one)


def canonical_json(c: Column | str) -> Column:
    """strict_json(); a text that isn't JSON as itself, after a "!"; null stays null."""
    return F.coalesce(strict_json(c), F.concat(F.lit("!"), _col(c)))


def canonical_value(c: Column | str) -> Column:
    """strict_json() of a column that holds JSON or bare text: bare text as a JSON string."""
    return F.coalesce(strict_json(c), F.concat(F.lit('"'), F.regexp_replace(_col(c), r'(["\\])', r"\\$1"), F.lit('"')))


_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def collapsed(c: Column | str) -> Column:
    """Runs of white space, of Unicode's too, to one space, trimmed."""
    return F.trim(F.regexp_replace(_col(c), _SPACE, " "))


def collapsed_lower(c: Column | str) -> Column:
    return F.lower(collapsed(c))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once: inside another lambda it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word_shingles(c: Column | str, n: int = 8) -> Column:
    """Distinct shingles of n words of a normalised text; none if it has fewer words."""

    def made(words: Column) -> Column:
        shingles = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, F.array_distinct(shingles)).otherwise(F.array().cast("array<string>"))

    return bound(F.split(_col(c), " "), made)


def char_grams(c: Column | str, n: int = 5) -> Column:
    """Distinct substrings of n characters of the lower-cased, trimmed text; a shorter text as a whole."""

    def made(text: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
        return F.when(F.length(text) >= n, F.array_distinct(grams)).when(text != "", F.array(text)).otherwise(F.array().cast("array<string>"))

    return bound(F.trim(F.lower(_col(c))), made)


def hash_fraction(key: Column) -> Column:
    """The first 32 bits of md5 as a number from 0 to 1, the same in every engine."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def base_id(c: Column | str) -> Column:
    """An id without what variants append to it."""
    return F.regexp_replace(_col(c), "-(abstain|unans)-.*$", "")


def redacted(c: Column | str, roots: tuple[str, ...] = ("/home", "/Users", "/mnt", "/root")) -> Column:
    """Absolute paths below the roots to a placeholder."""
    return F.regexp_replace(_col(c), "(" + "|".join(roots) + r")(/[\w.\-]+)+", "<path>")


def absolute_paths(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(r"(/(?:[\w.\-]+/)+[\w.\-]+)"), 1)


# ---- probabilities


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Each step is computed once for all elements: what a lambda refers to outside itself would be computed for each."""

    def powers(e: Column) -> Column:
        return F.transform(e["scaled"], lambda x: F.exp(x - e["top"]))

    scaled = F.transform(logits, lambda x: x / F.lit(temperature))
    with_top = bound(scaled, lambda v: F.struct(v.alias("scaled"), F.array_max(v).alias("top")))
    with_total = bound(bound(with_top, powers), lambda p: F.struct(p.alias("powers"), F.aggregate(p, F.lit(0.0), lambda a, x: a + x).alias("total")))
    return bound(with_total, lambda e: F.transform(e["powers"], lambda x: x / e["total"]))


def softmax_biased(logits: Column, bias: Column, temperature: float = 1.0) -> Column:
    return softmax(F.zip_with(logits, bias, lambda x, b: x / F.lit(temperature) + F.coalesce(b, F.lit(0.0))))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def argmax(values: Column) -> Column:
    """Index from 0 of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def argmax_by_key(values: Column, keys: Column) -> Column:
    """Index of the greatest value; of ties, that with the least key."""
    tied = F.filter(F.arrays_zip(values.alias("v"), keys.alias("k")), lambda e: e["v"] == F.array_max(values))
    return (F.array_position(keys, F.array_min(F.transform(tied, lambda e: e["k"]))) - 1).cast("int")


def ranked(values: Column) -> Column:
    """Indexes by value descending, then index."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda e: e["i"])


def margin(values: Column) -> Column:
    """Greatest value less the next; the greatest itself if there is one value."""
    down = F.sort_array(values, asc=False)
    return F.when(F.size(down) > 1, F.element_at(down, 1) - F.element_at(down, 2)).when(F.size(down) == 1, F.element_at(down, 1))


def has_tie(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x == F.array_max(values))) > 1


def tie_count(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x == F.array_max(values)))


def gold_rank(values: Column, gold: Column) -> Column:
    """1 and how many others are at least as probable as the gold: ties count against it."""
    return F.size(F.filter(values, lambda x: x >= F.element_at(values, gold + 1)))


def multiclass_brier(probs: Column, gold: Column) -> Column:
    return total(F.transform(probs, lambda p, i: F.pow(p - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2.0))))


def rps(probs: Column, gold: Column) -> Column:
    """Ranked probability score over size - 1; 0 for one level."""
    n = F.size(probs)
    steps = F.transform(F.sequence(F.lit(1), n), lambda i: total(F.slice(probs, F.lit(1), i)) - F.when(i > gold, 1.0).otherwise(0.0))
    score = F.aggregate(F.slice(steps, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda a, x: a + x * x)
    return F.when(n > 1, score / (n - 1)).otherwise(F.lit(0.0))


def expected_level(probs: Column) -> Column:
    return total(F.transform(probs, lambda p, i: p * i))


def total_variation(left: Column, right: Column) -> Column:
    """Half the sum of differences of two maps, a missing key counting as 0."""
    gaps = F.map_zip_with(left, right, lambda k, a, b: F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))))
    return total(F.map_values(gaps)) / 2


def corrected_confidence(probs: Column) -> Column:
    """Greatest probability, chance taken off, not below 0."""
    k = F.size(probs).cast("double")
    return F.when(k > 1, F.greatest((F.array_max(probs) - 1 / k) / (1 - 1 / k), F.lit(0.0))).otherwise(F.lit(1.0))


def normalised_map(probs: Column, tolerance: float = 1e-6) -> Column:
    """A map divided by its sum where that is positive and off 1 by more than the tolerance."""
    whole = total(F.map_values(probs))
    return F.when((F.abs(whole - 1) > tolerance) & (whole > 0), F.transform_values(probs, lambda k, v: v / whole)).otherwise(probs)


def mix_with_gold(probs: Column, gold: Column, weight: float) -> Column:
    return F.transform_values(probs, lambda k, v: v * (1 - weight) + F.when(k == gold, weight).otherwise(0.0))


def interval(p: Column, half: float = 0.005) -> Column:
    """What a probability rounded to two decimals can have been."""
    return F.struct(F.greatest(p - half, F.lit(0.0)).alias("low"), F.least(p + half, F.lit(1.0)).alias("high"))


def interval_relation(first: Column, second: Column) -> Column:
    return F.when(first["high"] < second["low"], "increase").when(first["low"] > second["high"], "decrease").otherwise("indeterminate")


def interval_difference(left: Column, right: Column) -> Column:
    return F.struct((left["low"] - right["high"]).alias("low"), (left["high"] - right["low"]).alias("high"))


# ---- buckets; each report has its own edges (fixed values)


def _bucket(n: Column, edges: tuple[tuple[int, str], ...], last: str) -> Column:
    out = F.lit(last)
    for most, name in reversed(edges):
        out = F.when(n <= most, name).otherwise(out)
    return F.when(n.isNotNull(), out)


def k_bucket(n: Column) -> Column:
    return _bucket(n, ((2, "2"), (5, "3-5"), (20, "6-20"), (80, "21-80"), (256, "81-256")), ">256")


def option_bucket(n: Column) -> Column:
    return _bucket(n, ((2, "2"), (5, "3-5"), (20, "6-20")), ">20")


def blend_bucket(n: Column) -> Column:
    return _bucket(n, ((5, "<=5"), (19, "6-19")), ">=20")


def confidence_bucket(c: Column) -> Column:
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c.isNotNull(), "uncertain")


def position_bucket(position: Column, k: Column) -> Column:
    """One of five equal parts of a list of k."""
    return F.least(F.lit(4), F.floor(position * 5 / k)).cast("int")


def length_bucket(length: Column, bounds: list[int]) -> Column:
    """The least bound that is not below a length; null beyond the last."""
    return F.array_min(F.filter(F.array(*map(F.lit, bounds)), lambda b: b >= length))


# ---- counts to rates


def wilson(correct: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """Wilson's interval of a rate as struct(low, high); null for no rows."""
    p, zz = correct / n, z * z
    centre, half = p + zz / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.when(n > 0, F.struct(F.greatest((centre - half) / (1 + zz / n), F.lit(0.0)).alias("low"), F.least((centre + half) / (1 + zz / n), F.lit(1.0)).alias("high")))


def skill(score: Column, reference: Column) -> Column:
    return F.when(reference > 0, 1 - score / reference)


def half_even(c: Column, places: int = 0) -> Column:
    return F.bround(c, places)
