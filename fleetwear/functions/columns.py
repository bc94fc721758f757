"""Column functions: hashes, permutations, masks, class scores, vectors and text. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetwear.schema import MASKED, OTHER_COLOUR, STATE_COLOURS


def _part(part) -> Column:
    """A part of a hashed text: separators escaped and nulls marked, so that different parts never give the same text."""
    if not isinstance(part, Column):
        return F.lit(str(part))
    escaped = F.replace(F.replace(part.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit(":"), F.lit("\\:"))
    return F.coalesce(escaped, F.lit("\\N"))


def _text(*parts) -> Column:
    return F.concat_ws(":", *[_part(p) for p in parts])


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also where ``use`` repeats it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash_text(*parts) -> Column:
    """md5 of the parts joined by ``:``, the source of all randomness: the same on every partitioning."""
    return F.md5(_text(*parts))


def hash_number(digest: Column, start: int = 1) -> Column:
    """Eight hex digits of a digest as a number below 2**32."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")


def hash_unit(digest: Column, start: int = 9) -> Column:
    """Eight hex digits of a digest as a number in [0, 1)."""
    return hash_number(digest, start) / F.lit(4294967296.0)


# positions and masks ------------------------------------------------------------------------------------------------


def permutation(key: Sequence[Column], n: int, seed: int) -> Column:
    """A pseudo-random order of 0..n-1 for each row.

    Written out as plain columns and a natural sort: lambdas would be interpreted for every row.
    """
    prefix = _text(seed, *key)
    drawn = [F.struct(F.md5(F.concat(prefix, F.lit(f":{i}"))).alias("h"), F.lit(i).alias("i")) for i in range(n)]
    return F.sort_array(F.array(*drawn))["i"]


def ranks(perm: Column, n: int) -> Column:
    """Inverse of a permutation of 0..n-1: at each position, when it is drawn."""
    return F.array(*[(F.array_position(perm, i) - 1).cast("int") for i in range(n)])


def first_k(values: Column, k) -> Column:
    return F.slice(values, F.lit(1), k if isinstance(k, Column) else F.lit(k))


def smallest(values: Column, k: int) -> Column:
    return F.slice(F.sort_array(values), 1, k)


def mask(features: Column, perm: Column, k) -> Column:
    """Features with the first ``k`` positions of ``perm`` set to the missing mark."""
    cover = lambda hidden: F.transform(features, lambda v, i: F.when(F.array_contains(hidden, i), F.lit(MASKED)).otherwise(v))
    return _once(first_k(perm, k), cover)


def mask_ranked(features: Column, rank: Column, k, width: int) -> Column:
    """Same as ``mask`` from the inverse permutation; linear in the width and without lambdas."""
    k = k if isinstance(k, Column) else F.lit(k)
    return F.array(*[F.when(rank[i] < k, F.lit(MASKED)).otherwise(features[i]) for i in range(width)])


def trunc(value: Column) -> Column:
    """Integer part toward zero."""
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value)).cast("int")


def cap(value: Column, top) -> Column:
    return F.least(value, F.lit(top))


def clean_tag(answer: Column) -> Column:
    """A typed answer as one of u, d, c, o; anything else is o."""
    tag = F.lower(F.trim(answer))
    return F.when(tag.isin("u", "d", "c", "o"), tag).otherwise("o")


def is_sensor_name(name: Column) -> Column:
    return name.rlike("^s[0-9]+$")


def state_colour(state: Column, palette: dict[int, str] | None = None) -> Column:
    pairs = [F.lit(x) for pair in (palette or STATE_COLOURS).items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), state), F.lit(OTHER_COLOUR))


# class scores -------------------------------------------------------------------------------------------------------


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def argmax(scores: Column) -> Column:
    """Position of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def clip_normalise(scores: Column, low: float = 1e-12) -> Column:
    """Scores clipped from below and divided by their sum."""
    clipped = F.transform(scores, lambda v: F.greatest(v, F.lit(low)))
    return _once(clipped, _shares)


def _shares(values: Column) -> Column:
    return _once(total(values), lambda t: F.transform(values, lambda v: v / t))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    powers = _once(F.array_max(logits), lambda m: F.transform(logits, lambda v: F.exp((v - m) / temperature)))
    return _once(powers, _shares)


def log_softmax(logits: Column, temperature: float = 1.0) -> Column:
    shifted = _once(F.array_max(logits), lambda m: F.transform(logits, lambda v: (v - m) / temperature))

    def less(values: Column) -> Column:
        return _once(F.ln(total(F.transform(values, F.exp))), lambda t: F.transform(values, lambda v: v - t))

    return _once(shifted, less)


def soft_divergence(target: Column, log_scores: Column) -> Column:
    """Sum of ``p ln(p / q)`` with ``log_scores = ln q``; a zero ``p`` adds nothing."""
    return total(F.zip_with(target, log_scores, lambda p, q: F.when(p > 0, p * (F.ln(p) - q)).otherwise(0.0)))


# vectors ------------------------------------------------------------------------------------------------------------


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def between(a: Column, b: Column, gap: Column) -> Column:
    """The point at ``gap`` on the way from ``a`` to ``b``."""
    return F.zip_with(a, b, lambda x, y: x + gap * (y - x))


# text ---------------------------------------------------------------------------------------------------------------


def row_json(cols: Sequence[str]) -> Column:
    return F.to_json(F.struct(*cols))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def swap_suffix(path: Column, old: str, new: str) -> Column:
    return F.regexp_replace(path, old.replace(".", r"\."), new)


def run_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd_HHmmss")
