"""Column work on reading frames and the assembly of model inputs."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetwear.functions.columns import hash_text, row_json
from fleetwear.schema import FLAT_SENSORS, PHYSICAL_NAMES, SETTING_COLUMNS

FRAME_TYPES = ["RAW_RAW", "EMBEDDING_RAW", "EMBEDDING_MIX_RAW", "RAW_LOGITS", "EMBEDDING_LOGITS", "EMBEDDING_MIX_LOGITS"]


def sensor_columns(df: DataFrame, drop: Sequence[str] = FLAT_SENSORS, tags: Sequence[str] | None = None) -> list[str]:
    """Sensor columns that are not flat and, when ``tags`` names the mapped sensors, are mapped."""
    return [c for c in df.columns if re.fullmatch("s[0-9]+", c) and c not in drop and (tags is None or c in tags)]


def columns_of_type(df: DataFrame, dtype: type[T.DataType]) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, dtype)]


def drop_flat(df: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Without keys, settings, flat sensors and labels: the feature columns."""
    return df.drop("unit", "cycle", *SETTING_COLUMNS, *FLAT_SENSORS, "state", "dataset", *more)


def rename_sensors(df: DataFrame, mapping: dict[str, str] = PHYSICAL_NAMES) -> DataFrame:
    return df.withColumnsRenamed({c: mapping[c] for c in df.columns if c in mapping})


def round_floats(df: DataFrame, digits: int = 5) -> DataFrame:
    """Floating columns rounded half to even."""
    floating = columns_of_type(df, T.DoubleType) + columns_of_type(df, T.FloatType)
    return df.withColumns({c: F.bround(c, digits) for c in floating})


def to_features(df: DataFrame, cols: Sequence[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols]))


def with_label(df: DataFrame, col: str) -> DataFrame:
    return df.withColumnRenamed(col, "label")


def input_width(frame_type: str, raw: int = 14, embedding: int = 768) -> int:
    if frame_type not in FRAME_TYPES:
        raise ValueError(f"unknown frame type {frame_type}")
    if frame_type.startswith("RAW"):
        return raw
    return raw + embedding if "MIX" in frame_type else embedding


def distils(frame_type: str) -> bool:
    """Whether a student of this frame type learns from a teacher."""
    input_width(frame_type)
    return frame_type.endswith("LOGITS")


def _checked(features: Column, width: int | None) -> Column:
    if width is None:
        return features
    return F.when(F.size(features) == width, features).otherwise(
        F.raise_error(F.format_string("feature width %d", F.size(features)))
    )


def assemble(
    raw: DataFrame, emb: DataFrame | None, key: Sequence[str], frame_type: str, width: int | None = None
) -> DataFrame:
    """``key, label, features``: raw values, the embedding, or both, joined by key and never by position.

    ``raw`` has ``key, label, features``; ``emb`` has ``key, embedding``.
    """
    input_width(frame_type)
    if frame_type.startswith("RAW"):
        return raw.select(*key, "label", _checked(F.col("features"), width).alias("features"))
    both = raw.select(*key, "label", F.col("features").alias("_raw")).join(emb.select(*key, "embedding"), list(key))
    values = F.col("embedding").cast("array<double>")
    if "MIX" in frame_type:
        values = F.concat(F.col("_raw"), values)
    return both.select(*key, "label", _checked(values, width).alias("features"))


def teacher_student_frames(raw: DataFrame, emb: DataFrame, key: Sequence[str], teacher: str, student: str) -> DataFrame:
    """``key, label, teacher_features, student_features`` of every row."""
    taught = assemble(raw, emb, key, teacher).withColumnRenamed("features", "teacher_features")
    learns = assemble(raw, emb, key, student).select(*key, F.col("features").alias("student_features"))
    return taught.join(learns, list(key))


# text corpus and embeddings -----------------------------------------------------------------------------------------


def rows_to_json(df: DataFrame, cols: Sequence[str], name: str = "text") -> DataFrame:
    return df.withColumn(name, row_json(cols))


def rows_from_json(df: DataFrame, cols: Sequence[str], name: str = "text") -> DataFrame:
    """The numbers of the texts that ``rows_to_json`` writes, as double columns ``cols`` in place of the text column.

    A parser for each text would take most of the time. A text with every field in order as a bare number is cut at its commas;
    any other (a field absent or quoted, as for a null or NaN, blanks, another order) is parsed by ``from_json``.
    """
    kept = [c for c in df.columns if c != name]
    pieces = df.select(*kept, name, F.split(name, ",").alias("_p"))
    numbers = []
    for i, c in enumerate(cols):
        head, piece = "{" * (i == 0) + f'"{c}":', F.get("_p", F.lit(i))
        number, fits = F.substring(piece, len(head) + 1, 1 << 30), piece.startswith(head)
        if i == len(cols) - 1:
            number, fits = F.substring_index(number, "}", 1), fits & piece.endswith("}") & (F.size("_p") == len(cols))
        numbers.append(F.when(fits, number.try_cast("double")).alias(f"_n{i}"))
    cut = pieces.select(*kept, name, *numbers)
    plain = reduce(and_, [F.col(f"_n{i}").isNotNull() for i in range(len(cols))])
    values = F.struct(*[F.col(f"_n{i}").alias(c) for i, c in enumerate(cols)])
    parsed = F.from_json(name, T.StructType([T.StructField(c, T.DoubleType()) for c in cols]))
    return cut.select(*kept, F.when(plain, values).otherwise(parsed).alias("_v")).select(*kept, "_v.*")


def pool_tokens(tokens: DataFrame, key: Sequence[str], max_tokens: int | None = None, dim: int | None = None) -> DataFrame:
    """Mean vector of a row's unmasked tokens: ``key, dim, value``; ``max_tokens`` keeps positions below it.

    ``tokens`` has ``key, pos, mask, vector``. Rows without such a token get zeros. Sums stay side by side, one row a text and task
    in the shuffle; ``dim`` is the length of the vectors and is looked up when it is not given.
    """
    live = F.coalesce(F.col("mask") == 1, F.lit(False))
    if max_tokens is not None:
        live = live & (F.col("pos") < max_tokens)
    if dim is None:
        dim = tokens.agg(F.max(F.size("vector"))).first()[0] or 0
    cells = [F.when(live, F.get("vector", F.lit(d))).otherwise(0.0) for d in range(dim)]
    sums = tokens.groupBy(*key).agg(*[F.sum(c).alias(f"_s{d}") for d, c in enumerate(cells)], F.count_if(live).alias("_n"))
    means = [F.col(f"_s{d}") / F.greatest("_n", F.lit(1)) for d in range(dim)]
    values = F.array(*means) if means else F.array().cast("array<double>")
    return sums.select(*key, F.posexplode(values).alias("dim", "value"))


def with_token_values(tokens: DataFrame, token: str, dim: int) -> tuple[DataFrame, list[Column]]:
    """Rows with hashed digits, and ``dim`` columns in [-1, 1) over them: four hex digits of an md5 per value.

    Plain columns in two steps, so that code generation hashes a token once per eight values.
    """
    digests = {f"_h{b}": hash_text(F.col(token), b) for b in range((dim + 7) // 8)}
    pieces = {
        f"{h}_{place}": F.conv(F.substring(h, 1 + 4 * place, digits), 16, 10).cast("bigint")
        for h in digests
        for place, digits in ((0, 12), (3, 12), (6, 8))
    }
    rows = tokens.withColumns(digests).withColumns(pieces).drop(*digests)

    def value(d: int) -> Column:
        place = d % 8
        first, size = (place // 3 * 3, 3) if place < 6 else (6, 2)
        shift = 16 * (size - 1 - (place - first))
        digits = F.shiftright(F.col(f"_h{d // 8}_{first}"), shift).bitwiseAND(F.lit(65535))
        return digits.cast("double") / 32768.0 - 1.0

    return rows, [value(d) for d in range(dim)]


def with_token_vector(tokens: DataFrame, token: str, dim: int, name: str = "vector") -> DataFrame:
    rows, values = with_token_values(tokens, token, dim)
    return rows.select(*tokens.columns, F.array(*values).alias(name))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_.]+)"), 1)


def embed_text(df: DataFrame, key: Sequence[str], text: str, dim: int = 16, max_tokens: int | None = None) -> DataFrame:
    """``key, embedding``: the mean vector of a row's word tokens; a row without tokens gets zeros.

    Whole texts by default; ``max_tokens`` stands for the token limit of an embedding model.
    """
    tokens = words(F.col(text)) if max_tokens is None else F.slice(words(F.col(text)), 1, max_tokens)
    # Texts are dealt out by key before they become many rows each; the sums then need no further shuffle.
    dealt = df.select(*key, text).repartition(*key)
    rows, values = with_token_values(dealt.select(*key, F.explode_outer(tokens).alias("_t")), "_t", dim)
    live = [F.when(F.col("_t").isNotNull(), v).otherwise(0.0) for v in values]
    sums = rows.groupBy(*key).agg(*[F.sum(v).alias(f"_s{d}") for d, v in enumerate(live)], F.count("_t").alias("_n"))
    count = F.greatest("_n", F.lit(1))
    return sums.select(*key, F.array(*[F.col(f"_s{d}") / count for d in range(dim)]).alias("embedding"))


def embed_with(df: DataFrame, text: str, make_model: Callable, batch_size: int = 4, name: str = "embedding") -> DataFrame:
    """Embed with a user's model: ``make_model()`` runs once per Python worker and returns texts -> 2-d array."""
    from pyspark.ml.functions import predict_batch_udf

    embed = predict_batch_udf(make_model, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)
    return df.withColumn(name, embed(text))
