"""Column expressions: parsing, cleaning, labels, activations and vector text. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: feature ceiling, sparse-value ceiling, weight offset, class spellings
DENSE_CEILING = 1e8
SPARSE_CEILING = 1e4
WEIGHT_OFFSET = 1.1
CLASS_0 = ("0", "0.0")
CLASS_1 = ("1", "1.0")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A value named inside a lambda of ``transform`` would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    """Drop white space (tabs too) at both ends."""
    return F.regexp_replace(_col(text), r"^\s+|\s+$", "")


def parse_float(token: Column | str) -> Column:
    """The number in a text token, or null.

    Accepts signs, exponents, ``nan``, ``inf``, padding and ``1_0``; rejects the type suffixes
    (``1d``, ``2f``) and hexadecimal numbers that a plain cast would take.
    """
    token = strip(token)
    plain = token.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$")
    named = token.rlike(r"(?i)^[+-]?(inf|infinity|nan)$")
    number = F.regexp_replace(token, "_", "").try_cast("double")
    special = (
        F.when(token.rlike(r"(?i)nan$"), F.lit(float("nan")))
        .when(token.startswith("-"), F.lit(float("-inf")))
        .otherwise(F.lit(float("inf")))
    )
    return F.when(plain, number).when(named, special)


def parse_int(token: Column | str) -> Column:
    token = strip(token)
    digits = F.regexp_replace(token, "_", "").try_cast("bigint")
    return F.when(token.rlike(r"^[+-]?\d+(_\d+)*$"), digits)


def clean_dense_value(value: Column | str, nan: str = "keep") -> Column:
    """Unparsable, negative or too large becomes 0. NaN is kept, or 0 with ``nan="zero"``."""
    value = _col(value)
    return (
        F.when(value.isNull(), 0.0)
        .when(F.isnan(value), F.lit(float("nan") if nan == "keep" else 0.0))
        .when((value < 0) | (value > DENSE_CEILING), 0.0)
        .otherwise(value)
    )


def clean_dense_feature(tokens: Column | str, nan: str = "keep") -> Column:
    """Array of text tokens to array of clean numbers."""
    return F.transform(_col(tokens), lambda t: clean_dense_value(parse_float(t), nan))


def clean_sparse_value(value: Column | str) -> Column:
    """Missing becomes 0, values above the ceiling their natural logarithm; negatives stay."""
    value = _col(value)
    return F.when(value.isNull(), 0.0).when(value > SPARSE_CEILING, F.log(value)).otherwise(value)


def clean_sparse_token(token: Column | str) -> Column:
    """``idx:val`` to a struct (0-based idx, val); null when the index is not an integer."""
    parts = F.split(_col(token), ":")
    idx = parse_int(F.get(parts, F.lit(0)))
    val = clean_sparse_value(parse_float(F.get(parts, F.lit(1))))
    return F.when(idx.isNotNull(), F.struct((idx - 1).cast("int").alias("idx"), val.alias("val")))


def log_weight(intimacy: Column | str) -> Column:
    return F.log(F.lit(WEIGHT_OFFSET) + _col(intimacy))


def default_weight(w: Column | str, value: float = 1.0) -> Column:
    return F.coalesce(_col(w), F.lit(value))


def class_label(text: Column | str) -> Column:
    """0 or 1, null when unknown."""
    text = _col(text)
    return F.when(text.isin(*CLASS_0), 0).when(text.isin(*CLASS_1), 1)


def one_hot_label(text: Column | str) -> Column:
    """[1, 0], [0, 1], or [0, 0] for an unknown class."""
    text = _col(text)
    return F.array(
        F.when(text.isin(*CLASS_0), 1).otherwise(0), F.when(text.isin(*CLASS_1), 1).otherwise(0)
    )


def composite_key(a: Column | str, b: Column | str) -> Column:
    return F.concat_ws("\t", _col(a), _col(b))


def split_composite_key(key: Column | str) -> tuple[Column, Column]:
    parts = F.split(_col(key), "\t")
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def predict_class(logits: Column | str) -> Column:
    """Position of the largest logit; the first wins a tie."""
    logits = _col(logits)
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def predict_multilabel(logits: Column | str) -> Column:
    return F.transform(_col(logits), lambda x: F.when(x > 0, 1).otherwise(0))


def vector_sum(vec: Column | str) -> Column:
    return F.aggregate(_col(vec), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return vector_sum(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def log_sum_exp(logits: Column | str) -> Column:
    logits = _col(logits)
    return let(F.array_max(logits), lambda top: top + F.log(vector_sum(F.transform(logits, lambda x: F.exp(x - top)))))


def softmax(logits: Column | str) -> Column:
    logits = _col(logits)
    return let(log_sum_exp(logits), lambda lse: F.transform(logits, lambda x: F.exp(x - lse)))


def sigmoid(x: Column | str) -> Column:
    """Written so that neither tail overflows."""
    x = _col(x)
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1.0 / (1.0 + small)).otherwise(small / (1.0 + small))


def relu(vec: Column | str) -> Column:
    return F.transform(_col(vec), lambda x: F.greatest(x, F.lit(0.0)))


def leaky(vec: Column | str, slope: float) -> Column:
    """Leaky or parametric ReLU: negatives times ``slope``."""
    return F.transform(_col(vec), lambda x: F.when(x < 0, x * slope).otherwise(x))


def layer_norm(vec: Column | str, offset=None, scale=None, eps: float = 1e-9) -> Column:
    """Normalise each row by its own mean and population variance, then scale and shift.

    ``offset`` and ``scale`` are lists of numbers or array columns.
    """
    vec = _col(vec)
    n = F.size(vec)
    centred = let(vector_sum(vec) / n, lambda mean: F.transform(vec, lambda x: x - mean))
    out = let(
        centred,
        lambda c: let(F.sqrt(dot(c, c) / n + eps), lambda root: F.transform(c, lambda x: x / root)),
    )
    if scale is not None:
        out = F.zip_with(out, _array(scale), lambda x, s: x * s)
    if offset is not None:
        out = F.zip_with(out, _array(offset), lambda x, o: x + o)
    return out


def _array(values) -> Column:
    if isinstance(values, (str, Column)):
        return _col(values)
    return F.array(*[F.lit(float(v)) for v in values])


def row_normalize(vec: Column | str) -> Column:
    """Divide by the row sum; a row that sums to 0 becomes zeros."""
    vec = _col(vec)
    return let(vector_sum(vec), lambda total: F.transform(vec, lambda x: F.when(total == 0, 0.0).otherwise(x / total)))


def unit_vector(vec: Column | str) -> Column:
    vec = F.transform(_col(vec), lambda x: x.cast("double"))
    return let(F.sqrt(dot(vec, vec)), lambda norm: F.transform(vec, lambda x: F.when(norm == 0, 0.0).otherwise(x / norm)))


def cosine(a: Column | str, b: Column | str) -> Column:
    a, b = _col(a), _col(b)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def vec_to_string(vec: Column | str, sep: str = " ") -> Column:
    return F.concat_ws(sep, F.transform(_col(vec), lambda x: x.cast("string")))


def string_to_vec(text: Column | str, sep: str = " ", kind: str = "float") -> Column:
    """Split at the literal separator and cast; a bad token becomes null."""
    return F.transform(F.split(_col(text), f"\\Q{sep}\\E"), lambda x: x.try_cast(kind))


def vec_to_columns(df: DataFrame, vec: str, dim: int, prefix: str = "v") -> DataFrame:
    others = [c for c in df.columns if c != vec]
    return df.select(*others, *[F.get(vec, F.lit(i)).alias(f"{prefix}{i + 1}") for i in range(dim)])
