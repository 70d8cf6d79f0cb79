"""Scoring requests: checks with reasons, feature rows, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import CALENDAR_FEATURES, calendar_columns, np_round
from ..schema import DATE_FORMAT, RequestError

# ---- fixed values ----
ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
REQUEST_FLAG_FIELDS = ("snap_day", "holiday", "has_named_event")
DIRECT_FIELDS = ("price", *REQUEST_FLAG_FIELDS)


def _given() -> Column:
    """The feature list, empty where the request has none."""
    return F.coalesce(F.col("features"),
                      F.array().cast("array<struct<name:string,value:double>>"))


def _names() -> Column:
    return _given().getField("name")


def request_date() -> Column:
    """The date of a request in strict form, NULL otherwise."""
    text = F.col("date").cast("string")
    return F.when(text.rlike(ISO_DATE), F.try_to_date(text, DATE_FORMAT))


def validate_requests(df: DataFrame, feature_names: list[str]) -> DataFrame:
    """Adds ``reasons``: why a request cannot be scored; empty when it can."""
    text, names = F.col("date").cast("string"), _names()
    known = F.array(*[F.lit(n) for n in feature_names]).cast("array<string>")
    checks = {
        "bad_date_format": ~F.coalesce(text.rlike(ISO_DATE), F.lit(False)),
        "not_a_date": text.rlike(ISO_DATE) & request_date().isNull(),
        "empty_product": F.coalesce(F.col("product_id"), F.lit("")) == "",
        "price_not_positive": ~F.coalesce(
            (F.col("price") > 0) & ~F.isnan("price"), F.lit(False)),
        **{f"bad_{f}": ~F.coalesce(F.col(f), F.lit(0)).isin(0, 1)
           for f in REQUEST_FLAG_FIELDS},
        "empty_feature_name": F.coalesce(F.array_contains(names, ""), F.lit(True)),
        "duplicate_feature": F.size(names) != F.size(F.array_distinct(names)),
        "unknown_feature": F.size(F.array_except(names, known)) > 0,
    }
    found = F.array(*[F.when(cond, F.lit(name)) for name, cond in checks.items()])
    return df.withColumn("reasons", F.array_compact(found))


def valid_requests(df: DataFrame, feature_names: list[str]) -> DataFrame:
    checked = validate_requests(df, feature_names)
    return checked.where(F.size("reasons") == 0).drop("reasons")


def rejected_requests(df: DataFrame, feature_names: list[str]) -> DataFrame:
    return validate_requests(df, feature_names).where(F.size("reasons") > 0)


def request_calendar(df: DataFrame) -> DataFrame:
    """Calendar features derived from the date of each request."""
    return df.withColumns(calendar_columns(request_date()))


def request_features(df: DataFrame, feature_names: list[str]) -> DataFrame:
    """One double column per model feature, next to the request.

    A value of the request's list wins over everything, also when it is
    missing; then come calendar values and direct fields; the rest is NULL.
    """
    calendar = calendar_columns(request_date())
    names = _names()
    values = _given().getField("value")
    out = []
    for name in feature_names:
        if name in CALENDAR_FEATURES:
            default = calendar[name].cast("double")
        elif name in DIRECT_FIELDS:
            default = F.coalesce(F.col(name).cast("double"), F.lit(0.0))
        else:
            default = F.lit(None).cast("double")
        place = F.array_position("_names", F.lit(name)).cast("int")
        given = F.when(place > 0, F.try_element_at("_values", place))
        out.append(F.when(place > 0, given).otherwise(default).alias(f"x_{name}"))
    clash = [c for c in df.columns if c in ("_names", "_values")]
    return (df.drop(*clash).withColumns({"_names": names, "_values": values})
            .select(*[c for c in df.columns if c not in clash], *out))


def score_requests(df: DataFrame, bundle) -> DataFrame:
    """Every request with its status, prediction and reasons.

    One pass through the model; rejected requests keep their reasons and
    get no prediction. Predictions are cut at 0 and rounded to 3 digits.
    """
    names = bundle.feature_names
    checked = validate_requests(df, names)
    rows = request_features(checked, names)
    taken = [c for c in rows.columns if not c.startswith("x_")]
    # The model reads the plain feature names; requests step aside for it.
    packed = rows.select(F.struct(*taken).alias("_request"),
                         *[F.col(f"x_{n}").alias(n) for n in names])
    scored = bundle.model.transform(packed)
    ok = F.size("_request.reasons") == 0
    value = np_round(F.greatest(F.col("prediction"), F.lit(0.0)), 3)
    keep = [c for c in df.columns if c != "reasons"]
    return scored.select(
        *[F.col(f"_request.{c}").alias(c) for c in keep],
        F.when(ok, "success").otherwise("error").alias("status"),
        F.when(ok, value).alias("predicted_sales"),
        F.lit(bundle.model_type).alias("model_type"),
        F.col("_request.reasons").alias("reasons"))


def score_batch(df: DataFrame, bundle, mode: str = "FAILFAST") -> DataFrame:
    """Scores a batch.

    ``FAILFAST`` refuses an empty batch and any batch with a bad request;
    ``SPLIT`` scores the good requests and keeps the others with reasons.
    """
    if mode not in ("FAILFAST", "SPLIT"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "FAILFAST":
        checked = validate_requests(df, bundle.feature_names)
        state = checked.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.size("reasons") > 0).alias("bad"),
            F.max(F.when(F.size("reasons") > 0, F.concat_ws(",", "reasons")))
            .alias("example")).first()
        if not state["n"]:
            raise RequestError("batch is empty")
        if state["bad"]:
            raise RequestError(f"{state['bad']:,} of {state['n']:,} requests are "
                               f"invalid, e.g. {state['example']}")
    return score_requests(df, bundle)
