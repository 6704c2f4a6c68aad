"""Entity tests, classifiers and log-line helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shapes and heads the classifiers test for.
QUAD = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$"
OPEN_QUAD = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"
GENERIC_PHONE = r"^\+[0-9]{1,3}-[0-9]{3}-[0-9]{3}-[0-9]{4}$"
US_PHONE = r"^\+1-[0-9]{3}-[0-9]{3}-[0-9]{4}$"
INDIA_PHONE = r"^\+91-[0-9]{5}-[0-9]{5}$"
LONDON_PHONE = r"^\+44-20-[0-9]{4}-[0-9]{4}$"
SHORT_555_PHONE = r"^\+1-555-[0-9]{4}-[0-9]{3}$"
SECRET_HEADS = [
    "sk_live_", "sk_test_", "ghp_", "hf_", "akia", "asia", "eyJ", "api_key_", "xoxp-", "xoxb-",
    "bearer ",
]
MASK_HEAD = "sk_l**e_"


def is_ipv4(c: Column) -> Column:
    """Exactly four all-digit parts, each at most 255."""
    parts = F.split(c, r"\.", -1)
    part_ok = lambda p: F.coalesce(
        p.rlike("^[0-9]+$") & (F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("int") <= 255),
        F.lit(False),
    )
    return (F.size(parts) == 4) & F.forall(parts, part_ok)


def is_phone(c: Column, mode: str = "strict") -> Column:
    """Four phone shapes. In ``strict`` mode the 555 shape is never reached: any
    four-part ``+1-`` text is already decided by the US shape."""
    t = F.trim(c)
    hit = t.rlike(US_PHONE) | t.rlike(INDIA_PHONE) | t.rlike(LONDON_PHONE)
    if mode == "fixed":
        hit = hit | t.rlike(SHORT_555_PHONE)
    elif mode != "strict":
        raise ValueError(f"mode must be strict or fixed, not {mode!r}")
    return F.coalesce(hit, F.lit(False))


def _has_at_and_dot(c: Column) -> Column:
    return c.contains("@") & c.contains(".")


def classify_env(df: DataFrame, truth: DataFrame, col: str = "value") -> DataFrame:
    """email / ip / token (if a truth token of the scenario) / username.

    The token test is a left join, its size decided by Spark's own statistics.
    """
    tokens = (
        truth.filter("pii_type = 'token'")
        .select("scenario_id", F.col("value").alias(col), F.lit(True).alias("_is_token"))
        .distinct()
    )
    c = F.col(col)
    return (
        df.join(tokens, ["scenario_id", col], "left")
        .withColumn(
            "entity_class",
            F.when(_has_at_and_dot(c), "email")
            .when(c.rlike(QUAD), "ip")
            .when(F.col("_is_token"), "token")
            .otherwise("username"),
        )
        .drop("_is_token")
    )


def classify_driver(c: Column, phone_mode: str = "strict") -> Column:
    low = F.lower(c)
    head = F.lit(False)
    for text in SECRET_HEADS:
        # one head is mixed case and the text is lower-cased, so it never hits;
        # such values reach "token" through their length
        head = head | low.startswith(text)
    return (
        F.when(_has_at_and_dot(c), "email")
        .when(is_phone(c, phone_mode), "phone")
        .when(is_ipv4(c), "ip")
        .when(head | (F.length(c) > 24), "token")
        .otherwise("username")
    )


def classify_server(c: Column) -> Column:
    return (
        F.when(c.contains("@"), "email")
        .when(c.rlike(OPEN_QUAD), "ip")
        .when(c.rlike(GENERIC_PHONE), "phone")
        .when(F.length(c) > 15, "token")
        .otherwise("username")
    )


def classify_test(c: Column) -> Column:
    return (
        F.when(c.contains("@"), "email")
        .when(c.rlike(GENERIC_PHONE), "phone")
        .when(c.rlike(QUAD), "ip")
        .when(F.length(c) > 15, "token")
        .otherwise("username")
    )


HEADER = r"^([0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}) ([A-Z_]+)(?: \[([^\]]+)\])?: (.*)$"


def parse_line(df: DataFrame, col: str = "line") -> DataFrame:
    """Split a log line into event time, category, optional service and message."""
    c = F.col(col)
    part = lambda i: F.nullif(F.regexp_extract(c, HEADER, i), F.lit(""))
    return df.withColumns(
        {
            "ts": F.try_to_timestamp(part(1)).cast("timestamp_ntz"),
            "category": part(2),
            "service": part(3),
            "message": part(4),
        }
    )


def time_part(ts_text: Column) -> Column:
    return F.get(F.split(ts_text, " "), 1)


def b64(c: Column) -> Column:
    """Base64 text on one line (Spark breaks lines after 76 characters)."""
    return F.regexp_replace(F.base64(c.cast("binary")), "\r\n", "")


def b64_decode(c: Column, strict: bool = True) -> Column:
    """Decoded text. Strict takes only whole groups of four; otherwise missing
    padding is repaired. Spark's own decoder is lenient, hence the length test.
    Bytes that are not UTF-8 are dropped."""
    bare = F.regexp_replace(c, "=+$", "")
    repaired = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), "=")
    source = F.when(F.length(c) % 4 == 0, c) if strict else repaired
    text = F.make_valid_utf8(F.try_to_binary(source, F.lit("base64")).cast("string"))
    return F.regexp_replace(text, "�", "")


def mask_secret(c: Column) -> Column:
    return F.concat(F.lit(MASK_HEAD), F.right(c, F.lit(8)))


def title(c: Column) -> Column:
    return F.initcap(c)
