"""PII and secret extraction: text rows in, match rows out.

Every text is read once: all patterns of a profile are evaluated in one
projection, each into an array of its matches, and one ``inline`` turns the
arrays into rows. Nothing is shuffled until matches (not texts) are grouped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from piitrace.functions import entities
from piitrace.functions.patterns import (
    BLOB_SECRET,
    EXCLUDED_IPS,
    HEX_RUN,
    SIGNS,
    MASK_ORDER,
    MASK_REGEX,
    MIN_TOKEN_LENGTH,
    PATTERNS,
    PROFILES,
    TOKEN_PATTERNS,
)

MATCHES = (
    "array<struct<pattern_id:string,pattern_ord:int,match_ord:int,pii_type:string,value:string>>"
)


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _staged(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """Text, its lower-cased form and the tests several patterns share: a projection
    of its own, so that each is computed once per row."""
    text = F.col(text_col)
    signs = [F.contains(text, F.lit(c)).alias(f"_has{i}") for i, c in enumerate(SIGNS)]
    return df.select(
        *keep, text.alias("_text"), F.lower(text).alias("_low"),
        text.rlike(HEX_RUN).alias("_hex"), *signs,
    )


def _can_match(pattern_id: str) -> Column:
    """Whether the staged text can match the pattern at all."""
    p = PATTERNS[pattern_id]
    tests = [F.lit(True)]
    if p.sign:
        tests.append(F.col(f"_has{SIGNS.index(p.sign)}"))
    if p.needs:
        tests.append(F.contains(F.col("_low"), F.lit(p.needs)))
    if p.hint:
        tests.append(F.col("_hex") if p.hint == HEX_RUN else F.col("_text").rlike(p.hint))
    return reduce(lambda a, b: a & b, tests)


def _gated(pattern_id: str, hits: Column) -> Column:
    """``hits`` only for texts that can match, else an empty array."""
    return F.when(_can_match(pattern_id), hits).otherwise(_no_strings())


def _raw_hits(pattern_id: str, profile: str, strict_padding: bool = True) -> Column:
    """All texts one pattern takes out of ``_text``, in order of appearance."""
    if pattern_id == "E11":
        found = F.flatten(
            F.transform(
                _raw_hits("E10", profile),
                lambda b: F.coalesce(
                    F.regexp_extract_all(
                        entities.b64_decode(b, strict_padding), F.lit(BLOB_SECRET[profile]), F.lit(1)
                    ),
                    _no_strings(),
                ),
            )
        )
        return _gated("E10", found)
    p = PATTERNS[pattern_id]
    return _gated(
        pattern_id, F.regexp_extract_all(F.col("_text"), F.lit(p.regex), F.lit(p.group))
    )


def _match_structs(pattern_id: str, pattern_ord: int, profile: str) -> Column:
    """Match rows out of the hits of one pattern (column ``_hits_<id>``)."""
    hits = F.col(f"_hits_{pattern_id}")
    kind = "token" if pattern_id == "E11" else PATTERNS[pattern_id].pii_type
    rows = F.transform(
        hits,
        lambda v, i: F.struct(
            F.lit(pattern_id).alias("pattern_id"),
            F.lit(pattern_ord).alias("pattern_ord"),
            i.alias("match_ord"),
            F.lit(kind).alias("pii_type"),
            v.alias("value"),
        ),
    )
    if pattern_id == "E2":
        rows = F.filter(rows, lambda r: ~r["value"].isin(EXCLUDED_IPS[profile]))
    if pattern_id == "E11" or pattern_id in TOKEN_PATTERNS:
        rows = F.filter(rows, lambda r: F.length(r["value"]) >= MIN_TOKEN_LENGTH)
    # most texts have no hit of a pattern: leave the lambdas alone then
    return F.when(F.size(hits) > 0, rows).otherwise(F.array().cast(MATCHES))


def _hit_columns(
    df: DataFrame, keep: list[str], text_col: str, pattern_ids: list[str], profile: str,
    strict_padding: bool = True,
) -> DataFrame:
    """``keep`` and one array column of raw hits per pattern.

    The regexes run in a projection of their own, inside generated code; building
    rows (lambdas, which are interpreted) then only sees the texts with a hit.
    """
    return _staged(df, keep, text_col).select(
        *keep,
        *[_raw_hits(p, profile, strict_padding).alias(f"_hits_{p}") for p in pattern_ids],
    )


def _match_array(pattern_ids: list[str], profile: str) -> Column:
    """All match rows of a text, in pattern order, from its raw hit columns."""
    order = PROFILES[profile]
    arrays = [
        _match_structs(p, order.index(p) if p in order else 0, profile) for p in pattern_ids
    ]
    return arrays[0] if len(arrays) == 1 else F.concat(*arrays)


def _inline_patterns(
    df: DataFrame, text_col: str, id_cols: list[str], pattern_ids: list[str], profile: str,
    strict_padding: bool = True,
) -> DataFrame:
    hits = _hit_columns(df, id_cols, text_col, pattern_ids, profile, strict_padding)
    # the expression itself, not a column of it: for a column Spark would add a filter
    # on its size and push it down, computing every regex a second time
    return hits.select(*id_cols, F.inline(_match_array(pattern_ids, profile)))


def extract(
    df: DataFrame,
    pattern_id: str,
    text_col: str = "line",
    id_cols: tuple[str, ...] = ("log_id",),
    profile: str = "demo",
    strict_padding: bool = True,
) -> DataFrame:
    """Matches of one pattern: ids, pattern_id, pattern_ord, match_ord, pii_type, value.

    ``strict_padding=False`` also decodes base64 blobs that lost their padding (the blob
    pattern drops it), which strict decoding refuses.
    """
    return _inline_patterns(df, text_col, list(id_cols), [pattern_id], profile, strict_padding)


def extract_tokens(
    df: DataFrame, text_col: str = "line", id_cols: tuple[str, ...] = ("log_id",),
    profile: str = "demo",
) -> DataFrame:
    """The token patterns only; group 1 where the pattern has one, longer than 5."""
    return _inline_patterns(df, text_col, list(id_cols), TOKEN_PATTERNS, profile)


def all_matches(
    df: DataFrame, text_col: str = "line", id_cols: tuple[str, ...] = ("log_id",),
    profile: str = "demo", strict_padding: bool = True,
) -> DataFrame:
    """Every match of every pattern of the profile, before any dedupe."""
    return _inline_patterns(
        df, text_col, list(id_cols), PROFILES[profile], profile, strict_padding
    )


def line_matches(
    df: DataFrame, text_col: str = "line", id_cols: tuple[str, ...] = ("log_id",),
    profile: str = "demo",
) -> DataFrame:
    """Matches of a short text with pattern precedence settled inside the row.

    Keeps, per value, the first match in pattern order; no shuffle, so a stream can
    use it before its state.
    """
    hits = _hit_columns(df, list(id_cols), text_col, PROFILES[profile], profile)
    found = hits.select(*id_cols, _match_array(PROFILES[profile], profile).alias("_matches"))
    values = F.transform("_matches", lambda r: r["value"])
    first = F.filter("_matches", lambda r, i: F.array_position(values, r["value"]) == i + 1)
    return found.select(*id_cols, F.inline(first))


# places of match_ord and of pattern_ord in the packed rank of a match
_MATCH_PLACES, _PATTERN_PLACES = 10, 2


def first_seen(
    matches: DataFrame, scope: tuple[str, ...], order: str | None = None, profile: str = "demo"
) -> DataFrame:
    """One row per (scope, value): the first hit by (order, pattern, match) decides the type.

    The three are packed into one number, whose minimum a hash aggregate can keep
    (it could not keep the minimum of a struct and would sort all matches). Map
    tasks thus send one row per value. ``order`` names a non-negative whole-number
    column, such as the log id.
    """
    low = 10 ** (_MATCH_PLACES + _PATTERN_PLACES)
    place = F.col("pattern_ord").cast("bigint") * 10**_MATCH_PLACES + F.col("match_ord")
    if order is None:
        rank, inner = place, F.col("_rank")
    else:
        whole = F.col(order).cast("decimal(19,0)") * F.lit(low).cast("decimal(13,0)")
        rank = (whole + place.cast("decimal(12,0)")).cast("decimal(38,0)")
        inner = (F.col("_rank") % F.lit(low).cast("decimal(13,0)")).cast("bigint")
    best = matches.groupBy(*scope, "value").agg(F.min(rank).alias("_rank"))
    staged = best.withColumn("_inner", inner)
    ids = PROFILES[profile]
    kinds = ["token" if p == "E11" else PATTERNS[p].pii_type for p in ids]
    at = F.floor(F.col("_inner") / F.lit(10**_MATCH_PLACES)).cast("int")
    pick = lambda names: F.get(F.array(*[F.lit(n) for n in names]), at)
    ordered = []
    if order is not None:
        outer = (F.col("_rank") - F.col("_inner")) / F.lit(low).cast("decimal(13,0)")
        ordered = [outer.cast("bigint").alias(order)]
    return staged.select(
        *scope, "value", *ordered, pick(ids).alias("pattern_id"), pick(kinds).alias("pii_type")
    )


def extract_pii(
    df: DataFrame,
    text_col: str = "line",
    scope: tuple[str, ...] = ("scenario_id",),
    order: str | None = "log_id",
    profile: str = "demo",
    strict_padding: bool = True,
) -> DataFrame:
    """Full extractor over a group of texts: all patterns, then first-seen dedupe."""
    ids = scope if order is None else (*scope, order)
    found = all_matches(df, text_col, ids, profile, strict_padding)
    return first_seen(found, scope, order, profile)


def merge_discovered(
    extracted: DataFrame, discovered: DataFrame, scope: tuple[str, ...], rule: str = "unknown"
) -> DataFrame:
    """Add discovered values the extractor missed, typed ``unknown`` or by the fallback rule."""
    if rule == "unknown":
        kind = F.lit("unknown")
    elif rule == "server":
        kind = entities.classify_server(F.col("value"))
    else:
        raise ValueError(f"rule must be unknown or server, not {rule!r}")
    keys = [*scope, "value"]
    missed = (
        discovered.select(*keys).distinct().join(extracted, keys, "left_anti")
        .withColumn("pii_type", kind)
    )
    return extracted.select(*keys, "pii_type").unionByName(missed)


def drop_decoys(matches: DataFrame, decoys: DataFrame) -> DataFrame:
    """Leave out matches listed in the decoy dictionary (a fixed list of 37 rows)."""
    return matches.join(F.broadcast(decoys), ["pii_type", "value"], "left_anti")


def _labelled(log_pii: DataFrame) -> DataFrame:
    return log_pii.groupBy("log_id", "value").agg(F.min("pii_type").alias("label_type"))


def decoy_hits(matches: DataFrame, log_pii: DataFrame) -> DataFrame:
    """Per pattern: hits, hits on values the line is not labelled with, and their share."""
    joined = matches.join(_labelled(log_pii), ["log_id", "value"], "left")
    return (
        joined.groupBy("pattern_id")
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.count(F.when(F.col("label_type").isNull(), 1)).alias("unlabelled"),
        )
        .withColumn("false_positive_rate", F.col("unlabelled") / F.col("hits"))
    )


def extractor_quality(matches: DataFrame, log_pii: DataFrame, profile: str = "demo"
                      ) -> DataFrame:
    """TP / FP / FN per pattern and type; a missed label has pattern ``none``.

    A value several patterns find in one line counts for the first of them.
    """
    found = first_seen(matches, ("log_id",), profile=profile)
    joined = found.join(_labelled(log_pii), ["log_id", "value"], "full_outer")
    hit, label = F.col("pattern_id").isNotNull(), F.col("label_type").isNotNull()
    return (
        joined.groupBy(
            F.coalesce("pattern_id", F.lit("none")).alias("pattern_id"),
            F.coalesce("label_type", "pii_type").alias("pii_type"),
        )
        .agg(
            F.count(F.when(hit & label, 1)).alias("tp"),
            F.count(F.when(hit & ~label, 1)).alias("fp"),
            F.count(F.when(~hit & label, 1)).alias("fn"),
        )
    )


#: Stands for the dots of an address that must stay; a private character no pattern takes.
_KEPT_DOT = "\ue0f0"


def _masked_addresses(text: Column, profile: str) -> Column:
    """Addresses replaced, but for the excluded ones, which extraction leaves out too."""
    for ip in EXCLUDED_IPS[profile]:
        # where extraction would take the whole of it: no digit or further part before it
        at = r"(?<![0-9])(?<![0-9]\.)\b" + ip.replace(".", r"\.") + r"\b"
        text = F.regexp_replace(text, at, ip.replace(".", _KEPT_DOT))
    text = F.regexp_replace(text, PATTERNS["E2"].regex, "[IP]")
    return F.replace(text, F.lit(_KEPT_DOT), F.lit("."))


def _masked_blobs(text: Column, profile: str, strict_padding: bool) -> Column:
    """Blobs that hold a secret replaced, the longest first."""
    blobs = F.array_distinct(_raw_hits("E10", profile))
    secret = lambda b: F.exists(
        F.coalesce(F.regexp_extract_all(entities.b64_decode(b, strict_padding),
                                        F.lit(BLOB_SECRET[profile]), F.lit(1)), _no_strings()),
        lambda v: F.length(v) >= MIN_TOKEN_LENGTH)
    ordered = F.array_sort(F.transform(F.filter(blobs, secret), lambda b: F.struct(
        (-F.length(b)).alias("n"), b.alias("v"))))
    return F.aggregate(ordered, text, lambda acc, r: F.replace(acc, r["v"], F.lit("[TOKEN]")))


def mask_text(df: DataFrame, text_col: str = "line", profile: str = "demo",
              strict_padding: bool = True) -> DataFrame:
    """Replace what extraction finds by ``[TYPE]``, one pattern after the other in profile order.

    An earlier pattern wins where two overlap (an e-mail inside an assignment). Excluded
    addresses stay; a blob goes if it holds a secret.
    """
    staged = _staged(df, df.columns, text_col).withColumn("masked", F.col("_text"))
    for pid in MASK_ORDER[profile]:
        if pid == "E11":
            test, put = _can_match("E10"), _masked_blobs(F.col("masked"), profile, strict_padding)
        elif pid == "E2":
            test, put = _can_match(pid), _masked_addresses(F.col("masked"), profile)
        else:
            p = PATTERNS[pid]
            regex, word = MASK_REGEX.get(pid, (p.regex, f"[{p.pii_type.upper()}]"))
            test, put = _can_match(pid), F.regexp_replace("masked", regex, word)
        # the tests look at the original text: a replacement puts in no character a
        # pattern could use, so what can match later was there before
        staged = staged.withColumn("masked", F.when(test, put).otherwise(F.col("masked")))
    return staged.select(*df.columns, "masked")


def mask_known(df: DataFrame, text_col: str = "line", labels_col: str = "labels") -> DataFrame:
    """Replace the values listed with each line by ``[TYPE]``, longest first.

    ``labels`` is the line's own ARRAY<STRUCT<pii_type, value>>, so this is a
    projection without a join.
    """
    ordered = F.array_sort(
        F.transform(
            F.array_distinct(F.col(labels_col)),
            lambda r: F.struct(
                (-F.length(r["value"])).alias("n"), r["value"].alias("v"), r["pii_type"].alias("t")
            ),
        )
    )
    masked = F.aggregate(
        ordered,
        F.col(text_col),
        lambda acc, r: F.replace(
            acc, r["v"], F.concat(F.lit("["), F.upper(r["t"]), F.lit("]"))
        ),
    )
    return df.withColumn("masked", masked)


def pii_rates(docs: DataFrame, by: tuple[str, ...] = ("source", "lang"), text_col: str = "text",
              profile: str = "demo") -> DataFrame:
    """Documents, documents with a hit, hits and distinct values, rolled up over ``by``.

    The matches stay with their document row, so there is no join back.
    """
    hits = _hit_columns(docs, list(by), text_col, PROFILES[profile], profile)
    rows = hits.select(
        *by, F.posexplode_outer(_match_array(PROFILES[profile], profile)).alias("pos", "m")
    )
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    return (
        rows.select(*by, "pos", F.col("m.value").alias("value"), first.alias("first"))
        .rollup(*by)
        .agg(
            F.count(F.when(F.col("first"), 1)).alias("docs"),
            F.count(F.when(F.col("pos") == 0, 1)).alias("docs_with_pii"),
            F.count("value").alias("hits"),
            F.count_distinct("value").alias("distinct_values"),
        )
    )


#: Registers of a sketch, as a power of two: estimates are off by 0.8 % in a standard deviation.
SKETCH = 14
#: Three standard deviations of an estimate.
SKETCH_ERROR = 3 * 1.04 / 2 ** (SKETCH / 2)


def pii_sketches(docs: DataFrame, by: tuple[str, ...] = ("source", "lang"), text_col: str = "text",
                 profile: str = "demo") -> DataFrame:
    """What `sketched_rates` needs per group: documents, documents with a hit, hits, and a sketch of the
    distinct values. Map tasks fold their hits into sketches, so what is shuffled does not grow with them.
    Tables of several runs over different documents may be put together by a union."""
    hits = _hit_columns(docs, list(by), text_col, PROFILES[profile], profile)
    rows = hits.select(*by, F.posexplode_outer(_match_array(PROFILES[profile], profile)).alias("pos", "m"))
    return rows.groupBy(*by).agg(
        F.count(F.when(F.coalesce("pos", F.lit(0)) == 0, 1)).alias("docs"),
        F.count(F.when(F.col("pos") == 0, 1)).alias("docs_with_pii"),
        F.count("m.value").alias("hits"),
        F.hll_sketch_agg("m.value", SKETCH).alias("sketch"),
    )


def sketched_rates(sketches: DataFrame, by: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """`pii_rates` from sketches: only their few rows are rolled up. ``distinct_values`` is an estimate; it
    is off by more than ``SKETCH_ERROR`` three times in a thousand, and not at all for few values."""
    return sketches.rollup(*by).agg(
        F.sum("docs").alias("docs"), F.sum("docs_with_pii").alias("docs_with_pii"), F.sum("hits").alias("hits"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_values"),
    )
