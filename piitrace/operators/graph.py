"""Entity graph, log reveal and discovery as joins and set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from piitrace.operators.ordering import number_within

VALUE = ["scenario_id", "value"]


def flatten_layers(layers: DataFrame) -> DataFrame:
    """Nested layers to a flat log table: ``log_id`` counts layer by layer from 0.

    Input ``(scenario_id, layers ARRAY<ARRAY<STRUCT<...>>>)``. The position in the
    flat list is the size of the layers before it plus the position in its own
    layer, both known inside the row, so nothing is sorted or shuffled.
    """
    before = F.aggregate(
        F.slice("layers", F.lit(1), F.col("layer")), F.lit(0).cast("bigint"),
        lambda acc, x: acc + F.size(x),
    )
    per_layer = layers.select(
        "scenario_id", "layers", F.posexplode("layers").alias("layer", "entries")
    ).select("scenario_id", "layer", before.alias("offset"), "entries")
    return per_layer.select(
        "scenario_id", "layer", "offset", F.posexplode("entries").alias("pos", "entry")
    ).select(
        "scenario_id", (F.col("offset") + F.col("pos")).alias("log_id"), "layer", "entry.*"
    )


def index_logs(logs: DataFrame, order: str = "log_id") -> DataFrame:
    """Flat 0-based index of logs that arrive as rows, by (layer, order)."""
    numbered = number_within(logs, ["scenario_id"], ["layer", order], "log_index")
    return numbered.withColumn("log_index", F.col("log_index") - 1)


def initial_visible(logs: DataFrame) -> DataFrame:
    return logs.filter("layer = 0")


def scenario_info(scenarios: DataFrame, truth: DataFrame) -> DataFrame:
    """Seed, difficulty, truth size, layers and budget per scenario."""
    size = truth.groupBy("scenario_id").agg(F.count_distinct("value").alias("total_pii"))
    return scenarios.join(size, "scenario_id", "left").select(
        F.col("scenario_id").alias("scenario_seed"), "difficulty",
        F.coalesce("total_pii", F.lit(0)).alias("total_pii"), "n_layers", "budget",
    )


def user_edges(users: DataFrame) -> DataFrame:
    """user-email, user-ip and email-ip in both directions, directed and distinct."""
    pair = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    name, email, ip = F.col("username"), F.col("email"), F.col("ip")
    rows = users.select("scenario_id", "username", "email", F.explode("ips").alias("ip"))
    return rows.select(
        "scenario_id",
        F.inline(
            F.array(
                pair(name, email), pair(name, ip), pair(email, name), pair(email, ip),
                pair(ip, name), pair(ip, email),
            )
        ),
    ).distinct()


def secret_edges(users: DataFrame, secrets: DataFrame) -> DataFrame:
    """owner to token and each of the owner's addresses to token; nothing leads back."""
    owned = secrets.select("scenario_id", F.col("owner").alias("username"), "token").join(
        users.select("scenario_id", "username", "ips"), ["scenario_id", "username"]
    )
    sources = F.explode(F.concat(F.array("username"), F.col("ips")))
    return owned.select(
        "scenario_id", sources.alias("src"), F.col("token").alias("dst")
    ).distinct()


def deadends(candidates: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices ``(scenario_id, value)`` without an outgoing edge."""
    sources = edges.select("scenario_id", F.col("src").alias("value"))
    return candidates.select(*VALUE).distinct().join(sources, VALUE, "left_anti")


def honeypots(planted: DataFrame) -> DataFrame:
    return planted.select(*VALUE).distinct()


def neighbours(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets with ``dst``, one row per outgoing edge."""
    out = edges.withColumnRenamed("src", "target")
    return targets.join(out, ["scenario_id", "target"])


def search_set(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """Target plus its neighbours as ``value``, distinct per target row."""
    keys = targets.columns
    own = targets.withColumn("value", F.col("target"))
    linked = neighbours(targets, edges).withColumnRenamed("dst", "value").select(*own.columns)
    return own.unionByName(linked).select(*keys, "value").distinct()


def reveal(logs: DataFrame, log_pii: DataFrame, search: DataFrame,
           visible: DataFrame | None = None) -> DataFrame:
    """Logs not yet visible whose labels meet the search set of their scenario."""
    hit = log_pii.join(search.select(*VALUE).distinct(), VALUE, "left_semi")
    keys = ["scenario_id", "log_id"]
    hidden = logs.filter("layer > 0") if visible is None else logs.join(visible, keys, "left_anti")
    return hidden.join(hit, keys, "left_semi")


def discover(visible: DataFrame, log_pii: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Distinct labelled values of the visible logs, less the known ones."""
    seen = log_pii.join(
        visible.select("scenario_id", "log_id"), ["scenario_id", "log_id"], "left_semi"
    ).select(*VALUE).distinct()
    return seen if known is None else seen.join(known, VALUE, "left_anti")


def targets(discovered: DataFrame, investigated: DataFrame, keys: list[str]) -> DataFrame:
    """Discovered and not yet investigated."""
    return discovered.select(*keys).join(investigated.select(*keys), keys, "left_anti")


def suggestions(discovered: DataFrame, investigated: DataFrame, redacted: DataFrame,
                keys: list[str]) -> DataFrame:
    """Discovered, neither investigated nor redacted."""
    return targets(discovered, investigated, keys).join(
        redacted.select(*keys), keys, "left_anti"
    )


def honeypot_hits(actions: DataFrame, planted: DataFrame) -> DataFrame:
    """Investigations of a honeypot of their own scenario."""
    traps = planted.select("scenario_id", F.col("value").alias("target_entity"))
    return actions.filter("action_type = 'investigate'").join(
        traps, ["scenario_id", "target_entity"], "left_semi"
    )


def new_secrets(found: DataFrame, truth: DataFrame) -> DataFrame:
    """The found values that are tokens of their scenario's truth."""
    tokens = truth.filter("pii_type = 'token'").select(*VALUE)
    return found.join(tokens, VALUE, "left_semi")


def truth_table(users: DataFrame, secrets: DataFrame, phones: DataFrame) -> DataFrame:
    """All true values by type, distinct."""
    kind = lambda t, v: F.struct(F.lit(t).alias("pii_type"), v.alias("value"))
    named = users.select(
        "scenario_id",
        F.inline(
            F.concat(
                F.array(kind("username", F.col("username")), kind("email", F.col("email"))),
                F.transform("ips", lambda ip: kind("ip", ip)),
            )
        ),
    )
    tokens = secrets.select("scenario_id", F.lit("token").alias("pii_type"),
                            F.col("token").alias("value"))
    numbers = phones.select("scenario_id", F.lit("phone").alias("pii_type"),
                            F.col("phone").alias("value"))
    return named.unionByName(tokens).unionByName(numbers).distinct()


def truth_flat(truth: DataFrame) -> DataFrame:
    """One row per (scenario, value) with a token flag."""
    return truth.groupBy(*VALUE).agg(
        F.max(F.col("pii_type") == "token").alias("is_token")
    )


def remaining(truth: DataFrame, redacted: DataFrame) -> DataFrame:
    """True values no redaction of the episode names. ``redacted``: episode, scenario, value."""
    episodes = redacted.select("episode_id", "scenario_id").distinct()
    wanted = truth.select(*VALUE).distinct().join(episodes, "scenario_id")
    keys = ["episode_id", *VALUE]
    return wanted.select(*keys).join(redacted.select(*keys), keys, "left_anti")


def entity_layer(entities: DataFrame, logs: DataFrame, log_pii: DataFrame,
                 scenarios: DataFrame) -> DataFrame:
    """First layer an entity is labelled in; the last layer if in none."""
    labelled = log_pii.join(logs.select("scenario_id", "log_id", "layer"),
                            ["scenario_id", "log_id"])
    first = labelled.groupBy(*VALUE).agg(F.min("layer").alias("first_layer"))
    return (
        entities.select(*VALUE).distinct()
        .join(first, VALUE, "left")
        .join(scenarios.select("scenario_id", "n_layers"), "scenario_id")
        .select(*VALUE, F.coalesce("first_layer", F.col("n_layers") - 1).alias("layer"))
    )


def pii_by_layer(logs: DataFrame) -> DataFrame:
    """Distinct values per scenario and layer, as rows (a layer has no size limit)."""
    return logs.select("scenario_id", "layer", F.inline("labels")).select(
        "scenario_id", "layer", "value"
    ).distinct()


def undiscoverable(truth: DataFrame, log_pii: DataFrame) -> DataFrame:
    """True values no log line is labelled with."""
    return truth.join(log_pii.select(*VALUE), VALUE, "left_anti")
