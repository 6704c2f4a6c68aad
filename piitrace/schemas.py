"""Declared schemas of every table. Nothing is inferred."""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _table(*fields):
    return StructType([StructField(name, dtype) for name, dtype in fields])


S, I, L, D, B = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()

ACTION_TYPES = ("scan", "investigate", "redact", "submit")
DIFFICULTIES = ("easy", "medium", "hard")
PII_TYPES = ("email", "ip", "username", "token", "phone")

LABEL = _table(("pii_type", S), ("value", S))
REDACTION_ITEM = _table(("original", S), ("type", S))

USERS = _table(
    ("scenario_id", L), ("ord", L), ("difficulty", S), ("username", S), ("email", S),
    ("ips", ArrayType(S)), ("services", ArrayType(S)),
)
SECRETS = _table(
    ("scenario_id", L), ("secret_id", S), ("token", S), ("token_type", S),
    ("owner", S), ("service", S),
)
LOGS = _table(
    ("scenario_id", L), ("log_id", L), ("layer", I), ("line", S), ("labels", ArrayType(LABEL)),
)
LOG_LINES = _table(("scenario_id", L), ("log_id", L), ("layer", I), ("line", S))
LOG_PII = _table(("scenario_id", L), ("log_id", L), ("pii_type", S), ("value", S))
EDGES = _table(("scenario_id", L), ("src", S), ("dst", S))
TRUTH = _table(("scenario_id", L), ("pii_type", S), ("value", S))
HONEYPOTS = _table(("scenario_id", L), ("value", S))
DIFFICULTY_CFG = _table(
    ("difficulty", S), ("n_users", I), ("n_layers", I), ("budget", I),
    ("n_secrets", I), ("n_decoys", I), ("n_deadends", I),
)
DECOYS = _table(("pii_type", S), ("value", S))
ACTIONS = _table(
    ("episode_id", L), ("scenario_id", L), ("strategy", I), ("step", I),
    ("action_type", S), ("target_entity", S),
)
ACTION_RECORD = _table(
    ("episode_id", L), ("scenario_id", L), ("strategy", I), ("step", I),
    ("action_type", S), ("target_entity", S), ("redactions", ArrayType(REDACTION_ITEM)),
)
REDACTIONS = _table(("episode_id", L), ("step", I), ("pos", I), ("original", S), ("type", S))
GRADER_INPUT = _table(
    ("case_id", L), ("redacted", ArrayType(S)), ("ground_truth", ArrayType(S)),
    ("discovered", ArrayType(S)), ("steps_used", I), ("steps_budget", I),
    ("secret_tokens", ArrayType(S)),
)
TRACE_LINES = _table(("file", S), ("line_no", L), ("value", S))
AGENT_ANSWERS = _table(("episode_id", L), ("step", I), ("answer", S))
AGENT_JSON = _table(("action", S), ("target", S), ("reason", S))
EPISODE_RESULTS = _table(
    ("difficulty", S), ("seed", L), ("steps", I), ("total_score", D), ("f1_score", D),
    ("discovery_rate", D), ("success", B), ("rewards", ArrayType(D)), ("error", S),
)
