"""Synthetic log queries (N): scenarios are seeded by the rows of ``customer``."""

from string import Formatter

from pyspark.sql import functions as F

from piitrace.registry.base import add, table
from piitrace.registry.oracle import listing
from piitrace.sources import dims, synth

c = F.col


def _seeds(spark, folder):
    return synth.scenario_seeds(table(spark, folder, "customer"), "c_custkey")


def _users(spark, folder):
    return synth.gen_users(_seeds(spark, folder))


def num(tag, *ids):
    return (f"CAST('0x' || substr(md5(concat_ws(':', '0', '{tag}', {', '.join(ids)})), 1, 7) "
            "AS BIGINT)")


def pick(values, index):
    return f"({listing(values)})[CAST({index} AS INT) + 1]"


def ip_sql(*ids):
    n = lambda tag: num(tag, *ids)
    last = f"({n('ip-d')} % 254 + 1)"
    return f"""CASE {n('ip')} % 4
      WHEN 0 THEN '10.' || ({n('ip-b')} % 256) || '.' || ({n('ip-c')} % 256) || '.' || {last}
      WHEN 1 THEN '172.' || ({n('ip-b')} % 16 + 16) || '.' || ({n('ip-c')} % 256) || '.' || {last}
      WHEN 2 THEN '192.168.' || ({n('ip-c')} % 256) || '.' || {last}
      ELSE '203.0.113.' || {last} END"""


def digits(tag, size, *ids):
    return f"lpad(CAST({num(tag, *ids)} % {10**size} AS VARCHAR), {size}, '0')"


def phone_sql(*ids):
    d = lambda tag, size: digits(tag, size, *ids)
    return f"""CASE {num('phone', *ids)} % 4
      WHEN 0 THEN '+1-' || {d('p3', 3)} || '-' || {d('q3', 3)} || '-' || {d('p4', 4)}
      WHEN 1 THEN '+91-' || {d('p5', 5)} || '-' || {d('q5', 5)}
      WHEN 2 THEN '+44-20-' || {d('p4', 4)} || '-' || {d('q4', 4)}
      ELSE '+1-555-' || {d('p4', 4)} || '-' || {d('p3', 3)} END"""


def token_sql(kind, *ids):
    joined = ", ".join(ids)
    body = (f"(md5(concat_ws(':', '0', 'token', {joined})) || "
            f"md5(concat_ws(':', '0', 'token-2', {joined})))")
    cases = []
    for name, head, size in dims.TOKEN_KINDS:
        tail = f"substr({body}, 1, {size})"
        tail = f"upper({tail})" if name == "aws_access" else tail
        cases.append(f"WHEN '{name}' THEN '{head}' || {tail}")
    return f"CASE {kind} {' '.join(cases)} END"


def stamp_sql(*ids):
    n = f"({num('ts', *ids)} % 86400)"
    two = lambda x: f"lpad(CAST({x} AS VARCHAR), 2, '0')"
    return (f"'{synth.DAY} ' || {two(f'{n} // 3600')} || ':' || {two(f'{n} % 3600 // 60')} || ':' "
            f"|| {two(f'{n} % 60')}")


SEEDS = """SELECT c_custkey AS scenario_id, k.* FROM customer JOIN (SELECT
  row_number() OVER () - 1 AS m, * FROM (VALUES ('easy', 3, 2, 8, 1, 2, 1),
  ('medium', 4, 3, 7, 2, 4, 2), ('hard', 5, 4, 6, 3, 6, 4)) AS t(difficulty, n_users, n_layers,
  budget, n_secrets, n_decoys, n_deadends)) k ON k.m = c_custkey % 3"""
_U = ("scenario_id", "ord")
GEN_USERS = f"""SELECT scenario_id, difficulty, ord, username, username || '.'
    || {pick(['dev', 'ops', 'sec'], num('team', *_U) + ' % 3')} || '@'
    || {pick(dims.DOMAINS, num('domain', *_U) + f' % {len(dims.DOMAINS)}')} AS email,
  CASE WHEN {num('n-ips', *_U)} % 2 = 1 THEN [{ip_sql(*_U, '0')}, {ip_sql(*_U, '1')}]
    ELSE [{ip_sql(*_U, '0')}] END AS ips,
  [{', '.join(pick(dims.SERVICES, f"({num('service', *_U)} + {k * 5}) % 11") for k in range(3))}]
    [1:{num('n-services', *_U)} % 3 + 1] AS services
  FROM (SELECT s.*, o.ord, {pick(dims.NAMES, f"({num('name', 's.scenario_id')} + o.ord * 7) % 32")}
    AS username FROM seeds s JOIN (SELECT unnest(range(0, 5)) AS ord) o ON o.ord < s.n_users)"""
_S = ("scenario_id", "k")
GEN_SECRETS = f"""SELECT p.scenario_id, 'secret_' || p.k AS secret_id, p.k,
  {token_sql('p.token_type', 'p.scenario_id', 'p.k')} AS token, p.token_type, u.username AS owner,
  u.services[CAST({num('owner-service', 'p.scenario_id', 'p.k')} % len(u.services) AS INT) + 1]
    AS service
  FROM (SELECT s.scenario_id, o.k, {num('owner', 's.scenario_id', 'o.k')} % s.n_users AS ord,
    {pick([t[0] for t in dims.TOKEN_KINDS], f"({num('kind', 's.scenario_id')} + o.k * 3) % 7")}
      AS token_type
    FROM seeds s JOIN (SELECT unnest(range(0, 3)) AS k) o ON o.k < s.n_secrets) p
  JOIN gen_users u ON u.scenario_id = p.scenario_id AND u.ord = p.ord"""
GEN_LAYERS = """SELECT s.scenario_id, s.difficulty, l.layer, l.layer = 0 AS has_surface,
  l.layer >= 1 AND l.layer >= s.n_layers - 2 AS has_tokens
  FROM seeds s JOIN (SELECT unnest(range(0, 4)) AS layer) l ON l.layer < s.n_layers"""
EXTRA = {"seeds": SEEDS, "gen_users": GEN_USERS, "gen_secrets": GEN_SECRETS,
         "gen_layers": GEN_LAYERS}


def fill(templates, which):
    """SQL for the chosen template and for its labels as sorted text."""
    lines, marks = [], []
    for i, template in enumerate(templates):
        text, _, names = template.rpartition("|")
        parts = []
        for literal, field, _, _ in Formatter().parse(text):
            if literal:
                parts.append("'" + literal.replace("'", "''") + "'")
            if field:
                parts.append(field)
        lines.append(f"WHEN {i} THEN {' || '.join(parts)}")
        tags = " || ',' || ".join(f"'{n}=' || {n}" for n in sorted(names.split(",")) if n)
        marks.append(f"WHEN {i} THEN {tags or repr('')}")
    return f"CASE {which} {' '.join(lines)} END", f"CASE {which} {' '.join(marks)} END"


def _person(tag, source, ids, templates, kind):
    q = [f"'{tag}'", *ids]
    line, marks = fill(templates, f"{num(kind, *ids)} % {len(templates)}")
    return f"""SELECT scenario_id, layer, '{kind}' AS kind, item, {line} AS line, {marks} AS labels
      FROM (SELECT *, {stamp_sql(*q)} AS ts, substr({stamp_sql(*q)}, 12, 8) AS clock,
        ips[CAST({num(tag + '-ip', *ids)} % len(ips) AS INT) + 1] AS ip,
        services[CAST({num(tag + '-service', *ids)} % len(services) AS INT) + 1] AS service,
        upper(username[1]) || username[2:] AS title FROM ({source}))"""


SURFACE_SQL = _person(
    "surface", f"""SELECT p.scenario_id, 0 AS layer, p.item, u.username, u.email, u.ips, u.services
      FROM (SELECT s.scenario_id, o.item, CASE WHEN o.item < 2 THEN o.item ELSE
        {num('surface-user', 's.scenario_id', 'o.item')} % s.n_users END AS ord
        FROM seeds s JOIN (SELECT unnest(range(0, 4)) AS item) o
        ON o.item < {num('n-more', 's.scenario_id')} % 2 + 3) p
      JOIN gen_users u ON u.scenario_id = p.scenario_id AND u.ord = p.ord""",
    ["scenario_id", "item"], synth.SURFACE, "surface")
LINKED_SQL = " UNION ALL ".join(
    _person(kind, f"""SELECT * FROM (SELECT l.scenario_id, l.layer, u.ord AS item, u.username,
        u.email, u.ips, u.services FROM gen_layers l JOIN gen_users u
        ON u.scenario_id = l.scenario_id WHERE l.layer > 0)
      WHERE {num(kind + '-keep', 'scenario_id', 'layer', 'item')} % 100 < {share}""",
            ["scenario_id", "layer", "item"], templates, kind)
    for kind, templates, share in [("user_linked", synth.USER_LINKED, 70),
                                   ("ip_linked", synth.IP_LINKED, 50)])
_I3 = ("scenario_id", "layer", "item")
_TOKEN_FILL = fill(synth.TOKEN_LINKED, f"{num('token-line', *_I3)} % {len(synth.TOKEN_LINKED)}")
TOKEN_SQL = f"""SELECT scenario_id, layer, 'token_linked' AS kind, item, {_TOKEN_FILL[0]} AS line,
  {_TOKEN_FILL[1]} AS labels FROM (SELECT *, {stamp_sql("'token'", *_I3)} AS ts,
    'sk_l**e_' || right(token, 8) AS masked, base64(encode('token=' || token)) AS blob
    FROM (SELECT l.scenario_id, l.layer, s.k AS item, s.token, s.token_type, s.service
      FROM gen_layers l JOIN gen_secrets s ON s.scenario_id = l.scenario_id WHERE l.has_tokens))"""
_I2 = ("scenario_id", "item")
FAKES = f"""SELECT *, {pick(synth.FAKE_HEADS, num('fake-head', *_I2) + ' % 3')}
    || substr(md5(concat_ws(':', '0', 'fake-token', scenario_id, item)), 1, 20) AS fake_token,
  CASE {num('fake-phone', *_I2)} % 3
    WHEN 0 THEN 'ext. ' || {digits('fake-phone-digits', 4, *_I2)}
    WHEN 1 THEN '+49-30-' || {digits('fake-phone-digits', 4, *_I2)}
    ELSE '+1-555-' || substr({digits('fake-phone-digits', 4, *_I2)}, 1, 2) END AS fake_phone
  FROM (SELECT s.scenario_id, o.item FROM seeds s JOIN (SELECT unnest(range(0, 6)) AS item) o
    ON o.item < s.n_decoys)"""
_NOISE_FILL = fill(synth.NOISE, f"{num('noise', *_I2)} % {len(synth.NOISE)}")
_DECOYS = ", ".join(
    f"{pick(v, num('decoy-' + k, *_I2) + f' % {len(v)}')} AS decoy_{k}"
    for k, v in dims.DECOY_VALUES.items())
NOISE_SQL = f"""SELECT scenario_id, 0 AS layer, 'noise' AS kind, item, {_NOISE_FILL[0]} AS line,
  '' AS labels FROM (SELECT *, {_DECOYS}, {stamp_sql("'noise'", *_I2)} AS ts,
    base64(encode('mock_secret=abcd1234')) AS fake_blob FROM fakes)"""
EXTRA["fakes"] = FAKES


def _flat(df):
    tags = F.array_sort(F.transform("labels", lambda r: F.concat(
        r["pii_type"], F.lit("="), r["value"])))
    return df.withColumn("labels", F.concat_ws(",", tags))


add(
    "n1_gen_users",
    lambda spark, folder: _users(spark, folder).withColumns(
        {"ips": F.concat_ws(",", "ips"), "services": F.concat_ws(",", "services")}),
    """SELECT scenario_id, difficulty, ord, username, email, array_to_string(ips, ',') AS ips,
      array_to_string(services, ',') AS services FROM gen_users""", **EXTRA)
add(
    "n2_gen_ip",
    lambda spark, folder: table(spark, folder, "customer").select(
        "c_custkey", synth.gen_ip("c_custkey").alias("ip")),
    f"SELECT c_custkey, {ip_sql('c_custkey')} AS ip FROM customer")
add(
    "n3_gen_token",
    lambda spark, folder: table(spark, folder, "customer").select(
        "c_custkey", F.explode(F.array(*[F.lit(t[0]) for t in dims.TOKEN_KINDS])).alias("kind")
    ).withColumn("token", synth.gen_token(c("kind"), "c_custkey")),
    f"""SELECT c_custkey, kind, {token_sql('kind', 'c_custkey')} AS token FROM customer,
      (SELECT unnest({listing(t[0] for t in dims.TOKEN_KINDS)}) AS kind)""")
add(
    "n4_gen_phone",
    lambda spark, folder: table(spark, folder, "customer").select(
        "c_custkey", synth.gen_phone("c_custkey").alias("phone")),
    f"SELECT c_custkey, {phone_sql('c_custkey')} AS phone FROM customer")
add(
    "n5_gen_secrets",
    lambda spark, folder: synth.gen_secrets(_seeds(spark, folder), _users(spark, folder)),
    "SELECT * FROM gen_secrets", **EXTRA)
add(
    "n6_gen_surface",
    lambda spark, folder: _flat(synth.gen_surface(_seeds(spark, folder), _users(spark, folder))),
    SURFACE_SQL, **EXTRA)
add(
    "n7_gen_linked",
    lambda spark, folder: _flat(synth.gen_linked(
        synth.gen_layers(_seeds(spark, folder)), _users(spark, folder))),
    LINKED_SQL, **EXTRA)
add(
    "n8_gen_token_lines",
    lambda spark, folder: _flat(synth.gen_token_lines(
        synth.gen_layers(_seeds(spark, folder)),
        synth.gen_secrets(_seeds(spark, folder), _users(spark, folder)))),
    TOKEN_SQL, **EXTRA)
add("n9_gen_noise", lambda spark, folder: _flat(synth.gen_noise(_seeds(spark, folder))),
    NOISE_SQL, **EXTRA)
add(
    "n10_gen_decoy",
    lambda spark, folder: _seeds(spark, folder).select(
        "scenario_id", F.explode(F.sequence(F.lit(0), c("n_decoys") - 1)).alias("item")
    ).withColumns(synth.gen_decoy("scenario_id", "item")),
    "SELECT * FROM fakes", **EXTRA)
add("n11_gen_layers", lambda spark, folder: synth.gen_layers(_seeds(spark, folder)),
    "SELECT * FROM gen_layers", **EXTRA)
add(
    "n12_gen_ts",
    lambda spark, folder: table(spark, folder, "customer").select(
        "c_custkey", F.date_format(synth.gen_ts("c_custkey"), "yyyy-MM-dd HH:mm:ss").alias("ts")),
    f"SELECT c_custkey, {stamp_sql('c_custkey')} AS ts FROM customer")
add(
    "n11_gen_logs_by_layer",
    lambda spark, folder: synth.gen_logs(_seeds(spark, folder)).groupBy("layer", "kind").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.size("labels")).alias("labels")),
    f"""SELECT layer, kind, count(*) AS lines, CAST(sum(CASE WHEN labels = '' THEN 0 ELSE
      len(string_split(labels, ',')) END) AS BIGINT) AS labels FROM ({SURFACE_SQL} UNION ALL
      {LINKED_SQL} UNION ALL {TOKEN_SQL} UNION ALL {NOISE_SQL}) GROUP BY layer, kind""", **EXTRA)
