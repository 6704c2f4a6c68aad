"""Extraction queries (E)."""

from pyspark.sql import functions as F

from piitrace.functions.patterns import BLOB_SECRET, PATTERNS, TOKEN_PATTERNS
from piitrace.operators import extract as X
from piitrace.operators.dictionary import mask_dictionary
from piitrace.registry.base import add, corpus, incident, on_incident, table
from piitrace.registry.oracle import hits, lit
from piitrace.sources import dims

c = F.col
ID = ("src", "id")
SHOW = ["src", "id", "pattern_id", "match_ord", "pii_type", "value"]

NAMES = {
    "E1": "email", "E2": "ipv4", "E3": "quoted_user", "E4": "key_value_user", "E5": "phone_us",
    "E6": "phone_india", "E7": "phone_london", "E8": "phone_555", "E9": "phone_generic",
    "E10": "base64_blob", "E11": "decoded_secret", "E12": "stripe_key", "E13": "github_token",
    "E14": "hf_token", "E15": "aws_access_key", "E16": "aws_session_key", "E17": "jwt",
    "E18": "api_key", "E19": "slack_token", "E20": "assigned_secret", "E21": "hex32",
    "E22": "hex40",
}


def _pattern(pid, profile):
    return lambda spark, folder: X.extract(
        corpus(spark, folder), pid, "text", ID, profile
    ).select(*SHOW)


for _pid, _name in NAMES.items():
    for _profile in ("demo", "server") if _pid in ("E2", "E11") else ("demo",):
        _suffix = "_server" if _profile == "server" else ""
        add(
            f"{_pid.lower()}_{_name}{_suffix}", _pattern(_pid, _profile),
            f"SELECT {', '.join(SHOW)} FROM ({hits(_pid, 0, 'corpus', 'src, id', 'text', _profile)})",
        )

add(
    "e11_decoded_secret_repaired",
    lambda spark, folder: X.extract(
        corpus(spark, folder), "E11", "text", ID, strict_padding=False).select(*SHOW),
    f"SELECT {', '.join(SHOW)} FROM ({hits('E11', 0, 'corpus', 'src, id', 'text', 'demo', False)})",
)
add(
    "e23_token_patterns",
    lambda spark, folder: X.extract_tokens(corpus(spark, folder), "text", ID).select(*SHOW),
    "SELECT " + ", ".join(SHOW) + " FROM (" + " UNION ALL ".join(
        hits(p, 0, "corpus", "src, id", "text", "demo") for p in TOKEN_PATTERNS) + ")",
)

FOUND = ["scenario_id", "value", "log_id", "pattern_id", "pii_type"]


def _demo(i):
    return X.all_matches(i.logs, "line", ("scenario_id", "log_id"), "demo")


on_incident(
    "e24_first_seen",
    lambda i: X.first_seen(_demo(i), ("scenario_id",), "log_id").select(*FOUND),
    f"SELECT {', '.join(FOUND)} FROM demo_found",
)
for _profile in ("demo", "server"):
    on_incident(
        f"e25_extract_logs_{_profile}",
        lambda i, p=_profile: X.extract_pii(i.logs, profile=p).select(*FOUND),
        f"SELECT {', '.join(FOUND)} FROM {_profile}_found",
    )
add(
    "e25_extract_documents",
    lambda spark, folder: X.extract_pii(
        table(spark, folder, "documents"), "text", ("doc_id",), None, "demo"
    ).select("doc_id", "value", "pattern_id", "pii_type"),
    """SELECT doc_id, value, pattern_id, pii_type FROM (SELECT *, row_number() OVER (
      PARTITION BY doc_id, value ORDER BY pattern_ord, match_ord) AS rn FROM demo_doc_hits)
      WHERE rn = 1""",
)


def _merge(rule):
    def build(i):
        found = X.extract_pii(i.logs, profile="server")
        return X.merge_discovered(found, i.log_pii, ("scenario_id",), rule)

    return build


_SERVER_CLASS = r"""CASE WHEN contains(value, '@') THEN 'email'
  WHEN regexp_matches(value, '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') THEN 'ip'
  WHEN regexp_matches(value, '^\+[0-9]{1,3}-[0-9]{3}-[0-9]{3}-[0-9]{4}$') THEN 'phone'
  WHEN length(value) > 15 THEN 'token' ELSE 'username' END"""
for _rule, _kind in [("unknown", "'unknown'"), ("server", _SERVER_CLASS)]:
    on_incident(
        f"e26_merge_discovered_{_rule}", _merge(_rule),
        f"""SELECT scenario_id, value, pii_type FROM server_found UNION ALL
        SELECT scenario_id, value, {_kind} AS pii_type FROM (
          SELECT DISTINCT scenario_id, value FROM log_pii EXCEPT
          SELECT scenario_id, value FROM server_found)""",
    )

on_incident(
    "e27_drop_decoys",
    lambda i: X.drop_decoys(_demo(i), dims.decoys(i.spark)).select(
        "log_id", "pattern_id", "match_ord", "pii_type", "value"),
    """SELECT log_id, pattern_id, match_ord, pii_type, value FROM demo_hits h WHERE NOT EXISTS (
      SELECT 1 FROM decoys d WHERE d.pii_type = h.pii_type AND d.value = h.value)""",
)
on_incident(
    "e28_decoy_hits",
    lambda i: X.decoy_hits(_demo(i), i.log_pii),
    """SELECT pattern_id, count(*) AS hits, count(*) FILTER (bad) AS unlabelled,
      count(*) FILTER (bad) / CAST(count(*) AS DOUBLE) AS false_positive_rate FROM (
        SELECT h.pattern_id, NOT EXISTS (SELECT 1 FROM log_pii p WHERE p.log_id = h.log_id
          AND p.value = h.value) AS bad FROM demo_hits h) GROUP BY ALL""",
)
on_incident(
    "e29_extractor_quality",
    lambda i: X.extractor_quality(_demo(i), i.log_pii),
    """SELECT coalesce(f.pattern_id, 'none') AS pattern_id,
        coalesce(l.pii_type, f.pii_type) AS pii_type,
        count(*) FILTER (f.pattern_id IS NOT NULL AND l.pii_type IS NOT NULL) AS tp,
        count(*) FILTER (f.pattern_id IS NOT NULL AND l.pii_type IS NULL) AS fp,
        count(*) FILTER (f.pattern_id IS NULL) AS fn
      FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id, value
          ORDER BY pattern_ord, match_ord) AS rn FROM demo_hits) WHERE rn = 1) f
      FULL JOIN (SELECT log_id, value, min(pii_type) AS pii_type FROM log_pii GROUP BY ALL) l
        ON l.log_id = f.log_id AND l.value = f.value GROUP BY ALL""",
)


#: What becomes of each pattern's matches, in order; written out apart from the engine's own list.
_PHONES = {"demo": ["E5", "E6", "E7", "E8"], "server": ["E9"]}
_STAY = {"demo": ["255.255.255.255", "0.0.0.0", "127.0.0.1"], "server": ["255.255.255.255"]}
_WORD = r"(?:key|token|secret|credential|password|pwd|auth)"


def _mask_sql(column, profile):
    swap = lambda text, regex, put: f"regexp_replace({text}, {lit(regex)}, {lit(put)}, 'g')"
    out = swap(column, PATTERNS["E1"].regex, "[EMAIL]")
    for ip in _STAY[profile]:
        out = swap(out, r"(^\.?|[^0-9.\w]|[^0-9]\.)" + ip.replace(".", r"\.") + r"\b",
                   "\\1" + ip.replace(".", "\ue0f0"))
    out = swap(out, PATTERNS["E2"].regex, "[IP]")
    out = f"replace({out}, '\ue0f0', '.')"
    out = swap(out, r"(?i)(User\s*['\"])[A-Za-z][A-Za-z0-9_-]*(['\"])", r"\1[USERNAME]\2")
    out = swap(out, r"(?i)(user=)[A-Za-z][A-Za-z0-9_-]+", r"\1[USERNAME]")
    for pid in _PHONES[profile]:
        out = swap(out, PATTERNS[pid].regex, "[PHONE]")
    blobs = f"regexp_extract_all({column}, {lit(PATTERNS['E10'].regex)}, 1)"
    secret = f"""len(list_filter(coalesce(regexp_extract_all(try(decode(from_base64(
      CASE WHEN length(b) % 4 = 0 THEN b END))), {lit(BLOB_SECRET[profile])}, 1), []),
      lambda v: length(v) >= 6)) > 0"""
    out = f"""list_reduce(list_prepend({out}, list_reverse_sort(list_filter(list_distinct({blobs}),
      lambda b: {secret}))), lambda t, b: replace(t, b, '[TOKEN]'))"""
    for pid in ["E12", "E13", "E14", "E15", "E16", "E17", "E18", "E19"]:
        out = swap(out, PATTERNS[pid].regex, "[TOKEN]")
    out = swap(out, r"(?i)(" + _WORD + r"\s*[:=]\s*[\"']?)[a-zA-Z0-9._%+-]{12,}", r"\1[TOKEN]")
    for pid in ["E21", "E22"]:
        out = swap(out, PATTERNS[pid].regex, "[TOKEN]")
    return out


for _profile in ("demo", "server"):
    add(
        f"e30_mask_text_{_profile}",
        lambda spark, folder, p=_profile: X.mask_text(corpus(spark, folder), "text", p).select(
            "src", "id", "masked"),
        f"SELECT src, id, {_mask_sql('text', _profile)} AS masked FROM corpus",
    )
on_incident(
    "e30_mask_known",
    lambda i: X.mask_known(i.logs).select("log_id", "masked"),
    """SELECT l.log_id, coalesce(list_reduce(k.items, lambda acc, r:
        {'t': replace(acc.t, r.v, r.t), 'v': ''}, {'t': l.line, 'v': ''}).t, l.line) AS masked
      FROM logs l LEFT JOIN (SELECT log_id,
        list({'t': '[' || upper(pii_type) || ']', 'v': value} ORDER BY length(value) DESC, value)
          AS items FROM (SELECT DISTINCT * FROM log_pii) GROUP BY ALL) k USING (log_id)""",
)

#: Every value of every scenario, whatever line it was planted in.
_DICTIONARY_SQL = """SELECT c.src, c.id, coalesce(list_reduce(k.items, lambda acc, r:
    {'t': replace(acc.t, r.v, r.t), 'v': ''}, {'t': c.text, 'v': ''}).t, c.text) AS masked
  FROM corpus c LEFT JOIN (
    SELECT src, id, list({'t': '[' || upper(kind) || ']', 'v': value} ORDER BY length(value) DESC, value) AS items
    FROM corpus JOIN (SELECT value, min(pii_type) AS kind FROM log_pii GROUP BY ALL) ON contains(text, value)
    GROUP BY ALL) k ON k.src = c.src AND k.id = c.id"""


def _dictionary(**bounds):
    def build(spark, folder):
        texts = corpus(spark, folder).withColumn("row", F.concat_ws(":", "src", "id"))
        values = incident(spark, folder).log_pii
        return mask_dictionary(texts, values, "row", "text", **bounds).select("src", "id", "masked")

    return build


add("e30_mask_dictionary", _dictionary(), _DICTIONARY_SQL)
add("e30_mask_dictionary_joined", _dictionary(automaton_values=0), _DICTIONARY_SQL)

_RATES = """SELECT {by}, count(DISTINCT doc_id) AS docs,
  count(DISTINCT CASE WHEN value IS NOT NULL THEN doc_id END) AS docs_with_pii,
  count(value) AS hits, count(DISTINCT value) AS distinct_values
  FROM ({source}) GROUP BY ROLLUP ({by})"""


def _sketched(spark, folder):
    """Estimates beside the exact numbers they have to be near."""
    docs = table(spark, folder, "documents")
    exact = X.pii_rates(docs).select("source", "lang", c("distinct_values").alias("exact"))
    rates = X.sketched_rates(X.pii_sketches(docs))
    on = [rates[x].eqNullSafe(exact[x]) for x in ("source", "lang")]
    near = F.abs(c("distinct_values") - c("exact")) <= F.ceil(c("exact") * X.SKETCH_ERROR)
    return rates.join(exact, on).select(rates["source"], rates["lang"], "docs", "docs_with_pii", "hits",
                                        near.alias("near"))


add("e31_pii_rates_sketched", _sketched,
    f"""SELECT source, lang, docs, docs_with_pii, hits, true AS near FROM ({_RATES.format(
        by="source, lang", source="""SELECT d.doc_id, d.source, d.lang, h.value
      FROM documents d LEFT JOIN demo_doc_hits h USING (doc_id)""")})""")
add(
    "e31_pii_rates",
    lambda spark, folder: X.pii_rates(table(spark, folder, "documents")),
    _RATES.format(by="source, lang", source="""SELECT d.doc_id, d.source, d.lang, h.value
      FROM documents d LEFT JOIN demo_doc_hits h USING (doc_id)"""),
)
add(
    "e31_pii_rates_by_label",
    lambda spark, folder: X.pii_rates(
        table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id"),
        ("quality", "toxic"),
    ),
    _RATES.format(by="quality, toxic", source="""SELECT d.doc_id, l.quality, l.toxic, h.value
      FROM documents d JOIN labels l USING (doc_id) LEFT JOIN demo_doc_hits h USING (doc_id)"""),
)
add(
    "e31_pii_by_type",
    lambda spark, folder: X.all_matches(
        table(spark, folder, "documents"), "text", ("doc_id",), "demo"
    ).groupBy("pii_type").agg(F.count(F.lit(1)).alias("hits"),
                              F.count_distinct("value").alias("distinct_values")),
    """SELECT pii_type, count(*) AS hits, count(DISTINCT value) AS distinct_values
      FROM demo_doc_hits GROUP BY ALL""",
)
