"""What the episode scorers are handed: few rows and few cells, however many values an action brings."""

from piitrace import schemas
from piitrace.registry import base
from piitrace.sources.incident import Incident
from piitrace.streaming import online
from tests.scenes import LIVE
from tests.test_scorer_state import Clock, Store

N = 600


def scene(spark):
    """A scenario with N surface values, N hidden ones that ``s0`` leads to, and N of both that are true."""
    lines = [(1, i, 0, f"line {i}", [("email", f"s{i}")]) for i in range(N)]
    lines += [(1, N + i, 1, f"line {N + i}", [("token", f"h{i}")]) for i in range(N)]
    edges = [(1, "s0", f"h{i}") for i in range(N)]
    truth = [(1, "email", f"s{i}") for i in range(N // 2)] + [(1, "token", f"h{i}") for i in range(N // 2)]
    make = spark.createDataFrame
    logs, truth = make(lines, schemas.LOGS), make(truth, schemas.TRUTH)
    return (online.effects(logs, make(edges, schemas.EDGES), truth, make([(1, "admin")], schemas.HONEYPOTS)),
            online.scenario_facts(make([(1, "easy", 2, 9)], LIVE), logs, truth))


def test_rows_do_not_grow_with_the_values(spark):
    items = [(f"s{i}", "email") for i in range(N)] + [("s0", "email"), ("h0", "token"), (None, "token")]
    records = [(1, 1, 0, 1, "scan", None, None), (1, 1, 0, 2, "investigate", "s0", None),
               (1, 1, 0, 3, "redact", None, items), (1, 1, 0, 4, "redact", None, []),
               (1, 1, 0, 5, "investigate", "admin", None), (1, 1, 0, 6, "investigate", "nobody", None)]
    keyed = online.keyed_actions(spark.createDataFrame(records, schemas.ACTION_RECORD), *scene(spark))
    rows = keyed.collect()
    assert len(keyed.columns) == 4 and len(rows) <= 6 + 3 * -(-N // online.PACK) + 4
    scorer = online.EpisodeScorer()
    scorer.init(Store())
    got = list(scorer.handleInputRows((1,), iter(rows), Clock(0)))
    assert [(r.step, r.visible_total, r.discovered_total, r.redacted_total) for r in got] == [
        (1, N, N, 0), (2, 2 * N, 2 * N, 0), (3, 2 * N, 2 * N, N // 2 + 1), (4, 2 * N, 2 * N, N // 2 + 1),
        (5, 2 * N, 2 * N, N // 2 + 1), (6, 2 * N, 2 * N, N // 2 + 1)]
    assert got[4].reward == -0.5 and scorer.head.value[online.EpisodeScorer.names.index("true")] == N


def test_a_stream_query_builds_only_the_tables_it_reads(spark, folder):
    base.forget()
    assert "logs" not in vars(base.incident(spark, folder))


def test_labels_are_those_of_the_logs(spark, folder):
    i = Incident.load(spark, folder)
    key = lambda df: sorted(map(str, df.select("scenario_id", "layer", "labels").collect()))
    assert key(i.labels) == key(i.logs)
