"""Replay against the step-by-step model on random episodes, and under skew."""

import pytest
from pyspark.sql import functions as F

from piitrace.plans import policy
from piitrace.plans.replay import Replay, number_steps
from tests.model import Episode, Scene
from tests.scenes import frames, make

COLUMNS = ["episode_id", "step", "reward", "cumulative_reward", "visible_total",
           "discovered_total", "redacted_total"]


def replayed(tables):
    rows = Replay(**tables).step_results.select(*COLUMNS).collect()
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_random_episodes_match_the_model(spark, seed):
    tables, plays = make(seed)
    got = replayed(frames(spark, tables))
    assert got == {e: rows for e, rows in plays.items() if rows}


def test_input_order_and_partitions_do_not_matter(spark):
    tables, _ = make(3, scenarios=6)
    plain = frames(spark, tables)
    mixed = {n: df.orderBy(F.rand(7)).repartition(5) for n, df in plain.items()}
    assert replayed(plain) == replayed(mixed)


def test_hot_scenario(spark):
    """One scenario with a third of all lines and episodes gives the same results."""
    tables, plays = make(4, scenarios=6)
    hot = [r for r in tables["logs"] if r[0] == 0]
    extra = [(0, 100_000 + k * 100 + i, layer, "copy", labels)
             for k in range(200) for i, (_, _, layer, _, labels) in enumerate(hot)]
    got = replayed(frames(spark, {**tables, "logs": tables["logs"] + extra}))
    for e, rows in plays.items():
        want = rows if e >= 5 else [(s, r, t, v * 201, d, x) for s, r, t, v, d, x in rows]
        assert got.get(e, []) == want


def odd_step(episode, step):
    """Another way to write step numbers down, by episode."""
    return {0: step, 1: (step - 1) * 3, 2: 1_700_000_000 + 60 * step}[episode % 3]


def test_recorded_steps_may_have_gaps(spark):
    tables, plays = make(8)
    other = dict(
        tables,
        actions=[(e, s, k, odd_step(e, n), a, t) for e, s, k, n, a, t in tables["actions"]],
        redactions=[(e, odd_step(e, n), p, v, t) for e, n, p, v, t in tables["redactions"]])
    assert any(n > 8 for rows in plays.values() for n, *_ in rows)
    got = replayed(frames(spark, other))
    assert got == {e: rows for e, rows in plays.items() if rows}


def test_read_actions_with_rejects_replays(spark, tmp_path):
    """Rejected records leave gaps; the rest is numbered anew and keeps its items."""
    import json

    from piitrace.sources import readers

    tables, _ = make(9, scenarios=4)
    items = {}
    for e, n, p, v, t in tables["redactions"]:
        items.setdefault((e, n), []).append({"original": v, "type": t})
    lines, kept = [], {}
    for i, (e, s, k, n, a, t) in enumerate(tables["actions"]):
        record = {"episode_id": e, "scenario_id": s, "strategy": k, "step": n, "action_type": a,
                  "target_entity": t, "redactions": items.get((e, n))}
        if i % 6 == 5:
            record["action_type"] = "dance"
        else:
            kept.setdefault((e, s), []).append((a, t, [x["original"] for x in items.get((e, n), [])]))
        lines.append((json.dumps(record),))
    spark.createDataFrame(lines, "value STRING").write.text(str(tmp_path / "a"))
    actions, reds, rejects = readers.read_actions(spark, str(tmp_path / "a"))
    assert rejects.count() == len(lines) // 6
    f = frames(spark, tables) | {"actions": actions, "redactions": reds}
    got = {}
    for r in sorted(Replay(**f).step_results.select("episode_id", "step", "reward").collect()):
        got.setdefault(r[0], []).append(r[2])
    scenes = scenes_of(tables)
    for (e, s), plan in kept.items():
        model = Episode(scenes[s])
        want = [x for x in (model.play(*p) for p in plan) if x is not None]
        assert got[e] == want


def test_number_steps(spark):
    step = {0: lambda s: s * 3, 1: lambda s: 1_600_000_000 + 997 * s, 2: lambda s: -s}
    rows = [(e, 0, 0, step[e](s), "scan", None) for e in range(3) for s in range(50)]
    df = spark.createDataFrame(rows, "episode_id BIGINT, scenario_id BIGINT, strategy INT, "
                                     "step INT, action_type STRING, target_entity STRING")
    got = {(r.episode_id, r.step): r.step_no for r in number_steps(df.repartition(4)).collect()}
    for e in range(3):
        ordered = sorted(step[e](s) for s in range(50))
        assert [got[e, s] for s in ordered] == list(range(1, 51))


def test_reachable_follows_a_long_chain(spark):
    logs = [(0, 0, 0, "x", [("username", "a0")])] + [
        (0, k, 1, "x", [("username", f"a{k - 1}"), ("username", f"a{k}")]) for k in range(1, 31)]
    f = frames(spark, dict(logs=logs, edges=[(0, "a30", "a0")]))
    got = {r.value: r.reached for r in policy.reachable(f["logs"], f["edges"]).collect()}
    assert got == {f"a{k}": k for k in range(31)}
    short = policy.reachable(f["logs"], f["edges"], rounds=3).collect()
    assert {r.value for r in short} == {"a0", "a1", "a2", "a3"}


def scenes_of(tables):
    out = {}
    for sid, _, _, budget in tables["scenarios"]:
        lines = [(r[2], [v for _, v in r[4]]) for r in tables["logs"] if r[0] == sid]
        links = {}
        for s, a, b in tables["edges"]:
            if s == sid:
                links.setdefault(a, set()).add(b)
        truth = {v: t for s, t, v in tables["truth"] if s == sid}
        traps = {v for s, v in tables["honeypots"] if s == sid}
        out[sid] = Scene(lines, links, truth, traps, budget)
    return out


def test_driver_rules_match_the_model(spark):
    tables, _ = make(6, scenarios=10)
    f = frames(spark, tables)
    out = policy.apply_driver_rules(f["actions"], f["scenarios"], f["logs"], f["edges"],
                                    f["honeypots"])
    got = {}
    for r in out.orderBy("episode_id", "step").collect():
        got.setdefault(r.episode_id, []).append((r.action_type, r.target_entity))
    plans = {}
    for e, sid, _, step, act, target in sorted(tables["actions"], key=lambda r: (r[0], r[3])):
        plans.setdefault((e, sid), []).append((act, target))
    scenes = scenes_of(tables)
    for (e, sid), plan in plans.items():
        model, want = Episode(scenes[sid]), []
        for n, (act, target) in enumerate(plan, 1):
            if model.over:
                break
            if n == 1:
                act = "scan"
            elif scenes[sid].budget - len(model.played) <= 1:
                act = "submit"
            elif act == "investigate" and (not target or target not in model.targets()):
                act = "scan"
            target = target if act == "investigate" else None
            model.play(act, target)
            want.append((act, target))
        assert got[e] == want, e


def test_reachable_matches_search(spark):
    tables, _ = make(7, scenarios=10, per=1)
    f = frames(spark, tables)
    got = {(r[0], r[1]): r[2] for r in policy.reachable(f["logs"], f["edges"]).collect()}
    want = {}
    for sid, scene in scenes_of(tables).items():
        known = {v for layer, vs in scene.lines if layer == 0 for v in vs}
        want.update({(sid, v): 0 for v in known})
        for k in range(1, 9):
            hit = set()
            for v in known:
                wanted = {v} | scene.links.get(v, set())
                hit |= {x for layer, vs in scene.lines if layer > 0 and wanted & set(vs)
                        for x in vs}
            want.update({(sid, v): k for v in hit - known})
            known |= hit
    assert got == want
