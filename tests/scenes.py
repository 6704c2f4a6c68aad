"""Random scenes and plans as DataFrames, with their step-by-step models."""

import random

from piitrace import schemas
from tests.model import Episode, Scene, hold

LIVE = ("scenario_id BIGINT, difficulty STRING, n_layers INT, budget INT")
ITEMS = ("episode_id BIGINT, step INT, pos INT, original STRING, type STRING")


def make(seed, scenarios=12, per=5):
    rng = random.Random(seed)
    logs, edges, truth, traps, facts, actions, items, plays = [], [], [], [], [], [], [], []
    for sid in range(scenarios):
        values = [f"v{i}" for i in range(rng.randint(4, 9))]
        kinds = {v: rng.choice(["email", "token", "username"]) for v in values
                 if rng.random() < 0.8} or {"v0": "email"}
        layers, budget = rng.randint(2, 4), rng.choice([3, 5, 6, 7, 8, 10, 25])
        lines = []
        for n in range(rng.randint(4, 14)):
            layer = rng.randrange(layers)
            lines.append((layer, rng.sample(values, rng.randint(0, 3))))
        links = {}
        for _ in range(rng.randint(2, 8)):
            a, b = rng.sample(values, 2)
            links.setdefault(a, set()).add(b)
        bad = {rng.choice(values), "admin"} if rng.random() < 0.5 else {"admin"}
        scene = Scene(lines, links, kinds, bad, budget)
        facts.append((sid, "easy", layers, budget))
        for i, (layer, vs) in enumerate(lines):
            logs.append((sid, sid * 1000 + i, layer, f"line {i}",
                         [(kinds.get(v, "username"), v) for v in vs]))
        edges += [(sid, a, b) for a, bs in links.items() for b in bs]
        truth += [(sid, t, v) for v, t in kinds.items()]
        traps += [(sid, v) for v in bad]
        for k in range(per):
            eid, model, rows, total = sid * per + k, Episode(scene), [], 0.05
            for step in range(1, rng.randint(2, 15)):
                act = rng.choice(["scan", "investigate", "redact"] * 4 + ["submit"]
                                 if step > 2 else ["scan", "investigate", "redact"])
                target, listed = None, []
                if act == "investigate":
                    target = rng.choice([*values, "admin", "nobody", None, ""])
                if act == "redact":
                    listed = [rng.choice([*values, "wrong", "other"])
                              for _ in range(rng.randint(0, 6))]
                    items += [(eid, step, p, v, "x") for p, v in enumerate(listed)]
                actions.append((eid, sid, k, step, act, target))
                reward = model.play(act, target, listed)
                if reward is not None:
                    total = hold(total + reward)
                    rows.append((step, reward, total, len(model.opened_at), len(model.known_at),
                                 len(model.removed_at)))
            plays.append((eid, rows))
    return dict(logs=logs, edges=edges, truth=truth, honeypots=traps, scenarios=facts,
                actions=actions, redactions=items), dict(plays)


def frames(spark, tables):
    kinds = {"logs": schemas.LOGS, "edges": schemas.EDGES, "truth": schemas.TRUTH,
             "honeypots": schemas.HONEYPOTS, "actions": schemas.ACTIONS, "scenarios": LIVE,
             "redactions": ITEMS}
    return {name: spark.createDataFrame(rows, kinds[name]) for name, rows in tables.items()}
