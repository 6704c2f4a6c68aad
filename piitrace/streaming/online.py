"""Online scoring: one result row per recorded action, as the actions arrive.

What an action can bring (values on the surface, line classes a target reveals,
truth flags of a redaction item, honeypots) does not depend on the episode, so it
is joined from static tables. The state of an episode keeps only what has already
counted: numbers, a list of marked values and classes, and early steps, all on disk.
Every call to the state store costs a round trip, so a batch reads the numbers of an
episode once, the list at most once, and writes what is new in one go at its end.
Spark hands rows to the state one cell at a time, which costs more than what is done
with them: facts and things therefore come as JSON, many things to a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from piitrace.functions.scores import ENV_EPS
from piitrace.operators import redaction, scoring
from piitrace.operators.graph import truth_flat
from piitrace.plans import replay
from piitrace.session import cut
from piitrace.streaming.streams import drain_stateful

RESULT = (
    "episode_id BIGINT, step INT, action_type STRING, reward DOUBLE, cumulative_reward DOUBLE, "
    "visible_total BIGINT, discovered_total BIGINT, redacted_total BIGINT, terminated BOOLEAN, "
    "truncated BOOLEAN"
)
HEAD = ("steps INT, total DOUBLE, done BOOLEAN, visible BIGINT, discovered BIGINT, "
        "discovered_true BIGINT, redacted BIGINT, tokens BIGINT, marked INT, waiting STRING")
SEP = "\u001f"
#: What an action brings, as the state reads it.
THING = ("cls", "n_logs", "value", "is_token", "in_truth")
NOTHING = [dict.fromkeys(THING)]
#: Surface values, hidden classes or true values in a row of ``effects``.
PACK = 256


def effects(logs: DataFrame, edges: DataFrame, truth: DataFrame, honeypots: DataFrame
            ) -> DataFrame:
    """What a key of an action brings: (scenario_id, kind, key, things).

    Kinds: ``scan`` gives surface values, ``search`` gives the hidden classes and
    their values, ``item`` the true values of a part of the scenario's, ``trap`` a honeypot. ``things`` is
    JSON, a list of ``THING``.
    """
    known = truth_flat(truth).withColumn("in_truth", F.lit(True))
    value = F.struct("value", "is_token", "in_truth")
    # Written once, with a row per class: surface, members and their values all come from it.
    classes = cut(
        replay.log_classes(logs.filter(F.size("labels") > 0)).select(
            "scenario_id", F.concat_ws(SEP, "labels").alias("cls"), "n_hidden", "n_surface",
            F.explode("labels").alias("value"))
        .join(known, ["scenario_id", "value"], "left")
        .fillna(False, subset=["is_token", "in_truth"])
        .groupBy("scenario_id", "cls", "n_hidden", "n_surface").agg(F.collect_list(value).alias("values")),
        "classes")

    surface = classes.filter("n_surface > 0").select("scenario_id", F.inline("values")).distinct().select(
        "scenario_id", F.lit("scan").alias("kind"), F.lit("").alias("key"),
        F.array(_thing()).alias("things"),
    )
    members = classes.filter("n_hidden > 0").select(
        "scenario_id", "cls", "n_hidden", "values", F.explode("values.value").alias("hit"))
    own = members.select("scenario_id", F.col("hit").alias("key"), "hit").distinct()
    linked = edges.select("scenario_id", F.col("src").alias("key"), F.col("dst").alias("hit"))
    search = own.unionByName(linked).distinct().join(members, ["scenario_id", "hit"]).select(
        "scenario_id", "key", "cls", "n_hidden", "values"
    ).distinct().select(
        "scenario_id", F.lit("search").alias("kind"), "key",
        F.transform("values", lambda v: _thing(
            F.col("cls"), F.col("n_hidden"), v["value"], v["is_token"], v["in_truth"])).alias("things"),
    )
    total = F.count(F.lit(1)).over(Window.partitionBy("scenario_id"))
    item = known.withColumn("key", _part(F.col("value"), total)).groupBy(
        "scenario_id", F.lit("item").alias("kind"), "key").agg(F.collect_list(_thing()).alias("things"))
    no = F.lit(False)
    trap = honeypots.select(
        "scenario_id", F.lit("trap").alias("kind"), F.col("value").alias("key"),
        F.array(_thing(is_token=no, in_truth=no)).alias("things"),
    )
    return _packed(surface.unionByName(search)).unionByName(
        item.unionByName(trap).withColumn("things", _json("things")))


def _thing(cls: Column | None = None, n_logs: Column | None = None, value: Column | None = None,
           is_token: Column | None = None, in_truth: Column | None = None) -> Column:
    """One ``THING``; what is not given is no class, no lines, or the column of that name."""
    given = (F.lit(None).cast("string") if cls is None else cls,
             F.lit(0).cast("bigint") if n_logs is None else n_logs,
             F.col("value") if value is None else value,
             F.coalesce("is_token", F.lit(False)) if is_token is None else is_token,
             F.col("in_truth") if in_truth is None else in_truth)
    return F.struct(*[c.alias(name) for c, name in zip(given, THING, strict=True)])


def _part(value: Column, total: Column) -> Column:
    """Which part a value belongs to, if ``total`` values are dealt to parts of about ``PACK``."""
    return F.pmod(F.xxhash64(value), F.greatest(F.ceil(total / PACK), F.lit(1))).cast("string")


def _json(c: str | Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def _packed(parts: DataFrame) -> DataFrame:
    """Lists of things by key, ``PACK`` of them to a row and in as many rows as that takes."""
    key = ["scenario_id", "kind", "key"]
    place = F.row_number().over(Window.partitionBy(*key).orderBy("things"))
    return parts.withColumn("_row", F.floor((place - 1) / PACK)).groupBy(*key, "_row").agg(
        _json(F.flatten(F.collect_list("things"))).alias("things")).drop("_row")


def scenario_facts(scenarios: DataFrame, logs: DataFrame, truth: DataFrame) -> DataFrame:
    flat = truth_flat(truth).groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("total_pii"),
        F.count(F.when(F.col("is_token"), 1)).alias("total_tokens"),
    )
    surface = logs.filter("layer = 0").groupBy("scenario_id").agg(
        F.count(F.lit(1)).alias("n_surface")
    )
    return scenarios.select("scenario_id", "budget").join(flat, "scenario_id", "left").join(
        surface, "scenario_id", "left"
    ).fillna(0)


def _clamp(x: float) -> float:
    return max(ENV_EPS, min(1.0 - ENV_EPS, x))


def _opened(row: dict) -> list[dict]:
    """The records in a row of ``keyed_actions``; a row that is a record already stays one."""
    if "record" not in row:
        return [row]
    things = json.loads(row.pop("things") or "null") or NOTHING
    facts = row | json.loads(row.pop("record"))
    items = facts.pop("items")
    if items is None:
        return [facts | thing for thing in things]
    known = {thing["value"]: thing for thing in things}
    return [facts | known.get(item, NOTHING[0]) | {"key": item} for item in items]


class EpisodeScorer(StatefulProcessor):
    """Applies the actions of one episode in step order, holding back early ones."""

    #: The state of numbers and its fields; ``marked`` counts the marks kept, ``waiting`` lists [step, time] of steps held back.
    schema = HEAD
    names = ("steps", "total", "done", "visible", "discovered", "true", "redacted", "tokens", "marked", "waiting")
    start = (0, ENV_EPS, False, None, 0, 0, 0, 0, 0, "[]")
    #: The columns of a result row.
    row = Row(*(x.split()[0] for x in RESULT.split(", ")))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", self.schema)
        self.marks = handle.getListState("marks", "mark STRING, value STRING")
        self.pending = handle.getMapState("pending", "step INT", "rows STRING")

    # ------------------------------------------------------------ state

    def _load(self) -> dict:
        """The numbers of the episode, and nothing else of its state yet."""
        kept = self.head.get()
        self.known = kept is not None
        return self._fresh(kept or self.start)

    def _fresh(self, kept: tuple) -> dict:
        head = dict(zip(self.names, kept, strict=True))
        self.waiting = dict(json.loads(head["waiting"]))
        self.stored = set(self.waiting)  # steps in the store; the others are in ``held``
        self.held: dict[int, list[dict]] = {}
        self.gone: list[int] = []
        self.seen = None if head["marked"] else set()
        self.added: list[tuple[str, str]] = []
        return head

    def _hold(self, step: int, rows: list[dict], at: int = 0) -> None:
        self.held[step] = rows
        self.waiting[step] = at

    def _take(self, step: int) -> list[dict]:
        """The rows of a waiting step, which waits no more."""
        del self.waiting[step]
        if step in self.stored:
            self.gone.append(step)
        rows = self.held.pop(step, None)
        return json.loads(self.pending.getValue((step,))[0]) if rows is None else rows

    def _forget(self, head: dict) -> None:
        """Clears the marks and the steps that wait."""
        if head["marked"]:
            self.marks.clear()
        if self.stored:
            self.pending.clear()
        head["marked"] = 0
        self.waiting, self.stored, self.held, self.gone, self.seen, self.added = {}, set(), {}, [], set(), []

    def _save(self, head: dict) -> None:
        """Writes what a batch has changed; of an episode that is done only the numbers stay."""
        if head["done"]:
            self._forget(head)
        for step in self.gone:
            if step not in self.held:
                self.pending.removeKey((step,))
        for step, rows in self.held.items():
            self.pending.updateValue((step,), (json.dumps(rows),))
        if self.added:
            self.marks.appendList(self.added)
            head["marked"] += len(self.added)
        head["waiting"] = json.dumps(list(self.waiting.items()))
        self.head.update(tuple(head[x] for x in self.names))

    @staticmethod
    def _by_step(rows: Iterator[Row]) -> dict[int, list[dict]]:
        """The rows of each step as records, one a thing; what orders the stream is left out."""
        out: dict[int, list[dict]] = {}
        for r in rows:
            record = dict(zip(r.__fields__, r, strict=True))
            record.pop("received_at", None)
            out.setdefault(int(record["step"]), []).extend(_opened(record))
        return out

    def _go_on(self, head: dict) -> list[tuple]:
        """Applies what waits and is due."""
        out = []
        while not head["done"] and head["steps"] + 1 in self.waiting:
            step = head["steps"] + 1
            out.append(self._apply(head, step, self._take(step)))
        return out

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        head = self._load()
        if head["done"]:
            return
        for step, part in self._by_step(rows).items():
            if step > head["steps"]:
                self._hold(step, part)
        out = self._go_on(head)
        self._save(head)
        for r in out:
            yield self.row(key[0], *r)

    def _mark(self, value: str, mark: str) -> bool:
        """Mark a value (d, i or r) or a line class (c); False if it was marked so."""
        if self.seen is None:
            self.seen = {(m, v) for m, v in self.marks.get()}
        if (mark, value) in self.seen:
            return False
        self.seen.add((mark, value))
        self.added.append((mark, value))
        return True

    def _discover(self, head, rows) -> tuple[int, int]:
        new = secrets = 0
        for r in rows:
            if self._mark(r["value"], "d"):
                new += 1
                secrets += bool(r["is_token"])
                head["true"] += bool(r["in_truth"])
        head["discovered"] += new
        return new, secrets

    def _apply(self, head, step, records):
        first = records[0]
        if head["visible"] is None:
            head["visible"] = int(first["n_surface"])
        action, target = first["action_type"], first["target_entity"] or ""
        by_kind = lambda kind: [
            r for r in records if r["kind"] == kind and isinstance(r["value"], str)
        ]
        reward = ENV_EPS
        if action == "scan":
            new, _ = self._discover(head, by_kind("scan"))
            reward = _clamp(replay.SCAN_WEIGHT * new)
        elif action == "investigate" and target and self._mark(target, "i"):
            if by_kind("trap"):
                reward = replay.HONEYPOT_REWARD
            else:
                hits = by_kind("search")
                lines = {cls: n for cls, n in {r["cls"]: int(r["n_logs"]) for r in hits}.items()
                         if self._mark(cls, "c")}
                new, secrets = self._discover(head, [r for r in hits if r["cls"] in lines])
                head["visible"] += sum(lines.values())
                if lines or new:
                    reward = _clamp(replay.INVESTIGATE_WEIGHT * new)
                    if secrets:
                        reward = _clamp(reward + replay.SECRET_FOUND * secrets)
        elif action == "redact":
            reward = self._redact(head, [r for r in records if r["kind"] == "item"],
                                  int(first["total_pii"]))
        head["steps"] = step
        terminated = action == "submit"
        truncated = step >= int(first["budget"]) and not terminated
        if terminated or truncated:
            reward = self._submit(head, first)
            head["done"] = True
        head["total"] = _clamp(head["total"] + reward)
        return (step, action, float(reward), float(head["total"]), head["visible"],
                head["discovered"], head["redacted"], terminated, truncated)

    def _redact(self, head, items, total) -> float:
        if not items:
            return ENV_EPS
        right = wrong = secrets = 0
        for r in items:
            if not r["in_truth"]:
                wrong += 1
            elif self._mark(r["key"], "r"):
                right += 1
                secrets += bool(r["is_token"])
        head["redacted"] += right
        head["tokens"] += secrets
        score = _clamp(right / total) if total else ENV_EPS
        bonus = _clamp(redaction.SECRET_BONUS * secrets) if secrets else ENV_EPS
        return _clamp(score - redaction.FP_PENALTY * min(wrong, redaction.FP_CAP) + bonus)

    def _submit(self, head, facts) -> float:
        total = int(facts["total_pii"])
        share = lambda n: _clamp(n / total) if total else ENV_EPS
        precision = 1.0 - ENV_EPS if head["redacted"] else ENV_EPS
        recall = share(head["redacted"])
        f1 = _clamp(2.0 * precision * recall / (precision + recall))
        saved = max(0, int(facts["budget"]) - head["steps"])
        missed = int(facts["total_tokens"]) - head["tokens"]
        return _clamp(
            f1 * scoring.F1_WEIGHT + share(head["true"]) * scoring.DISCOVERY_WEIGHT
            + recall * scoring.RECALL_WEIGHT + _clamp(scoring.STEP_SAVED_BONUS * saved)
            - scoring.ENV_SECRET * min(missed, scoring.ENV_SECRET_CAP)
        )

    def close(self) -> None:
        pass


def keyed_actions(records: DataFrame, brings: DataFrame, facts: DataFrame, time: str | None = None,
                  more: list | None = None) -> DataFrame:
    """A row per key of an action and row that ``brings`` has of it, and the columns ``more``.

    ``record`` holds the action, the facts of its scenario, the key and of a redaction the items that belong to
    it; ``things`` what the key brings, null if nothing. Facts and ``brings`` come from one truth. With a
    ``time`` column, what leaves rows out looks at it too: otherwise the optimizer would do so before the
    watermark has seen them.
    """
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    action, target = F.col("action_type"), F.coalesce("target_entity", F.lit(""))
    originals = F.transform("redactions", lambda r: F.coalesce(r["original"], F.lit("")))
    part = lambda o: _part(o, F.col("total_pii"))
    keys = (
        F.when(action == "scan", F.array(pair("scan", F.lit(""))))
        .when(action == "investigate", F.array(pair("search", target), pair("trap", target)))
        .when(action == "redact", F.array_distinct(F.transform(originals, lambda o: pair("item", part(o)))))
    )
    base = ["episode_id", "scenario_id", "step"]
    told = ["action_type", "target_entity", "budget", "total_pii", "total_tokens", "n_surface"]
    # a step past the budget can never count; leaving it out here bounds what one
    # episode can send to its state
    counts = F.col("step") <= F.col("budget")
    if time is not None:
        counts = F.when(F.col(time).isNotNull(), counts)
    live = records.join(facts, "scenario_id", "left").filter(counts)
    keyed = live.select(*base, *told, "redactions", *(more or []), F.posexplode_outer(keys).alias("pos", "k"))
    items = F.when(F.col("kind") == "item", F.filter(originals, lambda o: part(o) == F.col("key")))
    record = F.struct(*told, "kind", "key", items.alias("items"))
    keyed = keyed.withColumns({"kind": F.col("k.kind"), "key": F.col("k.key")}).withColumn("record", _json(record))
    return keyed.drop("k", "pos", "redactions", *told).join(
        brings, ["scenario_id", "kind", "key"], "left").drop("scenario_id", "kind", "key")


def stream_score(records: DataFrame, brings: DataFrame, facts: DataFrame) -> DataFrame:
    """Score a stream of action records (schema ``ACTION_RECORD``) step by step.

    ``brings`` is the table of ``effects``, ``facts`` that of ``scenario_facts``; every batch reads
    them, so they should be stored tables (``session.cut``).
    Needs the RocksDB state store, see ``drain_stateful``.
    """
    return keyed_actions(records, brings, facts).groupBy("episode_id").transformWithState(
        EpisodeScorer(), outputStructType=RESULT, outputMode="append", timeMode="None"
    )


def drain_scores(scores: DataFrame, label: str) -> DataFrame:
    """Drain a scoring stream with the state store it needs."""
    return drain_stateful(scores, label)
