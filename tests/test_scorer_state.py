"""What the episode scorers ask of the state store."""

from pyspark.sql import Row

from piitrace.streaming import online, sightings, timed


class Store:
    """A handle whose states live in memory and count the calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getValueState(self, name, schema):
        return State(self)

    getListState = getValueState

    def getMapState(self, name, key, value):
        return State(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class State:
    def __init__(self, store):
        self.store, self.value, self.items, self.map = store, None, [], {}

    def _did(self, result=None):
        self.store.calls += 1
        return result

    def exists(self):
        return self._did(self.value is not None)

    def get(self):
        return self._did(iter(self.items) if self.items else self.value)

    def update(self, value):
        self._did()
        self.value = value

    def appendList(self, items):
        self._did()
        self.items += items

    def containsKey(self, key):
        return self._did(key in self.map)

    def getValue(self, key):
        return self._did(self.map[key])

    def updateValue(self, key, value):
        self._did()
        self.map[key] = value

    def removeKey(self, key):
        self._did()
        del self.map[key]

    def clear(self):
        self._did()
        self.value, self.items, self.map = None, [], {}


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentWatermarkInMs


RECORD = Row(*("episode_id step action_type target_entity budget total_pii total_tokens n_surface received_at "
               "received_ms kind key cls n_logs value is_token in_truth").split())


def scans(*steps, values=500, at=0):
    return [RECORD(1, s, "scan", None, 30, values, 0, 7, None, at, "scan", "", None, 0, f"v{i}", False, True)
            for s in steps for i in range(values)]


def test_calls_do_not_grow_with_the_values():
    for scorer in (online.EpisodeScorer(), timed.TimedScorer(10, 1000)):
        store = Store()
        scorer.init(store)
        first = list(scorer.handleInputRows((1,), iter(scans(1, 2, 4)), Clock(0)))
        assert [(r.step, r.discovered_total) for r in first] == [(1, 500), (2, 500)]
        assert store.calls <= 8
        then = list(scorer.handleInputRows((1,), iter(scans(3)), Clock(0)))
        assert [(r.step, r.discovered_total) for r in then] == [(3, 500), (4, 500)]
        assert store.calls <= 16


def test_both_timers_at_one_time():
    """The gap is given up and the idle episode ends, though the store keeps one timer for both."""
    scorer, store = timed.TimedScorer(50, 50), Store()
    scorer.init(store)
    list(scorer.handleInputRows((1,), iter(scans(1, 3, values=2, at=100)), Clock(0)))
    assert store.timers == {150}
    store.timers.clear()
    got = list(scorer.handleExpiredTimer((1,), Clock(200), Clock(150)))
    assert [(r.step, r.status) for r in got] == [(2, "missing"), (3, "applied"), (3, "expired")]
    assert not store.timers and scorer.head.value is None


def test_a_timer_that_moves_to_the_time_of_the_other_stays():
    scorer, store = timed.TimedScorer(100, 50), Store()
    scorer.init(store)
    list(scorer.handleInputRows((1,), iter(scans(3, values=1, at=100)), Clock(0)))
    assert store.timers == {150, 200}
    list(scorer.handleInputRows((1,), iter(scans(2, values=1, at=50)), Clock(0)))
    assert store.timers == {150}
    assert scorer._load()["gap"] == 150 == scorer._load()["idle"]


def test_a_sighting_is_read_and_written_once():
    store, scorer = Store(), sightings.FirstSighting(1000)
    scorer.init(store)
    seen = Row(*"scenario_id value seen_us log_id pattern_ord match_ord pattern_id pii_type ts".split())
    rows = [seen(1, "a", t * 1000, t, 0, 0, "E1", "email", None) for t in (7, 5, 9)]
    assert not list(scorer.handleInputRows((1, "a"), iter(rows), Clock(0))) and store.calls <= 3
    assert store.timers == {6}
    got = list(scorer.handleExpiredTimer((1, "a"), Clock(6), Clock(6)))
    assert [(r.log_id, r.seen_us) for r in got] == [(5, 5000)] and store.calls <= 6
    assert not list(scorer.handleInputRows((1, "a"), iter(rows), Clock(6)))
