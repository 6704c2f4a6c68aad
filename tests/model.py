"""An episode as definitions: what has entered by which step, and what a step is worth.

Nothing is carried from step to step. Every question is answered from the list of
actions played so far, in the words of the rule cards.
"""

from dataclasses import dataclass


def hold(x, eps=0.05):
    return max(eps, min(1.0 - eps, x))


@dataclass
class Scene:
    """``lines``: (layer, values) in order; ``links``: src to set of dst; ``truth``: value to type."""

    lines: list
    links: dict
    truth: dict
    traps: set
    budget: int


def earliest(pairs):
    """Key to the smallest step it comes with."""
    out = {}
    for key, step in pairs:
        out[key] = min(step, out.get(key, step))
    return out


class Episode:
    def __init__(self, scene):
        self.scene, self.played = scene, []

    # ---- what entered when

    def of_kind(self, kind):
        return [(n, target, items) for n, (action, target, items) in enumerate(self.played, 1)
                if action == kind]

    @property
    def tried_at(self):
        return earliest((t, n) for n, t, _ in self.of_kind("investigate") if t)

    @property
    def opened_at(self):
        """Line number to step; surface lines are open from the start."""
        reach = [({t} | self.scene.links.get(t, set()), n) for t, n in self.tried_at.items()
                 if t not in self.scene.traps]
        surface = [(i, 0) for i, (layer, _) in enumerate(self.scene.lines) if layer == 0]
        return earliest(surface + [(i, n) for i, (_, values) in enumerate(self.scene.lines)
                                   for wanted, n in reach if wanted & set(values)])

    @property
    def known_at(self):
        """Value to step: when its line opened, for surface lines when first scanned."""
        scans = [n for n, _, _ in self.of_kind("scan")]
        return earliest((v, n or scans[0]) for i, n in self.opened_at.items() if n or scans
                        for v in self.scene.lines[i][1])

    @property
    def removed_at(self):
        return earliest((v, n) for n, _, items in self.of_kind("redact") for v in items
                        if v in self.scene.truth)

    # ---- what a step is worth

    def score(self):
        truth, removed = self.scene.truth, set(self.removed_at)
        share = lambda found: hold(len(found) / len(truth))
        recall, precision = share(removed), 0.95 if removed else 0.05
        f1 = hold(2.0 * precision * recall / (precision + recall))
        tokens = {v for v, t in truth.items() if t == "token"}
        spare = hold(0.05 * max(0, self.scene.budget - len(self.played)))
        found = share(set(self.known_at) & set(truth))
        return hold(f1 * 0.7 + found * 0.2 + recall * 0.1 + spare - 0.3 * min(3, len(tokens - removed)))

    def worth(self):
        """The reward of the last action."""
        if self.over:
            return self.score()
        n, (action, target, items) = len(self.played), self.played[-1]
        now = lambda entered: [k for k, step in entered.items() if step == n]
        tokens = lambda values: sum(self.scene.truth.get(v) == "token" for v in values)
        fresh = now(self.known_at)
        if action == "scan":
            return hold(0.1 * len(fresh))
        if action == "redact":
            right = now(self.removed_at)
            wrong = [v for v in items if v not in self.scene.truth]
            prize = hold(0.2 * tokens(right)) if tokens(right) else 0.05
            share = hold(len(right) / len(self.scene.truth))
            return hold(share - 0.25 * min(4, len(wrong)) + prize) if items else 0.05
        if self.tried_at.get(target) != n:
            return 0.05
        if target in self.scene.traps:
            return -0.5
        if not fresh and not now(self.opened_at):
            return 0.05
        base = hold(0.15 * len(fresh))
        return hold(base + 0.3 * tokens(fresh)) if tokens(fresh) else base

    # ---- playing

    @property
    def over(self):
        return bool(self.played) and (
            self.played[-1][0] == "submit" or len(self.played) >= self.scene.budget)

    def play(self, action, target=None, items=()):
        """Play an action; its reward, or None if the episode is over."""
        if self.over:
            return None
        self.played.append((action, target, list(items)))
        return self.worth()

    def targets(self):
        return sorted(set(self.known_at) - set(self.tried_at))
