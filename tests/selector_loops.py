"""Token selectors by name, as loops over one sample: what the plans of evalweave.operators.staged are held against. A selector is a list of stages: each puts the tokens in an order and takes the first of them that are still free, up to its quota.

Orders are arrays over one sample's tokens; only the farthest-point and the coverage stage go token by token. What a stage can't fill is left to the
next ones, and at last to relevance and distance. With a budget of all tokens, all are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd

TINY = 1e-12
#: How far a relation's corridor reaches beyond the boxes that it joins.
CORRIDOR = 0.04


@dataclass
class Tokens:
    """One sample: boxes (x1, y1, x2, y2) of its tokens and of its evidence, scores, relation, and a salt for hashed orders."""

    boxes: np.ndarray
    relevance: np.ndarray
    uniqueness: np.ndarray
    regions: np.ndarray = field(default_factory=lambda: np.zeros((0, 4)))
    salt: str = ""

    def __post_init__(self):
        self.n = len(self.boxes)
        self.index = np.arange(self.n)
        self.centre = (self.boxes[:, :2] + self.boxes[:, 2:]) / 2

    def overlap(self) -> np.ndarray:
        """Area that each token shares with each region."""
        low, high = np.maximum(self.boxes[:, None, :2], self.regions[None, :, :2]), np.minimum(self.boxes[:, None, 2:], self.regions[None, :, 2:])
        return np.maximum(0, high - low).prod(axis=2)

    def inside(self) -> np.ndarray:
        """Does a region hold a token's centre, edges included?"""
        c = self.centre[:, None, :]
        return ((c >= self.regions[None, :, :2]) & (c <= self.regions[None, :, 2:])).all(axis=2)


def area(boxes: np.ndarray) -> np.ndarray:
    return np.maximum(TINY, np.maximum(0, boxes[:, 2:] - boxes[:, :2]).prod(axis=1))


def unit_range(x: np.ndarray) -> np.ndarray:
    span = x.max(initial=-np.inf) - x.min(initial=np.inf)
    return (x - x.min()) / span if span > TINY else np.zeros(len(x))


def squared(t: Tokens, to: np.ndarray) -> np.ndarray:
    """Squared distance of each token's centre to the nearest of some points, 0 without points."""
    return ((t.centre[:, None, :] - to[None, :, :]) ** 2).sum(axis=2).min(axis=1) if len(to) else np.zeros(t.n)


Order = Callable[[Tokens, list[int], int], "np.ndarray | Iterator[int]"]


def by_relevance(t: Tokens, picked: list[int], quota: int) -> np.ndarray:
    return np.lexsort((t.index, -t.relevance))


def by_grid(t: Tokens, picked: list[int], quota: int) -> np.ndarray:
    """Of each of the first cells of a square grid the token nearest to its centre, then the others by row and column."""
    side = int(np.ceil(np.sqrt(quota)))
    cell = np.clip((t.centre * side).astype(int), 0, side - 1) @ np.array([1, side])
    goal = np.stack([cell % side + 0.5, cell // side + 0.5], axis=1) / side
    by = np.lexsort((t.index, ((t.centre - goal) ** 2).sum(axis=1), cell))
    first = by[np.concatenate([[True], cell[by][1:] != cell[by][:-1]])]
    first = first[cell[first] < quota]
    rest = np.setdiff1d(t.index, first)
    return np.concatenate([first, rest[np.lexsort((rest, t.centre[rest, 0], t.centre[rest, 1]))]])


def by_ring(t: Tokens, picked: list[int], quota: int) -> np.ndarray:
    """Around the relevant tokens: those of positive relevance where not all are, else the best."""
    if not t.relevance.max(initial=0) > 0:
        return np.zeros(0, int)
    some = np.flatnonzero(t.relevance > 0)
    anchors = some if len(some) < t.n else by_relevance(t, [], 0)[: max(1, min(t.n, len(picked) or quota))]
    return np.lexsort((t.index, -t.relevance, squared(t, t.centre[anchors])))


def by_corridor(t: Tokens, picked: list[int], quota: int) -> np.ndarray:
    """Between the first two regions: what touches their common box first, then by distance to it."""
    if len(t.regions) < 2:
        return np.zeros(0, int)
    box = np.clip(np.concatenate([t.regions[:2, :2].min(axis=0) - CORRIDOR, t.regions[:2, 2:].max(axis=0) + CORRIDOR]), 0, 1)
    touches = (np.minimum(t.boxes[:, 2:], box[2:]) > np.maximum(t.boxes[:, :2], box[:2])).all(axis=1)
    off = np.maximum(0, np.maximum(box[:2] - t.centre, t.centre - box[2:]))
    return np.lexsort((t.index, -t.relevance, ((t.centre - (box[:2] + box[2:]) / 2) ** 2).sum(axis=1), (off**2).sum(axis=1), ~touches))


def by_corridor_then_ring(t: Tokens, picked: list[int], quota: int) -> np.ndarray:
    way = by_corridor(t, picked, quota)
    return way if len(way) else by_ring(t, picked, quota)


def soft_corridor(tail: float = 0.15) -> Order:
    """The ring, of whose quota the last share, one place at least, goes to the corridor."""

    def order(t: Tokens, picked: list[int], quota: int) -> list[int]:
        ring = [i for i in by_ring(t, picked, quota).tolist() if i not in picked][:quota]
        if not ring:
            return []
        kept = ring[: quota - min(quota, max(1, round(tail * quota)))]
        way = [i for i in by_corridor(t, picked, quota).tolist() if i not in picked and i not in kept]
        return [*kept, *way[: quota - len(kept)], *[i for i in ring if i not in kept]]

    return order


def farthest(t: Tokens, picked: list[int], quota: int) -> Iterator[int]:
    """Always the free token farthest from all that is picked; from nothing, the grid."""
    if not picked:
        yield from by_grid(t, picked, quota).tolist()
        return
    far, free = squared(t, t.centre[picked]), np.ones(t.n, dtype=bool)
    free[picked] = False
    while free.any():
        best = int(np.argmax(np.where(free, far, -np.inf)))
        free[best] = False
        yield best
        far = np.minimum(far, ((t.centre - t.centre[best]) ** 2).sum(axis=1))


def by_relevance_and_distance(t: Tokens, picked: list[int], quota: int) -> np.ndarray:
    return np.lexsort((t.index, -squared(t, t.centre[picked]), -t.relevance))


def by_region(t: Tokens, picked: list[int], quota: int) -> list[int]:
    """Regions take turns, each with its token of the largest covered share; then by the share that all regions cover."""
    share = t.overlap() / area(t.boxes)[:, None]
    queues = [[i for i in np.lexsort((t.index, -t.relevance, -share[:, r])).tolist() if share[i, r] > 0] for r in range(len(t.regions))]
    turns = []
    while any(queues):
        for queue in queues:
            while queue and queue[0] in turns:
                queue.pop(0)
            if queue:
                turns.append(queue.pop(0))
    every = share.sum(axis=1)
    return [*turns, *[i for i in np.lexsort((t.index, -t.relevance, -every)).tolist() if every[i] > 0]]


def region_centres(t: Tokens, picked: list[int], quota: int) -> list[int]:
    """For each region in turn the free token nearest to its centre, one whose own centre lies in it first."""
    share, inside, out = t.overlap() / area(t.boxes)[:, None], t.inside(), []
    for r in range(len(t.regions)):
        goal = (t.regions[r, :2] + t.regions[r, 2:]) / 2
        order = np.lexsort((t.index, -t.relevance, -share[:, r], ((t.centre - goal) ** 2).sum(axis=1), ~inside[:, r]))
        out += [i for i in order.tolist() if i not in out][:1]
    return out


def fill(t: Tokens, k: int, stages: list[tuple[int | Callable[[int], int], Order]]) -> list[int]:
    """Places of the kept tokens in the order in which the stages took them; a quota may depend on how many are taken."""
    k = max(1, min(t.n, k))
    if k == t.n:
        return t.index.tolist()
    picked: list[int] = []
    for quota, order in [*stages, (k, by_relevance_and_distance)]:
        quota = min(quota(len(picked)) if callable(quota) else quota, k - len(picked))
        if quota > 0:
            taken = []
            for i in map(int, order(t, picked, quota)):
                if i not in picked and i not in taken:
                    taken.append(i)
                if len(taken) == quota:
                    break
            picked += taken
    return picked


def hybrid(context: Order, core: float = 0.5, around: float = 0.25) -> Callable[[Tokens, int], list[int]]:
    """A core by relevance, a share of context, the rest spread out."""

    def choose(t: Tokens, k: int) -> list[int]:
        k = max(1, min(t.n, k))
        first = max(1, min(k, round(core * k)))
        second = max(0, min(k - first, round(around * k)))
        return fill(t, k, [(first, by_relevance), (second, context), (k - first - second, farthest)])

    return choose


def relation_hybrid(t: Tokens, k: int, core: float = 0.5, around: float = 0.25) -> list[int]:
    return hybrid(by_corridor_then_ring, core, around)(t, k)


def protected_relation_hybrid(t: Tokens, k: int, core: float = 0.5, around: float = 0.25) -> list[int]:
    """Evidence up to the core's share, then the corridor, the rest spread out."""
    if not len(t.regions):
        return relation_hybrid(t, k, core, around)
    k = max(1, min(t.n, k))
    return fill(t, k, [(max(1, min(k, round(core * k))), by_region), (round(around * k), by_corridor_then_ring), (k, farthest)])


def protected_top(t: Tokens, k: int, core: float = 0.5) -> list[int]:
    k = max(1, min(t.n, k))
    return fill(t, k, [*([(max(1, min(k, round(core * k))), by_region)] if len(t.regions) else []), (k, by_relevance)])


def protected_centre_top(t: Tokens, k: int) -> list[int]:
    return fill(t, k, [*([(len(t.regions), region_centres)] if len(t.regions) else []), (k, by_relevance)])


def soft_evidence_top(t: Tokens, k: int, boost: float = 0.10) -> list[int]:
    """By relevance scaled to 0..1 plus a boost for the covered share, 1 for a centre inside."""
    if not len(t.regions) or not boost:
        return fill(t, k, [(t.n, by_relevance)])
    share = np.maximum(t.overlap() / area(t.boxes)[:, None], t.inside()).max(axis=1)
    return fill(t, k, [(t.n, lambda t, p, q: np.lexsort((t.index, -(unit_range(t.relevance) + boost * share))))])


def spatial_aware(t: Tokens, k: int, core: float = 0.35, around: float = 0.25) -> list[int]:
    """A token for the centre of each region, more evidence up to the core's share, the corridor, the rest spread out."""
    k = max(1, min(t.n, k))
    if not len(t.regions):
        return fill(t, k, [(k, by_grid)])
    anchors = max(min(k, len(t.regions)), min(k, round(core * k)))
    return fill(t, k, [(anchors, region_centres), (lambda n: anchors - n, lambda t, p, q: by_region(t, p, q)[:anchors]), (round(around * k), by_corridor_then_ring), (k, farthest)])


def coverage_greedy(t: Tokens, k: int, target: float = 1.0, grid: float = 0.30, evidence: float = 0.50, unique: float = 0.20) -> list[int]:
    """Most gain first: scaled relevance and uniqueness, a new cell of a square grid, and what a token adds to the covered share of each region."""
    k = max(1, min(t.n, k))
    if k == t.n:
        return t.index.tolist()
    side = int(np.ceil(np.sqrt(k)))
    cell = np.clip((t.centre * side).astype(int), 0, side - 1) @ np.array([1, side])
    fixed = target * unit_range(t.relevance) + unique * unit_range(t.uniqueness)
    share = t.overlap() / area(t.regions)[None, :] if len(t.regions) else np.zeros((t.n, 1))
    covered, fresh, free, out = np.zeros(share.shape[1]), np.ones(side * side, dtype=bool), np.ones(t.n, dtype=bool), []
    for _ in range(k):
        more = (np.minimum(1, covered[None, :] + share) - np.minimum(1, covered)[None, :]).sum(axis=1) / share.shape[1]
        best = int(np.argmax(np.where(free, fixed + grid * fresh[cell] / side**2 + evidence * more, -np.inf)))
        free[best], fresh[cell[best]] = False, False
        covered = np.minimum(1, covered + share[best])
        out.append(best)
    return out


def rise(t: Tokens, k: int, unique: float = 0.6, spread: float = 0.4, dominant: float = 0.7) -> list[int]:
    """A share by relevance and uniqueness, then from the best three times k with a bonus for the distance to what is picked."""
    k = max(1, min(t.n, k))
    if k == t.n:
        return t.index.tolist()
    base = t.relevance + unique * t.uniqueness
    short = np.lexsort((t.index, -base))[: 3 * k]
    picked = short[: round(dominant * k)].tolist()
    allowed = np.zeros(t.n, dtype=bool)
    allowed[short] = True
    while len(picked) < k:
        allowed[picked] = False
        picked.append(int(np.argmax(np.where(allowed, base + spread * np.sqrt(squared(t, t.centre[picked])), -np.inf))))
    return picked


def _digest(t: Tokens) -> np.ndarray:
    return np.array([int(hashlib.sha1(f"{t.salt}:{i}".encode()).hexdigest()[:13], 16) for i in range(t.n)])


def by_score(score: Callable[[Tokens], np.ndarray]) -> Callable[[Tokens, int], list[int]]:
    return lambda t, k: fill(t, k, [(t.n, lambda t, p, q: np.lexsort((t.index, -score(t))))])


#: Selectors by name. Random orders are digests of the salt and the place, so that they need no generator's state.
SELECTORS: dict[str, Callable[[Tokens, int], list[int]]] = {
    "random": by_score(_digest),
    "grid": lambda t, k: fill(t, k, [(k, by_grid)]),
    "grid_topk": lambda t, k: fill(t, k, [(max(1, min(k, round(0.5 * k))), by_grid), (k, by_relevance)]),
    "center": by_score(lambda t: -((t.centre - 0.5) ** 2).sum(axis=1)),
    "topk": by_score(lambda t: t.relevance),
    "bottomk": by_score(lambda t: -t.relevance),
    "shuffled_topk": by_score(lambda t: t.relevance[np.argsort(_digest(t), kind="stable")]),
    "rise": rise,
    "hybrid": hybrid(by_ring),
    "rel_hybrid": relation_hybrid,
    "soft_relboost": hybrid(soft_corridor()),
    "protected_rel_hybrid": protected_relation_hybrid,
    "protected_topk": protected_top,
    "protected_center_topk": protected_centre_top,
    "soft_evidence_topk": soft_evidence_top,
    "spatial_aware": spatial_aware,
    "coverage_greedy": coverage_greedy,
}


def tokens_of(rows: pd.DataFrame, salt: str = "") -> Tokens:
    """A sample's rows (x1, y1, x2, y2, relevance, uniqueness, regions) as tokens."""
    regions = rows["regions"].iloc[0] if "regions" in rows and len(rows) else None
    boxes = np.array([[r[c] for c in ("x1", "y1", "x2", "y2")] for r in regions], dtype=float).reshape(-1, 4) if regions is not None else np.zeros((0, 4))
    return Tokens(rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows["relevance"].to_numpy(float), rows["uniqueness"].to_numpy(float), boxes, salt)
