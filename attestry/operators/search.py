"""Search engines that run on the driver and evaluate their states with Spark jobs."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Hashable, Iterable, Sequence
from dataclasses import dataclass


@dataclass
class Problem:
    """A search problem: states, their successors with step costs, a goal test and a lower bound."""

    start: Hashable
    successors: Callable[[Hashable], Iterable[tuple[Hashable, float]]]
    is_goal: Callable[[Hashable], bool]
    bound: Callable[[Hashable], float] = lambda _: 0.0


def ida_star(problem: Problem, most: int = 10_000) -> tuple[list[Hashable], float] | None:
    """Iterative deepening A*: the cheapest path to a goal, or None. States on the path are not visited
    again, and a state that failed within some budget is not tried with a smaller one."""
    limit = problem.bound(problem.start)
    for _ in range(most):
        failed: dict[Hashable, float] = {}
        path, next_limit = [problem.start], math.inf

        def dive(cost: float) -> bool:
            nonlocal next_limit
            state = path[-1]
            f = cost + problem.bound(state)
            if f > limit:
                next_limit = min(next_limit, f)
                return False
            if problem.is_goal(state):
                total.append(cost)
                return True
            if failed.get(state, -math.inf) >= limit - cost:
                return False
            for other, step in problem.successors(state):
                if other in path:
                    continue
                path.append(other)
                if dive(cost + step):
                    return True
                path.pop()
            failed[state] = limit - cost
            return False

        total: list[float] = []
        if dive(0.0):
            return path, total[0]
        if next_limit == math.inf:
            return None
        limit = next_limit
    return None


def minimal_subset(columns: Sequence[str], score: Callable[[tuple[str, ...]], float], tolerance: float = 0.02, most: int = 4) -> tuple[tuple[str, ...], float]:
    """The smallest set of columns whose score is within ``tolerance`` of the score of all of them; the
    best of at most ``most`` columns if there is none. Scores are computed once per set."""
    known: dict[tuple[str, ...], float] = {}

    def rate(chosen: tuple[str, ...]) -> float:
        if chosen not in known:
            known[chosen] = score(chosen)
        return known[chosen]

    goal = rate(tuple(columns)) - tolerance
    at = {c: i for i, c in enumerate(columns)}
    problem = Problem((), lambda s: (((*s, c), 1.0) for c in columns if (not s or at[c] > at[s[-1]]) and len(s) < most), lambda s: bool(s) and rate(s) >= goal)
    found = ida_star(problem)
    if found:
        return found[0][-1], rate(found[0][-1])
    best = max((s for s in known if len(s) <= most and s), key=lambda s: (known[s], -len(s), s), default=tuple(columns))
    return best, rate(best)


def alpha_beta(state: Hashable, depth: int, moves: Callable[[Hashable], Sequence[Hashable]], value: Callable[[Hashable], float], maximise: bool = True, low: float = -math.inf, high: float = math.inf) -> tuple[float, Hashable | None, int]:
    """(minimax value, best move, leaves valued). Fail-hard: the value never leaves the window low..high. Of
    moves of equal value the first; the value of a state that was cut off is a bound of its true value."""
    options = moves(state) if depth else ()
    if not options:
        return min(max(value(state), low), high), None, 1
    best, leaves = None, 0
    for other in options:
        got, _, n = alpha_beta(other, depth - 1, moves, value, not maximise, low, high)
        leaves += n
        if maximise and got > low or not maximise and got < high:
            best = other
            low, high = (got, high) if maximise else (low, got)
        if low >= high:
            break
    return (low if maximise else high), best if best is not None else options[0], leaves


def worst_case_choice(options: Sequence[str], adversities: Sequence[str], score: Callable[[str, str], float]) -> tuple[str, float, int]:
    """(option, its worst score, scores computed): the option whose worst score over the adversities is
    best, a game of two moves in which scores that cannot matter are not computed."""
    root: tuple = ()
    worst, best, n = alpha_beta(root, 2, lambda s: [(*s, x) for x in (options if not s else adversities)], lambda s: score(*s))
    return best[0], worst, n


def evolve(genes: dict[str, Sequence], fitness: Callable[[list[dict]], list[float]], population: int = 12, generations: int = 10, mutation: float = 0.1, elite: float = 0.25, patience: int = 4, seed: int = 0) -> tuple[dict, float]:
    """Genetic search over discrete genes. ``fitness`` values a whole list at once (one Spark job); NaN
    counts as the worst; a genome is valued once; it ends when ``patience`` generations bring nothing."""
    rng = random.Random(seed)
    known: dict[tuple, float] = {}
    pool = [{k: rng.choice(v) for k, v in genes.items()} for _ in range(population)]
    best, best_score, idle = pool[0], -math.inf, 0
    for _ in range(generations):
        fresh = list({tuple(g.items()): g for g in pool if tuple(g.items()) not in known}.values())
        for g, x in zip(fresh, fitness(fresh) if fresh else []):
            known[tuple(g.items())] = -math.inf if x != x else x
        ranked = sorted(pool, key=lambda g: -known[tuple(g.items())])
        top = known[tuple(ranked[0].items())]
        best, best_score, idle = (ranked[0], top, 0) if top > best_score else (best, best_score, idle + 1)
        if idle >= patience:
            break
        keep = ranked[: max(2, round(elite * population))]
        pool = [*keep]
        while len(pool) < population:
            a, b = rng.sample(keep, 2)
            pool.append({k: rng.choice(v) if rng.random() < mutation else rng.choice((a[k], b[k])) for k, v in genes.items()})
    return best, best_score
