"""Genetic search for feature scales. The loop is on the driver; every score is one job over all rows."""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

Genes = tuple[int, ...]


@dataclass(frozen=True)
class Search:
    population: int = 50
    generations: int = 100
    elite: float = 0.2
    mutation: float = 0.2
    step: int = 1
    seed: int = 17
    larger_is_better: bool = True


def first_genes(r: random.Random, domain: Genes, free: int = 6, least: int = 10) -> Genes:
    """Uniform in 0..domain for the first ``free`` features, in ``least``..domain for the rest."""
    return tuple(r.randint(0 if i < free else min(least, d), d) for i, d in enumerate(domain))


def mutate(genes: Genes, domain: Genes, step: int, r: random.Random) -> Genes:
    """A copy with one gene moved by ``step``, within 0..domain."""
    out = list(genes)
    i = r.randrange(len(out))
    if r.random() < 0.5 and out[i] >= step:
        out[i] -= step
    elif out[i] + step <= domain[i]:
        out[i] += step
    return tuple(out)


def crossover(a: Genes, b: Genes, r: random.Random) -> Genes:
    """The head of one and the tail of the other, cut at 1..d-2 (at 1 where there is no such place)."""
    cut = r.randint(1, max(1, len(a) - 2))
    return a[:cut] + b[cut:]


def genetic(score: Callable[[Genes], float], domain: Genes, search: Search = Search()) -> tuple[Genes, float, list[float]]:
    """The best genes, their score, and the best score of each generation. Genes are scored once each."""
    r = random.Random(search.seed)
    known: dict[Genes, float] = {}

    def scored(genes: Genes) -> float:
        if genes not in known:
            known[genes] = score(genes)
        return known[genes]

    sign = -1 if search.larger_is_better else 1
    people = [first_genes(r, domain) for _ in range(search.population)]
    keep = max(1, round(search.elite * search.population))
    history = []
    for _ in range(search.generations):
        people.sort(key=lambda g: (sign * scored(g), g))
        history.append(scored(people[0]))
        elite = people[:keep]
        people = elite + [mutate(r.choice(elite), domain, search.step, r) if r.random() < search.mutation else crossover(r.choice(elite), r.choice(elite), r) for _ in range(search.population - keep)]
    best = min(people, key=lambda g: (sign * scored(g), g))
    return best, scored(best), history
