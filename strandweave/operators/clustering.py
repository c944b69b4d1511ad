"""Clusters of one sample's contigs: numbers, reasons to fail, and the score that refines a cut."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import sqrt

from .trees import Tree, upgma

@dataclass(frozen=True)
class Contig:
    id: int
    filename: str
    length: int
    weight: int = 1
    trusted: bool = False


@dataclass
class Cluster:
    number: int
    node: int
    contigs: list[Contig]
    distance: float
    reasons: list[str]

    @property
    def passed(self) -> bool:
        return not self.reasons

    @property
    def support(self) -> int:
        """Assemblies with a contig here, each counted by its greatest weight."""
        most: dict[str, int] = {}
        for c in self.contigs:
            most[c.filename] = max(c.weight, most.get(c.filename, c.weight))
        return sum(most.values())


def whole_median(values: list[int]) -> int:
    v = sorted(values)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) // 2 if v else 0


def manual_nodes(text: str | None) -> list[int]:
    """Node numbers of a comma-separated list, sorted; blanks do not count."""
    parts = (text or "").replace(" ", "")
    try:
        return sorted(int(x) for x in parts.split(",")) if parts else []
    except ValueError:
        raise ValueError(f"{text!r} is not a list of node numbers") from None


def least_assemblies(contigs: list[Contig]) -> int:
    """1 for one assembly, else a quarter of them (halves up), 2 at least."""
    n = len({c.filename for c in contigs})
    return 1 if n <= 1 else max(2, (n + 2) // 4)


def check_contigs(contigs: list[Contig], most: float) -> None:
    """Too many contigs per assembly that has any are an error; so are no contigs."""
    if not contigs:
        raise ValueError("no contigs to cluster")
    mean = len(contigs) / len({c.filename for c in contigs})
    if mean > most:
        raise ValueError(f"{mean:.1f} contigs per assembly on average; at most {most} are allowed")


def containers(found: list[Cluster], distance: dict[tuple[int, int], float], cutoff: float) -> dict[int, list[Cluster]]:
    """By number of a cluster, those that contain it, in their order: most pairs lie nearer from inside
    to outside than back, and nearer than the cutoff."""
    home = {x.id: k for k, c in enumerate(found) for x in c.contigs}
    near = Counter((home[a], home[b]) for (a, b), d in distance.items() if d < cutoff and d < distance.get((b, a), 1.0) and a in home and b in home)
    out: dict[int, list[Cluster]] = {}
    for (i, o), n in sorted(near.items()):
        if i != o and 2 * n > len(found[i].contigs) * len(found[o].contigs):
            out.setdefault(found[i].number, []).append(found[o])
    return out


def judged(tree: Tree, nodes: list[int], contigs: list[Contig], distance: dict[tuple[int, int], float], cutoff: float, least: int, manual: list[int] = ()) -> list[Cluster]:
    """Clusters of the tree's nodes, numbered by median length downwards (ties: the lesser node
    first), each with its reasons to fail. Clusters picked by hand pass and all others fail;
    without such a pick, those with too few assemblies fail, and then, in the order of numbers,
    those contained in one that still passes. A trusted contig keeps its cluster."""
    own = {c.id: c for c in contigs}
    found = [Cluster(0, n, [own[t] for t in tree.tips(n)], tree.max_distance(n), []) for n in sorted(nodes)]
    found.sort(key=lambda c: -whole_median([x.length for x in c.contigs]))
    for i, c in enumerate(found, 1):
        c.number = i
        if manual and c.node not in manual:
            c.reasons.append("not included in manual clusters")
    if not manual:
        free = [c for c in found if not any(x.trusted for x in c.contigs)]
        for c in free:
            if c.support < least:
                c.reasons.append("present in too few assemblies")
        around = containers(found, distance, cutoff)
        for c in free:
            holder = next((o for o in around.get(c.number, ()) if o.passed), None)
            if holder:
                c.reasons.append(f"contained within cluster {holder.number}")
    return found


def scores(clusters: list[Cluster]) -> tuple[float, float, float]:
    """(balance, tightness, their mean) of a clustering."""
    files = {x.filename for c in clusters for x in c.contigs}
    total = sum(len(c.contigs) for c in clusters)
    once = lambda c: sum(n == 1 for n in Counter(x.filename for x in c.contigs).values())
    balance = sum(once(c) / len(files) * len(c.contigs) for c in clusters) / total
    good = [c for c in clusters if c.passed]
    size = sum(len(c.contigs) for c in good)
    tight = sum((1 - sqrt(c.distance)) * len(c.contigs) for c in good) / size if size else 0.0
    return balance, tight, (balance + tight) / 2


def tree_of(contigs: list[Contig], distance: dict[tuple[int, int], float]) -> Tree:
    """Tree over the greater distance of both directions, at most 0.5 high."""
    ids = sorted(c.id for c in contigs)
    own = set(ids)
    far = {(a, b): max(d, distance.get((b, a), 1.0)) for (a, b), d in distance.items() if a < b and a in own and b in own}
    tree = upgma(ids, far, missing=1.0)
    tree.normalise()
    return tree


def clustered(contigs: list[Contig], distance: dict[tuple[int, int], float], cutoff: float, least: int | None = None, manual: list[int] = ()) -> tuple[Tree, list[Cluster]]:
    """The tree, and the clusters: nodes picked by hand with the rest cut by distance, or a cut by
    distance that is refined by splits as long as the overall score rises."""
    least = least_assemblies(contigs) if least is None else least
    tree = tree_of(contigs, distance)
    if manual:
        tree.check_consistent(list(manual))
        nodes = tree.cut(cutoff, list(manual))
    else:
        score = lambda nodes: scores(judged(tree, nodes, contigs, distance, cutoff, least))[2]
        nodes = tree.refine(tree.cut(cutoff), score)
    tree.check_complete(nodes)
    return tree, judged(tree, nodes, contigs, distance, cutoff, least, manual)
