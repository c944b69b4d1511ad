"""Read depths of unitigs: k-mers inside a unitig and, at its ends, those that run over links.

Spelling walks through a graph is done per graph; counting reads is a join (see ``reads``).
"""

from __future__ import annotations

from collections.abc import Iterator

from .seqgraph import SeqGraph, revcomp

#: Steps of the walks from one end at most.
MAX_STEPS = 10_000


def canonical(kmer: str) -> str:
    return min(kmer, revcomp(kmer))


def inner_kmers(seq: str, k: int) -> Iterator[str]:
    """Canonical k-mers in order, those with ambiguous letters left out."""
    for i in range(len(seq) - k + 1):
        if set(kmer := seq[i : i + k].upper()) <= set("ACGT"):
            yield canonical(kmer)


def walks(graph: SeqGraph, x: int, width: int) -> list[str]:
    """Sequences of up to ``width`` bases that follow unitig x, one per walk; a dead end is kept
    short, walks of equal sequence are all kept."""
    out, todo, steps = [], [(x, "")], 0
    while todo:
        at, spelled = todo.pop()
        after = graph.next.get(at, ())
        if len(spelled) >= width or not after or steps >= MAX_STEPS:
            out.append(spelled[:width])
            continue
        for y in reversed(after):
            steps += 1
            todo.append((y, spelled + graph.seq(y)[: width - len(spelled)]))
    return out


def junction_kmers(graph: SeqGraph, number: int, k: int) -> list[str]:
    """k-mers that begin inside a unitig and run off its end, on either strand; of the two
    spellings of a junction the canonical one counts, so it counts once."""
    out = []
    for x in (number, -number):
        tail = graph.seq(x)[-(k - 1) :] if k > 1 else ""
        for walk in walks(graph, x, k - 1):
            text = tail + walk
            out += [text[i : i + k] for i in range(min(len(tail), len(text) - k + 1)) if text[i : i + k] < revcomp(text[i : i + k])]
    return out


def assembly_kmers(graph: SeqGraph, k: int) -> Iterator[str]:
    """All k-mers of a graph with repetitions: inside unitigs and over links."""
    for n, tig in graph.tigs.items():
        yield from inner_kmers(tig.seq, k)
        yield from junction_kmers(graph, n, k)


def context_kmers(graph: SeqGraph, number: int, k: int) -> list[tuple[int, list[str]]]:
    """(offset, alternatives): k-mers that touch a unitig and reach beyond it, by where they
    begin (negative: before it). A long unitig's ends are looked at one by one; around a short
    one every walk before meets every walk after."""
    seq = graph.tigs[number].seq
    before = [revcomp(w) for w in walks(graph, -number, k - 1)] if graph.next.get(-number) else [""]
    after = walks(graph, number, k - 1) if graph.next.get(number) else [""]
    found: dict[int, dict[str, None]] = {}

    def add(left: str, right: str, body: str, shift: int) -> None:
        text = left + body + right
        for i in range(len(text) - k + 1):
            offset = i - len(left)
            crosses = (offset < 0 and i + k > len(left)) or (offset < len(body) and offset >= 0 and offset + k > len(body))
            if crosses and not (right == "" and offset >= 0) and not (left == "" and offset < 0):
                found.setdefault(offset + shift, {})[canonical(text[i : i + k])] = None

    if len(seq) >= k:
        head, tail = seq[: k - 1], seq[-(k - 1) :]
        for left in before:
            if left:
                add(left, "", head, 0)
        for right in after:
            if right:
                add("", right, tail, len(seq) - len(tail))
    else:
        for left in before:
            for right in after:
                add(left, right, seq, 0)
    return [(o, list(v)) for o, v in sorted(found.items())]


def tig_kmer_rows(graph: SeqGraph, k: int) -> Iterator[tuple[int, int, str]]:
    """(unitig, offset, k-mer) that depths are taken from."""
    for n, tig in graph.tigs.items():
        for i, kmer in enumerate(inner_kmers(tig.seq, k)):
            yield n, i, kmer
        for offset, kinds in context_kmers(graph, n, k):
            for kmer in kinds:
                yield n, offset, kmer
