"""Operator 9: token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at a place; the dynamic
program carries just the best score and its number of pieces. The tie rules are those of the
`tokenizers` library's unigram model, in which a later candidate must be strictly better and
candidates come in the order of their start: of equal paths the longest last piece wins.

No vocabulary piece has a blank mark after another character, so every segmentation has a cut
before each run of blank marks. Words are therefore scored one by one, and once per distinct
word in a task.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, table

#: The blank mark that stands for U+0020 and before the text.
BLANK = "\u2581"
#: Added to the lowest piece score for a character without a piece.
UNKNOWN_PENALTY = -10.0
#: Distinct words whose counts a task remembers.
CACHE = 400_000

_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


@lru_cache(maxsize=2)
def vocabulary(name: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of every id of a public sentencepiece vocabulary, in the order of ids."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    return tuple((sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size()))


class PieceCounter:
    """Counts the unigram pieces of a text. ``unknown`` is the id of the unknown piece; with
    byte pieces in the vocabulary an unknown character counts as its UTF-8 bytes, without them
    a run of unknown characters counts as one."""

    def __init__(self, pieces: tuple[tuple[str, float], ...], unknown: int = 0):
        self.automaton = ahocorasick.Automaton()
        score: dict[str, float] = {}
        for piece, s in pieces:
            score[piece] = s  # of repeated pieces the last one counts
        for piece, s in score.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), s))
        self.automaton.make_automaton()
        self.longest = max(1, *map(len, score))
        self.unknown_score = min(s for _, s in pieces) + UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in score for b in range(256))
        self.split = not any(BLANK in p.lstrip(BLANK) for p in score)
        self.cache: dict[str, int] = {}

    def _viterbi(self, text: str) -> int:
        """Pieces of the best segmentation. The last ``longest`` places are remembered, in a ring,
        each with its best score, its number of pieces and whether its last piece is unknown."""
        ring, n = self.longest + 1, len(text)
        best, count, run = [0.0] * ring, [0] * ring, [False] * ring
        matches = self.automaton.iter(text)  # by their ends, and of equal ends the longest first
        last, (size, s) = next(matches, (n, (0, 0.0)))
        for at in range(1, n + 1):
            top, start, unknown, single = None, -1, False, False
            while last == at - 1:
                begin = (at - size) % ring
                value = s + best[begin]
                if top is None or value > top:
                    top, start = value, begin
                single = size == 1
                last, (size, s) = next(matches, (n, (0, 0.0)))
            if not single:
                begin = (at - 1) % ring
                value = self.unknown_score + best[begin]
                if top is None or value > top:
                    top, start, unknown = value, begin, True
            here = at % ring
            if not unknown:
                count[here] = count[start] + 1
            elif self.bytes:
                count[here] = count[start] + len(text[at - 1].encode("utf-8", "surrogatepass"))
            else:
                count[here] = count[start] + (not run[start])
            best[here], run[here] = top, unknown
        return count[n % ring]

    def count(self, text: str) -> int:
        """Pieces of a text; blanks become blank marks and one mark goes before the text."""
        if not text:
            return 0
        marked = text.replace(" ", BLANK)
        if not marked.startswith(BLANK):
            marked = BLANK + marked
        if not self.split:
            return self._viterbi(marked)
        total, cache = 0, self.cache
        for found in _WORDS.finditer(marked):
            word = found[0]
            n = cache.get(word)
            if n is None:
                n = self._viterbi(word)
                if len(word) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(name: str) -> PieceCounter:
    return PieceCounter(vocabulary(name))


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_chars, n_tokens of every whole text, by the pieces and scores of ``model``.

    Nulls: a null or empty text has 0 tokens, a null doc_id stays null. Repeated rows give
    repeated results, an empty table none. Very long texts take time linear in their length, and
    memory for a few copies of the text, whether they have blanks or not. Other columns are not
    read.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        count = counter(model).count
        return {"doc_id": batch.column("doc_id"), "n_chars": [len(t or "") for t in texts], "n_tokens": [count(t or "") for t in texts]}

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id bigint, n_chars bigint, n_tokens bigint")


def op9_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document; see :func:`token_counts`."""
    return token_counts(table(spark, sf_dir, "documents"))
