"""Token counts of a unigram tokenizer without making the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at a character; the dynamic program
carries, by character, the best score and the number of tokens of the path that has it. Ties follow the
tokenizer: a path replaces another only if its score is higher, and starts come in ascending order, so of
equals the longest last piece wins. A character without a piece of its own may be unknown at the
lowest score less 10; with byte fallback it counts one token a byte, else a run of unknowns counts as one.

Text is cut only where no piece can span the cut (before a word mark that follows another character, and around line ends that no piece holds),
so counts are those of the whole text and words can be kept. Scores are rounded to multiples of 2^-16: sums are exact, in any order.

`zipf_scores` gives a ranked vocabulary the log-probabilities of Zipf's law, as public unigram files are rare: the counts then are those of a
unigram tokenizer with these scores, not of the tokenizer that the vocabulary was trained for.

Null and empty texts count 0; texts of any length are counted whole, in memory bounded by the longest piece beside the text. Any character counts,
U+0000 too. Repeated rows are counted each, an empty table gives an empty result, and other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels as K
from palimpsest.llm import piece_model as P
from palimpsest.session import prepare

MARK = "▁"
#: Distinct words that a worker keeps, in each of two generations; strings that are counted in step; text in hand at once.
KEPT, KEPT_CHARS, STEP_CHARS, TEXT_BYTES = 300_000, 32, 64, 2 << 20


class UnigramCounter:
    def __init__(self, pieces: Sequence[tuple[str, float]], byte_fallback: bool = True, unknown_penalty: float = 10.0):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (text, _) in enumerate(pieces):
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.sizes = np.array([len(t) for t, _ in pieces])
        self.scores = np.array([s for _, s in pieces])
        self.singles = {t for t, _ in pieces if len(t) == 1}
        self.unknown = float(self.scores.min()) - unknown_penalty
        self.byte_fallback = byte_fallback
        inner = any(re.search(f"[^{MARK}]{MARK}", t) for t, _ in pieces)
        #: Whether words, and lines, can be counted apart. A run of unknowns that counts as one could cross a cut.
        self.by_word = byte_fallback and not inner
        self.by_line = self.by_word and not any("\n" in t for t, _ in pieces)
        self.kept: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def tokens(self, strings: list[str]) -> np.ndarray:
        """Token counts of strings whose spaces are marks already: one dynamic program, in step over all of them."""
        out = np.zeros(len(strings), dtype=np.int64)
        apart = not self.byte_fallback  # runs of unknowns need the state that only the single walk carries
        long = [i for i, s in enumerate(strings) if len(s) > STEP_CHARS or apart and s or "\0" in s]  # U+0000 separates the others
        for i in long:
            out[i] = self.tokens_of_long(strings[i])
        short = [] if apart else [i for i, s in enumerate(strings) if 0 < len(s) <= STEP_CHARS and "\0" not in s]
        if not short:
            return out
        joined = "\0".join([strings[i] for i in short])
        lengths = np.array([len(strings[i]) for i in short])
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        found = list(self.automaton.iter(joined))
        end = np.fromiter((e for e, _ in found), np.int64, len(found)) + 1
        piece = np.fromiter((p for _, p in found), np.int64, len(found))
        word = np.searchsorted(starts, end - 1, side="right") - 1
        place, size = end - starts[word], self.sizes[piece]
        known = place <= lengths[word]  # none that holds the separator
        word, place, size, score = word[known], place[known], size[known], self.scores[piece[known]]
        rare = set(joined) - self.singles - {"\0"}
        strange = np.array([i for i, c in enumerate(joined) if c in rare], dtype=np.int64) if rare else np.zeros(0, np.int64)
        cost = np.array([len(joined[i].encode("utf-8", "surrogatepass")) for i in strange], dtype=np.int64)
        owner = np.searchsorted(starts, strange, side="right") - 1
        spot = strange - starts[owner] + 1
        n, most = len(short), int(lengths.max())
        best, count = np.full((most + 1, n), -np.inf), np.zeros((most + 1, n), dtype=np.int64)
        best[0] = 0.0
        order = np.lexsort((-size, place))  # of one end, the longest piece, that is the lowest start, first
        word, place, size, score = word[order], place[order], size[order], score[order]
        step = place * 1024 + (1023 - size)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(step)) + 1, [len(step)])) if len(step) else np.zeros(1, np.int64)
        groups: dict[int, list[tuple[int, int]]] = {}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            groups.setdefault(int(place[a]), []).append((a, b))
        by_spot = np.argsort(spot, kind="stable")
        owner, spot, cost = owner[by_spot], spot[by_spot], cost[by_spot]
        at = np.searchsorted(spot, np.arange(most + 2))
        for p in range(1, most + 1):
            for a, b in groups.get(p, ()):
                w, back = word[a:b], p - int(size[a])
                total = best[back, w] + score[a:b]
                better = total > best[p, w]
                best[p, w[better]] = total[better]
                count[p, w[better]] = count[back, w[better]] + 1
            a, b = at[p], at[p + 1]
            if b > a:
                w = owner[a:b]
                total = best[p - 1, w] + self.unknown
                better = total > best[p, w]
                best[p, w[better]] = total[better]
                count[p, w[better]] = count[p - 1, w[better]] + cost[a:b][better]
        out[short] = count[lengths, np.arange(n)]
        return out

    def tokens_of_long(self, s: str) -> int:
        """As tokens(), of one string of any length; memory is that of the longest piece. Runs of unknowns count as one without byte fallback."""
        ring = int(self.sizes.max()) + 1
        best, count, last_unknown = [0.0] * ring, [0] * ring, [False] * ring
        sizes, scores = self.sizes.tolist(), self.scores.tolist()
        found = self.automaton.iter(s)
        end, piece = next(found, (len(s), 0))
        for i, c in enumerate(s):
            top, tokens, unknown, here = -math.inf, 0, False, []
            while end == i:
                here.append((sizes[piece], scores[piece]))
                end, piece = next(found, (len(s), 0))
            for size, score in sorted(here, reverse=True):
                at = (i + 1 - size) % ring
                if (total := best[at] + score) > top:
                    top, tokens = total, count[at] + 1
            if c not in self.singles:
                at = i % ring
                if (total := best[at] + self.unknown) > top:
                    top, unknown = total, True
                    tokens = count[at] + (len(c.encode("utf-8", "surrogatepass")) if self.byte_fallback else not last_unknown[at])
            at = (i + 1) % ring
            best[at], count[at], last_unknown[at] = top, tokens, unknown
        return count[len(s) % ring]

    def parts(self, text: str) -> tuple[list[str], int]:
        """The strings whose counts add up to the text's, and the tokens that its cuts stand for."""
        if not text:
            return [], 0
        text = MARK + text.replace(" ", MARK)
        if not self.by_word:
            return [text], 0
        lines = text.split("\n") if self.by_line else [text]
        out = []
        for line in lines:
            if MARK + MARK in line or line.endswith(MARK):
                out += re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", line)
            else:
                first, *rest = line.split(MARK)
                out += [first, *[MARK + w for w in rest]] if first else [MARK + w for w in rest]
        return out, len(lines) - 1

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.parts(t) for t in texts]
        new = set().union(*(p for p, _ in cut)) - self.kept.keys()
        if self.older:
            again = new & self.older.keys()
            self.kept.update((w, self.older[w]) for w in again)
            new -= again
        words = list(new)
        once = dict(zip(words, self.tokens(words).tolist(), strict=True))
        known = self.kept
        known.update(once)
        out = [sum([known[w] for w in p]) + more for p, more in cut]
        for w in words:
            if len(w) > KEPT_CHARS:
                del known[w]
        if len(known) > KEPT:
            self.older, self.kept = known, {}
        return out


def zipf_scores(pieces: Sequence[tuple[str, float, int]]) -> list[tuple[str, float]]:
    """The ordinary pieces of a ranked vocabulary with log-probabilities by Zipf's law of their rank, in multiples of 2^-16."""
    plain = sorted(((-score, text) for text, score, kind in pieces if kind == P.NORMAL))
    total = math.log(sum(1 / (i + 1) for i in range(len(plain))))
    return [(text, round((-math.log(i + 1) - total) * 65536) / 65536) for i, (_, text) in enumerate(plain)]


@lru_cache(2)
def counter(model_path: str) -> UnigramCounter:
    """Of a piece vocabulary with byte fallback, scored by rank."""
    return UnigramCounter(zipf_scores(P.read_pieces(model_path)))


def count_tokens(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, n_tokens: one row a document."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            chars, tokens = [], []
            for c in K.chunks(batch.column(1), TEXT_BYTES):
                raw = c.bytes.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(c.offsets[:-1], c.offsets[1:], strict=True)]
                chars += map(len, texts)
                tokens += own.counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(chars, pa.int64()), pa.array(tokens, pa.int64())], names=["key", "n_chars", "n_tokens"])

    kept = docs.select(F.col(key).alias("key"), F.col(text).alias("__text"))
    return kept.mapInArrow(run, f"key {kept.dtypes[0][1]}, n_chars long, n_tokens long").withColumnRenamed("key", key)
