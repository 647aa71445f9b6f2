"""Token counts by trie-shared dynamic programming.

Texts are cut into pre-tokens (words, with the vocabulary's word mark in front).  Distinct
pre-tokens go into a trie in sorted order; the unigram forward score of a node (best sum of
piece scores over all segmentations of the prefix) is computed once for all pre-tokens that
share the prefix, and each terminal stores the token count of its best segmentation.  A
text's count is the sum over its words.

The public vocabulary is a merge list without unigram probabilities, so a piece's score
follows Zipf's law of its rank: -log(rank + OFFSET).  Characters without a piece fall back
to their UTF-8 bytes, a token each, at a score below every piece's.

One pass, no shuffle.  Terminal counts are remembered by word hash up to ``CACHED_WORDS``,
then forgotten and computed again as needed: memory is bounded, counts are whole.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytesops as B

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "piece_bpe_32k.model"
OFFSET = 2.7
MARK = "▁"
CACHED_WORDS = 500_000


def piece_scores(path: str) -> dict[str, float]:
    """Scores of the normal pieces of a SentencePiece vocabulary by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(rank + OFFSET) for rank, i in enumerate(ids)}


class Pieces:
    """Which pieces end at a character: states of an Aho-Corasick automaton, made as they are met."""

    def __init__(self, scores: Mapping[str, float]):
        self.scores = scores
        self.prefixes = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        self.fallback = min(scores.values(), default=0.0) - 10.0
        self.steps: dict[str, tuple[str, tuple[tuple[int, float], ...]]] = {}

    def step(self, state: str, char: str) -> tuple[str, tuple[tuple[int, float], ...]]:
        """The longest suffix that begins a piece, and (length, score) of all pieces that end here."""
        read = state + char
        found = self.steps.get(read)
        if found is None:
            after = read
            while after and after not in self.prefixes:
                after = after[1:]
            ends = tuple((len(after) - i, self.scores[after[i:]]) for i in range(len(after)) if after[i:] in self.scores)
            found = self.steps[read] = (after, ends)
        return found


class Trie:
    """Forward scores along the current path of a trie that is walked in sorted order.

    A node holds (score, -tokens, -byte tokens) of its best segmentation: the highest score,
    of equal ones the fewest tokens, then the fewest byte tokens.  Nodes off the path are
    finished, so only their terminals' counts are kept.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.path = ""
        self.nodes: list[tuple[float, int, int]] = [(0.0, 0, 0)]
        self.states = [""]

    def count(self, pretoken: str) -> tuple[int, int]:
        """(tokens, byte tokens) of a pre-token; cheap if it shares a prefix with the one before."""
        shared, most = 0, min(len(pretoken), len(self.path))
        while shared < most and pretoken[shared] == self.path[shared]:
            shared += 1
        nodes, states, step = self.nodes, self.states, self.pieces.step
        del nodes[shared + 1 :], states[shared + 1 :]
        state = states[-1]
        for at in range(shared, len(pretoken)):
            char = pretoken[at]
            state, ends = step(state, char)
            best = None
            for size, score in ends:
                s, n, b = nodes[at + 1 - size]
                this = (s + score, n - 1, b)
                if best is None or this > best:
                    best = this
            if best is None or best[0] < nodes[at][0] + self.pieces.fallback:
                size = len(char.encode("utf-8", "surrogatepass"))
                s, n, b = nodes[at]
                this = (s + size * self.pieces.fallback, n - size, b - size)
                if best is None or this > best:
                    best = this
            nodes.append(best)
            states.append(state)
        self.path = pretoken
        return -nodes[-1][1], -nodes[-1][2]

    def counts(self, pretokens: Iterable[str]) -> dict[str, tuple[int, int]]:
        """Terminal counts of distinct pre-tokens."""
        return {p: self.count(p) for p in sorted(pretokens)}


class Counter:
    def __init__(self, scores: Mapping[str, float]):
        self.pieces = Pieces(scores)
        self.known: dict[int, tuple[int, int]] = {}

    def chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, tokens, byte tokens) of each text of a chunk."""
        starts, ends, first = B.words(data, off)
        hashes = B.span_hash(B.prefix_hash(data), starts, ends)
        unique, at, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
            self.pieces.steps.clear()
        names = unique.tolist()
        new = [i for i, h in enumerate(names) if h not in self.known]
        if new:
            raw = data.tobytes()
            texts = [MARK + raw[starts[at[i]] : ends[at[i]]].decode("utf-8", "replace") for i in new]
            counted = Trie(self.pieces).counts(texts)
            self.known.update((names[i], counted[t]) for i, t in zip(new, texts, strict=True))
        per = np.array([self.known[h] for h in names], np.int64).reshape(-1, 2)[back]
        total = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(per, axis=0)])
        tokens = total[first[1:]] - total[first[:-1]]
        return np.diff(first), tokens[:, 0], tokens[:, 1]


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(piece_scores(path))


def count(docs: DataFrame, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_byte_tokens) for each row; n_byte_tokens are part of n_tokens.

    Whole texts are counted; null, empty and blank ones have 0 of each.  Repeated rows each
    get their row; columns other than doc_id and text are not read.
    """
    path = f"{tokenizers}/{vocabulary}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            parts = [counter.chunk(data, off) for _, _, data, off in B.chunks(batch.column("text"))]
            columns = [pa.array(np.concatenate(p) if p else [], pa.int64()) for p in (zip(*parts, strict=True) if parts else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_tokens", "n_byte_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_byte_tokens long")
