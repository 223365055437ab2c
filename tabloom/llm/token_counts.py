"""Token counts under a unigram vocabulary.

A unigram tokenizer cuts a text so that the scores of its pieces add up to the most. The best score of
a prefix depends on the prefix alone, so the distinct pre-tokens go into a trie and every trie node
keeps the forward score and the number of tokens of its prefix: words that begin alike share that
work, and the node where a pre-token ends holds its count. Pieces never cross from a word into the
blank behind it, nor contain a line feed, so counts of pre-tokens add up to the count of the text.

Documents never shuffle. A task keeps one trie of bounded size and drops it when it is full; pre-tokens
of more than ``LONG_WORD`` characters run through the same recurrence with a sliding window instead of
being stored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import map_batches, type_of

# Nodes of a task's trie, and words whose counts it remembers, before it starts anew.
MAX_NODES = 250_000
LONG_WORD = 256
BLANK = "▁"
PRE_TOKEN = re.compile(rf"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with their scores. A character that no piece covers falls back to its UTF-8 bytes, each at ``unknown``."""

    scores: dict[str, float]
    endings: dict  # trie of the pieces read backwards; "" holds a piece's score
    longest: int
    unknown: float


def vocabulary(scores: dict[str, float]) -> Vocabulary:
    if any(re.search(rf"[^{BLANK}]{BLANK}|\n", piece) for piece in scores):
        raise ValueError("a piece crosses a blank or a line end; texts cannot be cut there")
    endings: dict = {}
    for piece, score in scores.items():
        node = endings
        for c in reversed(piece):
            node = node.setdefault(c, {})
        node[""] = score
    return Vocabulary(scores, endings, max(map(len, scores), default=1), min(scores.values(), default=0.0) - 10.0)


def read_pieces(path: str) -> Vocabulary:
    """Normal pieces of a sentencepiece model file with the scores that it holds."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = [
        i
        for i in range(model.vocab_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    return vocabulary({model.id_to_piece(i): model.get_score(i) for i in normal})


def _step(word: str, end: int, best: list[float], tokens: list[int], vocab: Vocabulary) -> None:
    """Appends the best score and the fewest tokens of ``word[:end]``; the last entries belong to the prefixes before."""
    top, least = float("-inf"), 0
    node = vocab.endings
    for n in range(1, end + 1):
        node = node.get(word[end - n])
        if node is None:
            break
        gain = node.get("")
        if gain is not None:
            score = best[-n] + gain
            if score > top or (score == top and tokens[-n] + 1 < least):
                top, least = score, tokens[-n] + 1
    last = word[end - 1]
    if last not in vocab.scores and best[-1] + vocab.unknown > top:
        top, least = best[-1] + vocab.unknown, tokens[-1] + len(last.encode())
    best.append(top)
    tokens.append(least)


class ForwardTrie:
    """Trie of pre-tokens with forward scores at its nodes and counts at the ends of pre-tokens."""

    def __init__(self, vocab: Vocabulary, max_nodes: int = MAX_NODES):
        self.vocab, self.max_nodes = vocab, max_nodes
        self._clear()

    def _clear(self) -> None:
        self.child: list[dict[str, int] | None] = [None]
        self.best: list[float] = [0.0]
        self.fewest: list[int] = [0]
        self.ends: dict[str, int] = {}

    def count(self, word: str) -> int:
        found = self.ends.get(word)
        if found is not None:
            return found
        if len(word) > LONG_WORD:
            return self._sliding(word)
        if len(self.best) + len(word) > self.max_nodes:
            self._clear()
        child, node, best, fewest = self.child, 0, [0.0], [0]
        for end, c in enumerate(word, 1):
            below = child[node].get(c) if child[node] else None
            if below is not None:
                best.append(self.best[below])
                fewest.append(self.fewest[below])
            else:
                _step(word, end, best, fewest, self.vocab)
                below = len(child)
                child.append(None)
                self.best.append(best[-1])
                self.fewest.append(fewest[-1])
                if child[node] is None:
                    child[node] = {}
                child[node][c] = below
            node = below
        self.ends[word] = fewest[-1]
        return fewest[-1]

    def _sliding(self, word: str) -> int:
        """The same recurrence, keeping only as many prefixes as a piece can reach back."""
        best, fewest = [0.0], [0]
        for end in range(1, len(word) + 1):
            _step(word, end, best, fewest, self.vocab)
            if len(best) > 8 * self.vocab.longest:
                del best[: -self.vocab.longest], fewest[: -self.vocab.longest]
        return fewest[-1]

    def tokens(self, text: str) -> tuple[int, int]:
        """Tokens and pre-tokens of a text."""
        if not text:
            return 0, 0
        parts = PRE_TOKEN.findall(BLANK + text.replace(" ", BLANK))
        ends, count = self.ends.get, self.count
        total = 0
        for p in parts:
            n = ends(p)
            total += count(p) if n is None else n
        return total, len(parts)


def token_counts(docs: DataFrame, vocab: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, n_pretokens (long).

    As in sentencepiece, a text starts with one blank of its own, and blanks and U+2581 are the same.
    Among equally good cuts the one with the fewest tokens counts. Null and empty texts have 0
    tokens; a null or repeated doc_id is passed on as it is; other columns are not read; an empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # one entry per piece of the vocabulary

    def start():
        trie = ForwardTrie(shared.value)

        def each(batch):
            counted = [trie.tokens(t or "") for t in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "n_tokens": [c[0] for c in counted], "n_pretokens": [c[1] for c in counted]}

        return each

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_batches(picked, f"doc_id {type_of(picked, 'doc_id')}, n_tokens long, n_pretokens long", start)
