"""Token counts under a unigram vocabulary, by trie-shared dynamic programming.

A text is split into pre-tokens at white space. The number of tokens of a
pre-token is the length of its best segmentation: the one with the highest sum
of piece scores, of equal ones the one with fewer pieces. The distinct pre-tokens
that a task has not seen yet are put in a trie (sorted, so that the trie is
walked depth first by comparing neighbours) and the forward scores of a prefix
are computed once for all pre-tokens that begin with it; the count at a
pre-token's terminal is stored and reused for later texts of the task.

The vocabulary is a public sentencepiece file, given by path. Its pieces are
ranked by merge order; a piece of rank r scores -log(r + 2) - ``PIECE_COST``, as
Zipf's law has it. A character outside the vocabulary costs its UTF-8 bytes, each
as one byte token.

Cases: a null, empty or blank text has no pre-token and 0 tokens. Repeated rows
are counted alike. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_COST = 4.0
BYTE_SCORE = -20.0
WORD_MARK = "▁"
#: Pre-tokens whose counts a Python worker keeps; past it the store starts anew.
MOST_STORED = 200_000


@functools.cache
def vocabulary(path: str) -> tuple[dict[str, float], int]:
    """Scores of the ordinary pieces of a sentencepiece model and the length of the longest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scores = {p: -math.log(r + 2) - PIECE_COST for r, p in enumerate(pieces)}
    return scores, max(map(len, scores), default=1)


def extend(prefix: str, scores: dict[str, float], longest: int, best: list[tuple[float, int]]) -> tuple[float, int]:
    """The forward score and token count of ``prefix``, given those of all its own prefixes."""
    end = len(prefix)
    found = (-math.inf, 0)
    for start in range(max(0, end - longest), end):
        score = scores.get(prefix[start:end])
        if score is not None:
            total, count = best[start]
            found = max(found, (total + score, count - 1))
    size = len(prefix[-1].encode("utf-8", "surrogatepass"))
    return max(found, (best[end - 1][0] + size * BYTE_SCORE, best[end - 1][1] - size))


def terminal_counts(words: list[str], scores: dict[str, float], longest: int) -> dict[str, int]:
    """Tokens of each word; forward scores are computed once per shared prefix."""
    out: dict[str, int] = {}
    before, best = "", [(0.0, 0)]  # counts are kept negative, so that max() prefers fewer pieces
    for word in sorted(words):
        marked = WORD_MARK + word
        shared = 0
        most = min(len(before), len(marked))
        while shared < most and before[shared] == marked[shared]:
            shared += 1
        del best[shared + 1 :]
        for end in range(shared + 1, len(marked) + 1):
            best.append(extend(marked[:end] if end <= 4 * longest else marked[end - 4 * longest : end], scores, longest, best if end <= 4 * longest else _Shifted(best, end - 4 * longest)))
        out[word] = -best[-1][1]
        before = marked
    return out


class _Shifted:
    """A view of the forward scores from a later place, for very long words."""

    def __init__(self, best: list[tuple[float, int]], by: int) -> None:
        self.best, self.by = best, by

    def __getitem__(self, i: int) -> tuple[float, int]:
        return self.best[self.by + i]


_stored: dict[tuple[str], dict[str, int]] = {}


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with n_pretokens and n_tokens for every row of ``docs``."""
    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, longest = vocabulary(vocabulary_path)
        known = _stored.setdefault((vocabulary_path,), {})
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            n_words, n_tokens = [], []
            for at in range(0, len(texts), 500):
                held = [Counter((t or "").split()) for t in texts[at : at + 500]]
                if len(known) > MOST_STORED:
                    known.clear()
                new = {w for c in held for w in c if w not in known}
                known.update(terminal_counts(list(new), scores, longest))
                n_words += [c.total() for c in held]
                n_tokens += [sum(known[w] * n for w, n in c.items()) for c in held]
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=[*keep, "n_pretokens", "n_tokens"])

    return source.mapInArrow(count, f"{schema}, n_pretokens long, n_tokens long")
