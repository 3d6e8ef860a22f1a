"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton enumerates all vocabulary pieces that end at each character; dynamic
programming carries the best score and the number of pieces of the best path, and no path. Ties
follow the tokenizers library's unigram model: at each end the candidates come by ascending start,
the unknown character last, and only a strictly better one replaces the one before, so the longest
piece wins. A character without a piece of its own may be unknown (least score less 10); it counts
as its UTF-8 bytes if the vocabulary has them, else a run of unknown characters counts as one.

No piece crosses from a word into the next word's blank mark, so texts fall into chunks whose best
paths are independent; with whole-number scores their sums are exact, and each distinct chunk is
counted once and remembered. Other vocabularies are counted over whole texts.

The box holds no unigram model. The vocabulary is that of the 32,000-piece model file, with its own
scores; what is counted are the pieces of the unigram tokenizer over it, not those of its merges.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tideweave.llm.common import annotate, table

BLANK, PENALTY, KNOWN_CHUNKS = "▁", 10.0, 1 << 17
_CHUNK = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
_CLEAN = re.compile(f"{BLANK}*[^{BLANK}]*")


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order of a model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())]


class PieceCounter:
    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - PENALTY
        names = {p for p, _ in pieces}
        self.has_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.by_chunk = all(_CLEAN.fullmatch(p) for p in names) and all(float(s).is_integer() for _, s in pieces)
        self.known = _Known(self)

    def best(self, text: str) -> int:
        """Pieces of the best path over text."""
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(text):  # at one end the longest comes first
            ending[end + 1].append(found)
        score, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for e in range(1, n + 1):
            top, k, alone, lost = None, 0, False, False
            for length, s in ending[e]:
                alone |= length == 1
                c = s + score[e - length]
                if top is None or c > top:
                    top, k = c, count[e - length] + 1
            if not alone:
                c = self.unknown + score[e - 1]
                if top is None or c > top:
                    lost = True
                    top, k = c, count[e - 1] + (len(text[e - 1].encode("utf-8", "surrogatepass")) if self.has_bytes else not unknown[e - 1])
            score[e], count[e], unknown[e] = top, k, lost
        return count[n]

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", BLANK)
        text = text if text[0] == BLANK else BLANK + text
        return sum(map(self.known.__getitem__, _CHUNK.findall(text))) if self.by_chunk else self.best(text)


class _Known(dict):
    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, chunk: str) -> int:
        if len(self) > KNOWN_CHUNKS:
            self.clear()
        value = self.counter.best(chunk)
        if len(chunk) < 64:
            self[chunk] = value
        return value


@lru_cache(2)
def _counter(model_path: str) -> PieceCounter:
    return PieceCounter(vocabulary(model_path))


def count_tokens(docs: DataFrame, text_col: str = "text", *, model_path: str | None = None) -> DataFrame:
    """Columns "row" (all of docs) and n_tokens, for every row of docs, over its whole text.

    Null and empty texts have 0 tokens; repeated rows get equal counts; no rows give no rows.
    """
    path = model_path or public_tokenizers.path("piece_bpe_32k.model")

    def judge():
        count = _counter(path)
        return lambda texts: [pa.array([count(t.as_py()) for t in texts], pa.int64())]

    return annotate(docs, text_col, judge, "n_tokens long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "n_tokens")
