"""Token counts under a unigram model, by dynamic programming over a trie.

A text's pre-tokens are its words, each after a word mark. The distinct new ones of some texts form a trie that is
walked depth first, in sorted order: a node's forward score, the best sum of piece scores up to it, and the number of
pieces on that path are worked out once for all words below it. Counts of whole words are kept for later texts, so a
document's count is a sum of look-ups. Nothing is shuffled.

The vocabulary is a public sentencepiece file. It ranks its pieces but has no probabilities: a piece of rank r gets
log(1 / (r + 1)), as by Zipf's law, in whole millionths so that ties are exact; the better of equal scores has fewer
pieces. Characters that no piece covers fall back to one token a byte.

Defined results
* null text counts as empty and has no tokens;
* repeated rows are counted one by one, an empty table gives an empty result;
* columns other than the id and the text aren't carried along.
"""

from __future__ import annotations

import functools
import math
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import packed, text_of

MARK = "▁"
#: Words whose counts a Python worker keeps, and characters of text that are looked at together.
CACHE = 1_000_000
TOGETHER = 4_000_000


class Unigram:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        plain = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        self.scores = {p: round(-1e6 * math.log(r + 1)) for r, p in reversed(list(enumerate(plain)))}
        self.byte = round(-1e6 * math.log(len(plain) + 1))
        self.tails = {p[k:] for p in plain for k in range(len(p))}  # a longer tail isn't in a piece if a shorter isn't
        self.counts: dict[str, int] = {}

    def learn(self, words: list[str]) -> None:
        """Walks the trie of the words, given in sorted order, and keeps their counts."""
        scores, tails, byte = self.scores, self.tails, self.byte
        path, best, used = MARK, [0], [0]  # a score and a count for each prefix of path
        self._extend(path, best, used, scores, tails, byte)
        for w in words:
            word = MARK + w
            shared = len(os.path.commonprefix((path, word)))
            del best[shared + 1 :], used[shared + 1 :]
            path = word
            self._extend(path, best, used, scores, tails, byte)
            self.counts[w] = used[-1]

    @staticmethod
    def _extend(path, best, used, scores, tails, byte) -> None:
        for i in range(len(best), len(path) + 1):
            top, n = None, 0
            j = i - 1
            while j >= 0 and (tail := path[j:i]) in tails:
                s = scores.get(tail)
                if s is not None:
                    total, k = best[j] + s, used[j] + 1
                    if top is None or total > top or total == top and k < n:
                        top, n = total, k
                j -= 1
            if path[i - 1] not in scores:  # by bytes
                b = len(path[i - 1].encode("utf-8", "surrogatepass"))
                total, k = best[i - 1] + b * byte, used[i - 1] + b
                if top is None or total > top or total == top and k < n:
                    top, n = total, k
            best.append(top)
            used.append(n)

    def count(self, texts: list[list[str]]) -> list[int]:
        if len(self.counts) > CACHE:
            self.counts.clear()
        new = set().union(*texts).difference(self.counts)
        self.learn(sorted(new))
        return [sum(map(self.counts.__getitem__, words)) for words in texts]


@functools.cache
def unigram(path: str) -> Unigram:
    return Unigram(path)


def words_of(text: str) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]  # ASCII white space


def counted(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id under its own name, n_words and n_tokens."""
    t = packed(docs, _id=id_col, _text=text_of(text_col)).drop("_row")
    schema = T.StructType([T.StructField(id_col, t.schema["_id"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        model = unigram(vocabulary)
        for b in batches:
            words, tokens, some, size = [], [], [], 0
            for x in b.column(1):
                text = x.as_py()
                some.append(words_of(text))
                size += len(text)
                if size >= TOGETHER:
                    words += map(len, some)
                    tokens += model.count(some)
                    some, size = [], 0
            words += map(len, some)
            tokens += model.count(some)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[id_col, "n_words", "n_tokens"])

    return t.mapInArrow(run, schema)


QUERY = "op3_token_counts"
