"""Encoding columns of texts with a public tokenizer file.

Texts are cut into chunks where the tokenizer's own pre-tokens must end: before white space, and between a letter and a
full stop or comma that ends a run. A block of texts is cut and its chunks are numbered by Arrow kernels, so a chunk is
looked up once for a block; the ids of chunks stay in a table for later blocks, and new chunks are encoded as one batch.
Texts with unusual characters are encoded whole, as are all texts of a tokenizer whose cutting rule isn't known here. Ids
are the same as those of the tokenizers library for the whole text.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a block of texts that is encoded at a time (a longer text is a block of its own).
BLOCK = 8_000_000
#: Chunks whose ids a Python worker keeps, some 30 bytes each.
CACHE = 1_000_000
#: Cuts chunks; texts that have it themselves are encoded whole.
CUT = "\x1f"
#: White space other than blank, tab, line feed and carriage return, on which regular expression engines disagree.
UNUSUAL = r"[\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
#: Outside of these, composed forms or lower case may differ between libraries: Latin, Cyrillic, punctuation, CJK, symbols.
BEYOND = r"[^\x00-\x{12f}\x{131}-\x{24f}\x{400}-\x{45f}\x{2010}-\x{205e}\x{20a0}-\x{20bf}\x{3001}-\x{3029}\x{3030}-\x{3098}\x{309b}-\x{9fff}\x{1f300}-\x{1faff}]"
LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{410}-\x{44f}"
SPACE = r"[ \n\t\r]+"
#: A chunk that is one pre-token of either kind.
WORD = rf"^ ?[{LETTERS}]+$"


def _gather(ids: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids[at[k]:at[k + 1]] for each k of which, one after another, and where each begins."""
    lengths = (at[1:] - at[:-1])[which]
    upto = np.zeros(len(which) + 1, "int32")
    np.cumsum(lengths, out=upto[1:])
    return ids[np.repeat(at[:-1][which] - upto[:-1], lengths) + np.arange(upto[-1], dtype="int32")], upto


class Encoder:
    """encode_column(texts) gives the ids of all texts, one after another, and where each text's begin."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        self.size = self.tokenizer.get_vocab_size()
        with open(path) as f:
            kind = json.load(f)
        pre, norm = kind.get("pre_tokenizer") or {}, kind.get("normalizer")
        self.known, self.lower = False, False
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.known = True
        elif pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and [n["type"] for n in (norm or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.known = self.lower = True
        self.as_bytes = str.maketrans(dict(zip(map(chr, range(256)), _byte_letters(), strict=True)))
        self.chunks = pa.array([], pa.string())
        self.at, self.ids = np.zeros(1, "int32"), np.empty(0, "uint32")  # chunk k has ids[at[k]:at[k + 1]]

    def encode(self, text: str) -> bytes:
        """The ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_column(pa.array([text], pa.string()))[0].astype("<u4").tobytes()

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        found, counts, a = [np.empty(0, "uint32")], [np.empty(0, "int64")], 0
        while a < len(texts):
            z = max(a + 1, int(np.searchsorted(upto, upto[a] + BLOCK, "right")) - 1)
            ids, n = self._block(texts.slice(a, z - a))
            found.append(ids)
            counts.append(n)
            a = z
        return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype("int64")

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if not self.known:
            odd = np.ones(len(texts), bool)
        else:
            odd = pc.match_substring_regex(texts, UNUSUAL).to_numpy(zero_copy_only=False)
            if self.lower:
                odd = odd | pc.match_substring_regex(texts, BEYOND).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._chunked(texts)
        ids, n = self._chunked(texts.filter(pa.array(~odd)))
        whole = [np.array(x.ids, "uint32") for x in self.tokenizer.encode_batch_fast(texts.filter(pa.array(odd)).to_pylist(), add_special_tokens=False)]
        counts = np.zeros(len(texts), "int64")
        counts[~odd], counts[odd] = n, list(map(len, whole))
        of_odd = np.repeat(odd, counts)
        out = np.empty(len(of_odd), "uint32")
        out[~of_odd], out[of_odd] = ids, np.concatenate(whole)
        return out, counts

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.lower:
            cut = pc.replace_substring_regex(pc.utf8_lower(texts), SPACE, CUT)
        elif pc.any(pc.match_substring_regex(texts, r"[\t\r]|[ \n]{2}")).as_py():
            cut = pc.replace_substring_regex(texts, SPACE, rf"{CUT}\0")
        else:  # a line feed alone is a pre-token
            cut = pc.replace_substring(pc.replace_substring(texts, " ", f"{CUT} "), "\n", f"{CUT}\n{CUT}")
        cut = pc.replace_substring_regex(cut, rf"([{LETTERS}])([.,]){CUT}", rf"\1{CUT}\2{CUT}")
        lists = pc.split_pattern(cut, CUT)
        coded = lists.flatten().dictionary_encode()
        places = self._places(coded.dictionary)
        ids, upto = _gather(self.ids, self.at, places[coded.indices.to_numpy()])
        return ids, np.diff(upto[lists.offsets.to_numpy()])

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """The places in the table of distinct chunks, new ones added."""
        met = pc.index_in(self.chunks, value_set=chunks)  # probes are cheaper than a hash table of all that is kept
        have = pc.is_valid(met).to_numpy(zero_copy_only=False)
        if len(self.chunks) + len(chunks) > CACHE:  # what this block doesn't use goes
            self.chunks, met = self.chunks.filter(pa.array(have)), met.drop_null()
            self.ids, self.at = _gather(self.ids, self.at, np.flatnonzero(have))
            have = np.ones(len(met), bool)
        at = np.full(len(chunks), -1)
        at[met.drop_null().to_numpy()] = np.flatnonzero(have)
        new = at < 0
        if new.any():
            at[new] = np.arange(len(self.chunks), len(self.chunks) + new.sum())
            added = chunks.filter(pa.array(new))
            self.chunks = pa.concat_arrays([self.chunks, added])
            lists = self._encoded(added)
            self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(lists), "uint32")])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(list(map(len, lists)), dtype="int32")])
        return at

    def _encoded(self, chunks: pa.Array) -> list[list[int]]:
        """Single pre-tokens go to the tokenizer's model as they are, the rest through all its steps."""
        single = pc.match_substring_regex(chunks, WORD)
        model, letters = self.tokenizer.model.tokenize, self.as_bytes
        words = iter([[t.id for t in model(w.encode().decode("latin-1").translate(letters))] for w in chunks.filter(single).to_pylist()])
        rest = iter([x.ids for x in self.tokenizer.encode_batch_fast(chunks.filter(pc.invert(single)).to_pylist(), add_special_tokens=False)])
        return [next(words) if one else next(rest) for one in single.to_pylist()]


def _byte_letters() -> list[str]:
    """The characters by which byte-level vocabularies write bytes: printable ones are themselves, the others come in order
    from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = itertools.count(0x100)
    return [chr(b if b in plain else next(others)) for b in range(256)]


class PieceEncoder(Encoder):
    """The same for a sentencepiece file that adds a blank in front of a text and in whose pieces the blank's mark comes before
    all else, so that a blank after another character begins a piece. Texts are cut there; the blank that a cut takes away
    is the one that the model adds to a chunk."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.blank = self.model.piece_to_id("\u2581")
        every = [self.model.id_to_piece(i) for i in range(self.size)]
        self.known = self.blank != self.model.unk_id() and not any("\u2581" in p.lstrip("\u2581") or CUT in p.strip(CUT) for p in every)
        self.chunks = pa.array([], pa.string())
        self.at, self.ids = np.zeros(1, "int32"), np.empty(0, "uint32")

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.known or pc.any(pc.match_substring(texts, CUT)).as_py():
            lists = self.model.encode(texts.to_pylist(), num_threads=1)
            return np.fromiter(itertools.chain.from_iterable(lists), "uint32"), np.array(list(map(len, lists)), "int64")
        lists = pc.split_pattern(pc.replace_substring_regex(texts, "([^ ]) ", rf"\1{CUT}"), CUT)
        n = np.where(pc.equal(texts, "").to_numpy(zero_copy_only=False), 0, np.diff(lists.offsets.to_numpy()))  # an empty text has no chunk
        chunks = lists.flatten().filter(pa.array(np.repeat(n > 0, np.diff(lists.offsets.to_numpy()))))
        coded = chunks.dictionary_encode()
        places = self._places(coded.dictionary)
        ids, upto = _gather(self.ids, self.at, places[coded.indices.to_numpy()])
        return ids, np.diff(upto[np.concatenate([[0], np.cumsum(n)])])

    def _encoded(self, chunks: pa.Array) -> list[list[int]]:
        """An empty chunk is the blank at the end of a text."""
        every = chunks.to_pylist()
        return [ids if c else [self.blank] for c, ids in zip(every, self.model.encode(every, num_threads=1), strict=True)]


@functools.cache
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's ids followed by the end token."""
    after = at + np.arange(len(at))
    out = np.empty(len(ids) + len(at) - 1, "uint32")
    ends = np.zeros(len(out), bool)
    ends[after[1:] - 1] = True
    out[ends], out[~ends] = end_id, ids
    return out, after
