"""Token ids of whole texts, many at once.

The tokenizer drops white space and never joins across it, so a text's ids are those of its space-separated chunks in a row. Arrow splits
the texts of a part into chunks and gives the distinct ones; of these, chunks of letters with marks behind them fall into words whose ids
a worker remembers, and the others are encoded as they are. NumPy puts the chunks' ids in the texts' order.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers

from sigloom.llm.util import cached_by, own_caches

#: Words that a Python worker remembers: those met since the last time that so many new ones came up, and those before.
CACHE_WORDS = 200_000
#: Bytes of text whose chunks are looked up together.
SOME_BYTES = 4_000_000
#: Words encoded by one call.
AT_ONCE = 1024
WORD_BPE = "word_bpe_49k.json"
#: Chunks of Latin letters, then ASCII punctuation without the apostrophe: normalising is lower-casing, and there are two pre-tokens.
PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:-@\[-`{-~]*)$"
_shared: dict[tuple[str, bool], "ChunkIds"] = {}


def byte_symbols() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def pieces_in_order(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of flat with these starts and sizes, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


@dataclass
class Encoded:
    words: pa.Array  # the distinct chunks
    which: np.ndarray  # of each chunk in turn, over all texts: its place among them
    per_text: np.ndarray  # chunks of each text
    ids: np.ndarray  # of all chunks in turn
    sizes: np.ndarray  # ids of each chunk in turn


class ChunkIds:
    """flows(texts): the ids of all texts in a row and where each text's end. With specials, the special tokens' strings are those tokens; without, ordinary text."""

    def __init__(self, path: str, specials: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        #: The same vocabulary for words whose normal form is known already.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.bare.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.symbols = byte_symbols() | {32: " "}
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """The ids of these words. Each is one pre-token, so its last id, and no other, ends a word."""
        found: dict[str, bytes] = {}
        for at in range(0, len(words), AT_ONCE):
            part = words[at : at + AT_ONCE]
            flow = " ".join(part).encode().decode("latin-1").translate(self.symbols)
            ids = np.array(self.bare.encode_batch_fast([flow], add_special_tokens=False)[0].ids, dtype="<u4")
            stops, body = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes()
            found.update(zip(part, map(body.__getitem__, map(slice, [0, *stops], stops))))
        return found

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each of these distinct words, in bytes."""
        bodies = list(map(self.new.get, words))
        met = self.old.get
        again = {w: b for w in (w for w, x in zip(words, bodies) if x is None) if (b := met(w)) is not None}
        fresh = again | self._learn([w for w, x in zip(words, bodies) if x is None and w not in again])
        if len(self.new) + len(fresh) > CACHE_WORDS:
            self.old, self.new = self.new, {"": b""}
        self.new.update(fresh)
        return [fresh[w] if b is None else b for w, b in zip(words, bodies)]

    def _chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and the number of them, of each chunk of a distinct lot."""
        found = pc.extract_regex(chunks, pattern=PLAIN)
        words = pa.chunked_array([pc.utf8_lower(found.field("letters")), found.field("marks")]).dictionary_encode().unify_dictionaries()
        bodies = self._words(words.chunk(0).dictionary.to_numpy(zero_copy_only=False).tolist())
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        others = [self.tokenizer.encode(c, add_special_tokens=False).ids for c in chunks.filter(pa.array(~plain)).to_pylist()]
        sizes = np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies)) // 4
        place = np.cumsum(sizes) - sizes
        letters, marks = (words.chunk(i).indices.fill_null(0).to_numpy() for i in (0, 1))
        # Each chunk's ids: its letters' and its marks', or those of its own encoding, behind all the words'.
        own = np.array([len(x) for x in others], dtype=np.int64)
        starts, counts = np.stack([place[letters], place[marks]], axis=1), np.stack([sizes[letters], sizes[marks]], axis=1)
        starts[~plain, 0], counts[~plain, 0], counts[~plain, 1] = sizes.sum() + np.cumsum(own) - own, own, 0
        flat = np.concatenate([np.frombuffer(b"".join(bodies), dtype="<u4"), np.array([i for x in others for i in x], dtype="<u4")])
        every = pieces_in_order(flat, starts.reshape(-1), counts.reshape(-1))
        n = counts.sum(axis=1)
        return every, np.cumsum(n) - n, n

    def encoded(self, texts: pa.Array) -> Encoded:
        """The chunks of all texts and their ids; texts are UTF-8, a null one has none."""
        chunks = pc.ascii_split_whitespace(texts.cast(pa.binary()).fill_null(b"").cast(pa.string()))
        coded = chunks.flatten()
        kept = pc.not_equal(pc.binary_length(coded), 0)
        per_text = np.diff(np.append(0, np.cumsum(kept.to_numpy(zero_copy_only=False))[np.cumsum(pc.list_value_length(chunks).to_numpy()) - 1] if len(texts) else []))
        coded = coded.filter(kept).dictionary_encode()
        if not len(coded):
            return Encoded(coded.dictionary, np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64), np.empty(0, dtype="<u4"), np.empty(0, dtype=np.int64))
        flat, starts, sizes = self._chunks(coded.dictionary)
        which = coded.indices.to_numpy()
        return Encoded(coded.dictionary, which, per_text.astype(np.int64), pieces_in_order(flat, starts[which], sizes[which]), sizes[which])

    def flows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each text has."""
        found = self.encoded(texts)
        return found.ids, np.diff(np.append(0, np.cumsum(found.sizes))[np.append(0, np.cumsum(found.per_text))])

    def ids_of(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        flat, sizes = self.flows(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        body, ends = flat.tobytes(), (np.cumsum(sizes) * 4).tolist()
        return list(map(body.__getitem__, map(slice, [0, *ends], ends)))


def forget() -> None:
    for ids in _shared.values():
        ids.new, ids.old = {"": b""}, {}


cached_by("tokens", forget)


def chunk_ids(name: str = WORD_BPE, specials: bool = False) -> ChunkIds:
    """One per worker process, vocabulary and treatment of special tokens, kept across tasks."""
    own_caches("tokens")
    if (name, specials) not in _shared:
        _shared[name, specials] = ChunkIds(public_tokenizers.path(name), specials)
    return _shared[name, specials]
