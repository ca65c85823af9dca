"""Exact, cached tokenizing of whole texts with public tokenizers.

Both tokenizers split a text into pre-tokens that never reach over the border between a visible
character and a following blank or line feed, so a text's ids are the ids of its chunks (cut at
those borders) one after another. Chunks repeat, so each worker keeps their ids; chunks of letters
with closing punctuation are put together from their two parts. What is missing is encoded by the
library, many pieces a call. Chunks of any other kind go to the library as they are, and texts with
other white space are not cached at all.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re

import numpy as np

from toolloom.llm import common

#: Letters whose lower case and NFC form are the same whatever stands around them.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")
#: The same for chunks with zero bytes between them; two empty parts for any other chunk.
_PARTS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)(?:\0|\Z)|[^\0]+(?:\0|\Z)")
_CHUNK = re.compile(r"(?<=\S)(?=[ \n])")
#: Entries that a worker keeps at most, of chunks and of their parts. Bounds memory, never results.
KEEP_CHUNKS, KEEP_WORDS = 600_000, 900_000
#: Longer chunks are encoded each time.
LONG = 48


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def version_digest(path: str) -> str:
    """Digest of what decides the ids: the vocabulary file and the library's version."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Encoder:
    """Chunk-cached encoder; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        ends = [i for token, i in vocab.items() if token.endswith("</w>")]
        #: Whether words end in marked ids; else words with their leading blank start with one.
        self.word_ends = len(ends) > 1000
        #: Width of packed ids in tables: 16 bits where all ids fit.
        self.width = "<u2" if max(vocab.values()) < 1 << 16 else "<u4"
        self.mark = np.zeros(max(vocab.values()) + 1, bool)
        self.mark[ends if self.word_ends else [i for token, i in vocab.items() if token.startswith("Ġ")]] = True
        #: Bytes of the ids of a line feed.
        self.line = 0 if self.word_ends else len(self._encode(["\n"])[0])
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        #: Share of the caches' bounds that is used: less memory, more calls of the library, the same ids.
        self.share = 1.0

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters (each with its leading blank where that counts), in one call."""
        if not words:
            return []
        ids = np.array(self.tok.encode_batch_fast([" ".join(words) if self.word_ends else "".join(words)], add_special_tokens=False)[0].ids, "<u4")
        marks = np.flatnonzero(self.mark[ids])
        cuts = marks + 1 if self.word_ends else np.append(marks[1:], len(ids))
        if len(marks) != len(words) or cuts[-1] != len(ids) or (not self.word_ends and marks[0] != 0):
            return self._encode(words)
        raw, cuts = ids.tobytes(), (cuts * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _fill(self, missing: list[str]) -> list[bytes]:
        """Ids of chunks that are not kept."""
        lead, words = "" if self.word_ends else " ", self.words
        joined = "\0".join(missing)
        pairs = _PARTS.findall(joined) if missing else []
        if joined.count("\0") != len(missing) - 1:  # a chunk holds the separator itself
            pairs = [m.groups("") if (m := _PLAIN.fullmatch(c)) else ("", "") for c in missing]
        keys = [lead + w if w else "" for w, _ in pairs]
        if self.word_ends:
            keys = [k.lower() for k in keys]
        need = dict.fromkeys(k for k in keys if k and k not in words)
        words.update(zip(need, self._encode_words(list(need)), strict=True))
        for tail in {t for _, t in pairs if t and t not in words}:
            words[tail] = self._encode([tail])[0]
        words[""] = b""
        whole = [i for i, k in enumerate(keys) if not k]
        out = [words[k] + words[t] for k, (_, t) in zip(keys, pairs, strict=True)]
        for i, x in zip(whole, self._encode([c if self.word_ends or c[0] == "\n" else lead + c for c in map(missing.__getitem__, whole)]), strict=True):
            out[i] = x
        if len(self.words) > KEEP_WORDS * self.share:  # what was met first is what is frequent
            for x in need:
                del self.words[x]
        return out

    def _split(self, text: str) -> list[str] | None:
        """Chunks at blanks and line feeds, where these are all the white space and stand alone; else None.

        Where words have leading blanks, a line feed goes with what follows; the first chunk gets one more.
        """
        chunks = text.split()
        n = text.count(" ") + text.count("\n")
        if len(chunks) != n + 1 or sum(map(len, chunks)) + n != len(text):
            return None
        return chunks if self.word_ends else f"\n{text}".replace("\n", " \n").split(" ")[1:]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        kept, rows, missing, rest, n = self.chunks, [], {}, [], 0
        for i, text in enumerate(texts):
            if (chunks := self._split(text)) is None:
                rows.append(None)
                rest.append(i)
                continue
            got = list(map(kept.get, chunks))
            n += len(got)
            if None in got:
                for c, x in zip(chunks, got, strict=True):
                    if x is None:
                        missing[c] = None
                rows.append((chunks, got))
            else:
                rows.append(got)
        found = dict(zip(missing, self._fill(list(missing)), strict=True))
        out = []
        for row in rows:
            if type(row) is tuple:
                row = [found[c] if x is None else x for c, x in zip(*row, strict=True)]
            out.append(b"" if row is None else b"".join(row) if self.word_ends else b"".join(row)[self.line :])
        if rest:
            spans = [_CHUNK.split(texts[i]) for i in rest]
            ids = iter(self._encode([c for x in spans for c in x]))
            for i, x in zip(rest, spans, strict=True):
                out[i] = b"".join(next(ids) for _ in x)
        if len(kept) > KEEP_CHUNKS * self.share and len(found) > 0.3 * n:  # the texts have changed
            kept.clear()
            self.words.clear()
        elif len(kept) <= KEEP_CHUNKS * self.share:
            kept.update((c, x) for c, x in found.items() if len(c) <= LONG)
        return out

    def packed(self, ids: bytes, end: bytes) -> bytes:
        """32-bit ids and the end id, in the width of tables."""
        return np.frombuffer(ids + end, "<u4").astype(self.width).tobytes()


def id_width(path: str) -> str:
    """Numpy type of packed ids of a vocabulary file in tables."""
    return encoder(path).width


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)


common.cache("encoding", encoder.cache_clear)


def slices(texts: list[str], most: int = 1 << 20):
    """Consecutive texts of about ``most`` characters together; it is what a worker holds split at a time."""
    begin, n = 0, 0
    for i, text in enumerate(texts):
        n += len(text)
        if n >= most:
            yield texts[begin : i + 1]
            begin, n = i + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def encode_column(batches, path: str, column: str, cache_share: float = 1.0):
    """(Arrow batch, packed ids of each of its texts) for Arrow batches with a text column, null as empty."""
    common.own_cache("encoding")
    enc = encoder(path)
    enc.share = cache_share
    for batch in batches:
        ids: list[bytes] = []
        for part in slices([x or "" for x in batch.column(column).to_pylist()]):
            ids += enc.batch(part)
        yield batch, ids
