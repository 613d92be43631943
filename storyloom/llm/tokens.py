"""Token ids of whole texts, by the tokenizers library with a memory of words.

Both vocabularies split a text into pieces before any merge, and no piece spans a
place where :meth:`Encoder.split` cuts. So a text's ids are the ids of its chunks
in order. Chunks that were not seen before go through the library many at a time, laid
end to end with marks between them that no chunk can make. A text that
holds one of the vocabulary's added tokens is encoded by one call for the whole.
"""

from __future__ import annotations

import os
import re
from itertools import islice

import numpy as np

from .common import is_latin, kept

# Spark runs one task on each core already.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Unicode's white space, as the vocabularies' own patterns understand it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BYTE_CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
WORD_CHUNK = re.compile(f"[^{SPACE}]+")
#: Two white spaces in a row, or one other than a space or a line's end: there a cut at each space might part a run.
RUN = re.compile(f"[{SPACE}][{SPACE}]|[{SPACE.replace(' ', '').replace(chr(10), '')}]")
#: The same for texts of Latin letters alone, which hold no other white space.
LATIN_RUNS = ["  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\x85", "\xa0"]
#: In lower case, what a vocabulary that drops white space never joins: runs of letters and what is between them.
#: An apostrophe may take letters with it: a word with one stays whole.
LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
LATIN_WORD = re.compile(f"[{LETTERS}]+|[^ \n{LETTERS}]+")
LATIN_CHUNK = re.compile(f"[^ \n]*'[^ \n]*|[{LETTERS}]+|[^ \n{LETTERS}]+")
LATIN_ONLY = re.compile(f"[{LETTERS}]+")
WHITE = re.compile(f"[{SPACE}]")
#: str.split() takes these for white space, the vocabularies don't.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
#: Of the Latin characters, what might be white space other than a space or a line's end.
OTHER_SPACE = NOT_SPACE + "\t\r\x0b\x0c\x85\xa0"
#: Stands before chunks that are taken as they are, without a space before them.
BARE = "\0"
#: A line's end between words; as a chunk, this.
LINE = BARE + "\n"
#: Stands between chunks where the vocabulary drops white space; it is one id, and so is known again.
BETWEEN = "~"


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Places(dict):
    """A number for each distinct key, in the order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        return place


class Encoder:
    """Encodes lists of texts; keeps about ``most`` chunks in memory at most."""

    def __init__(self, path: str, most: int = 500_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_bytes = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most = most
        if self.by_bytes:
            blank = self.tokenizer.pre_tokenizer.pre_tokenize_str(" ")[0][0]
            self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that begin with a space
            self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith(blank)]] = True
            self.line_id = self.call("\n")[0]
        else:
            (self.between_id,) = self.call(BETWEEN)
            last = self.tokenizer.model.end_of_word_suffix or ""
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a piece
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if last and t.endswith(last)]] = True
        self.forget()

    def call(self, text: str) -> list[int]:
        """One text by the library."""
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        """Drop all remembered chunks."""
        self.places = Places()
        self.lengths, self.starts, self.ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def split(self, text: str) -> list[str]:
        """Chunks whose ids don't depend on their neighbours."""
        latin = is_latin(text)
        if not self.by_bytes:
            if latin and not any(c in text for c in OTHER_SPACE):
                text = text.lower()
                return (LATIN_CHUNK if "'" in text else LATIN_WORD).findall(text)
            return WORD_CHUNK.findall(text) if any(c in text for c in NOT_SPACE) else text.split()
        if any(r in text for r in LATIN_RUNS) if latin else RUN.search(text):
            return [c[1:] if c[0] == " " and len(c) > 1 else BARE + c for c in BYTE_CHUNK.findall(text)]
        if "\n" in text:
            text = text.replace("\n", f" {LINE} {BARE}")
        chunks = text.split(" ")
        if chunks[0]:
            chunks[0] = BARE + chunks[0]
            return chunks
        return chunks[1:]

    def in_bulk(self, chunks: list[str], kind: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of chunks without white space, one after another, and how many each has; None if they can't be told apart."""
        between = {"spaced": " ", "bare": "\n", "letters": " ", "marked": f" {BETWEEN} "}[kind]
        ids = np.array(self.call(between.join(["", *chunks])), np.uint32)
        if kind == "letters":
            starts = np.append(0, np.flatnonzero(self.ends[ids])[:-1] + 1)
        else:
            first = self.opens[ids] if kind == "spaced" else ids == (self.line_id if kind == "bare" else self.between_id)
            starts = np.flatnonzero(first)
        if len(starts) != len(chunks) or not len(ids) or starts[0]:
            return None
        sizes = np.diff(np.append(starts, len(ids)))
        return (ids, sizes) if kind in ("spaced", "letters") else (ids[~first], sizes - 1)

    def learn(self, chunks: list[str]) -> None:
        """Encode chunks that were not seen before."""
        kinds: dict[str, list[int]] = {"alone": [], "spaced": [], "bare": [], "letters": [], "marked": []}
        # One look at all chunks tells whether some may need a call of their own.
        odd = WHITE.search("".join(chunks)) or BARE in chunks or "" in chunks if self.by_bytes else BETWEEN in "".join(chunks)
        for k, c in enumerate(chunks):
            if odd and (c in ("", BARE) or WHITE.search(c) if self.by_bytes else BETWEEN in c):
                kinds["alone"].append(k)
            elif self.by_bytes:
                kinds["bare" if c[0] == BARE else "spaced"].append(k)
            else:
                kinds["letters" if LATIN_ONLY.fullmatch(c) else "marked"].append(k)
        sizes, order, flat = np.zeros(len(chunks), np.int32), [], []
        for kind, members in kinds.items():
            for a in range(0, len(members), 2000):
                part = members[a : a + 2000]
                found = None if kind == "alone" else self.in_bulk([chunks[k][1:] if kind == "bare" else chunks[k] for k in part], kind)
                if found is None:
                    each = [self.one(chunks[k]) for k in part]
                    found = np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each])
                flat.append(found[0])
                sizes[part] = found[1]
                order += part
        starts, in_order = np.zeros(len(chunks), np.int32), sizes[order]
        starts[order] = len(self.ids) + np.cumsum(in_order) - in_order
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, sizes])
        self.ids = np.concatenate([self.ids, *flat])

    def one(self, chunk: str) -> list[int]:
        """The ids of one chunk."""
        return [] if chunk == BARE else self.call(chunk[1:] if chunk[:1] == BARE else " " + chunk if self.by_bytes else chunk)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after one another, and the number of ids of each text."""
        if len(self.places) > self.most:
            self.forget()
        whole: list[int] = []
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if BARE in text or any(a in text for a in self.added):
                whole.append(k)
            elif text:
                found = self.split(text)
                counts[k] = len(found)
                chunks += found
        known = len(self.places)
        at = np.fromiter(map(self.places.__getitem__, chunks), np.int32, len(chunks))
        if len(self.places) > known:
            self.learn(list(islice(reversed(self.places), len(self.places) - known))[::-1])
        lengths = self.lengths[at]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat((self.starts[at] - ends + lengths).astype(np.int32), lengths) + np.arange(total, dtype=np.int32)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        sizes = np.diff(bounds)
        if whole:
            parts = np.split(ids, bounds[1:-1])
            for k in whole:
                parts[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, np.uint32)
                sizes[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, sizes

    def encode_ended(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, with ``end_id`` after each text's ids."""
        ids, sizes = self.encode(texts)
        ended = np.full(len(ids) + len(sizes), end_id, np.uint32)
        stays = np.ones(len(ended), bool)
        stays[np.cumsum(sizes + 1) - 1] = False
        ended[stays] = ids
        return ended, sizes + 1


def encoder(name: str) -> Encoder:
    """This worker's encoder for a public vocabulary."""
    return kept(f"encoder {name}", lambda: Encoder(vocabulary_path(name)))
