"""Token ids of whole texts by a tokenizer file of the tokenizers library.

A tokenizer that drops white space and lower-cases gives a text the ids of its
blank-separated pieces one after another, so each different piece is encoded
once and found again by its hash. Other tokenizers encode text by text.
"""

from __future__ import annotations

import json
import os

import numpy as np

from .kernels import ASCII_LETTER, LOWER, byte_class, hash_runs, runs, spread

_BLANK = byte_class((0x20, 0x20), (0x0A, 0x0A))
_STOP = byte_class((0x2C, 0x2C), (0x2E, 0x2E))
#: Pieces that a worker remembers before it starts anew.
MEMORY = 2_000_000
#: Byte-level models name bytes by characters: printable ones of Latin-1 by themselves, the others from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_VISIBLE = {b: 0x100 + k for k, b in enumerate(sorted(set(range(0x100)) - set(_SHOWN)))}
_LOADED: dict[tuple[str, int], "Encoder"] = {}


def encoder(path: str, end_id: int) -> "Encoder":
    """The encoder of this Python worker."""
    if (path, end_id) not in _LOADED:
        _LOADED[path, end_id] = Encoder(path, end_id)
    return _LOADED[path, end_id]


def past_vocabulary(path: str) -> int:
    """The first id that the tokenizer file at ``path`` gives to nothing."""
    spec = json.load(open(path))
    vocab = spec["model"]["vocab"]
    ids = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    return 1 + max([*ids, *(x["id"] for x in spec.get("added_tokens", []))])


class Encoder:
    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id = Tokenizer.from_file(path), end_id
        spec = json.load(open(path))
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        #: Added tokens are found in the text as it is written, before letters are folded.
        self.marks = sorted({x["content"].encode()[0] for x in spec.get("added_tokens", []) if x["content"]})
        self.by_piece, self.plain = _splits_at_blanks(spec), _plain_model(spec)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.where = np.zeros(0, dtype=np.int64)
        self.count = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=self.dtype)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, pointers)`` of the texts in ``data``; every text ends with ``end_id``."""
        if self.by_piece:
            flat, per = self._pieces(data, offsets)
        else:
            got = self.tokenizer.encode_batch([bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])], add_special_tokens=False)
            per = np.array([len(x.ids) for x in got], dtype=np.int64)
            flat = np.fromiter((i for x in got for i in x.ids), dtype=self.dtype, count=int(per.sum()))
        n = len(per)
        pointers = np.concatenate(([0], np.cumsum(per + 1)))
        out = np.empty(len(flat) + n, dtype=self.dtype)
        out[pointers[1:] - 1] = self.end_id
        keep = np.ones(len(out), dtype=bool)
        keep[pointers[1:] - 1] = False
        out[keep] = flat
        return out, pointers

    def _pieces(self, data, offsets):
        lower = LOWER[data]
        filled = ~_BLANK[data]
        starts, ends = runs(filled, offsets)
        if not len(starts):
            return np.zeros(0, dtype=self.dtype), np.zeros(len(offsets) - 1, dtype=np.int64)
        if self.plain:  # a stop or comma after a letter, at the end of a piece, is a piece of its own
            last = ends - 1
            own = np.flatnonzero((ends - starts > 1) & _STOP[data[last]] & ASCII_LETTER[data[np.maximum(last - 1, 0)]])
            at = last[own]
            starts = np.insert(starts, own + 1, at)
            ends = np.insert(ends, own, at)
        for at in [at for m in self.marks if len(at := np.flatnonzero(data == m))]:  # pieces that may hold an added token keep their letters
            for k in np.unique(np.searchsorted(starts, at, "right") - 1).tolist():
                lower[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        keys, first, which = np.unique(hash_runs(lower, starts, ends), return_index=True, return_inverse=True)
        spot = self._find(keys, first, lower, starts, ends)
        counts = self.count[spot][which]
        flat = self.pool[spread(self.where[spot][which], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        return flat, np.diff(total[np.searchsorted(starts, offsets)])

    def _find(self, keys, first, lower, starts, ends):
        if len(self.keys) > MEMORY:
            self._forget()
        spot = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = spot < len(self.keys)
        known[inside] = self.keys[spot[inside]] == keys[inside]
        if not known.all():
            new = ~known
            pieces = [lower[a:b].tobytes() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())]
            ids = self._ids(pieces)
            count = np.array([len(x) for x in ids], dtype=np.int64)
            flat = np.fromiter((i for x in ids for i in x), dtype=self.dtype, count=int(count.sum()))
            where = len(self.pool) + np.concatenate(([0], np.cumsum(count)[:-1]))
            order = np.argsort(merged := np.concatenate((self.keys, keys[new])), kind="stable")
            self.keys = merged[order]
            self.where = np.concatenate((self.where, where))[order]
            self.count = np.concatenate((self.count, count))[order]
            self.pool = np.concatenate((self.pool, flat))
            spot = np.searchsorted(self.keys, keys)
        return spot

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        rest = []
        for k, piece in enumerate(pieces):
            got = self._letters(piece) if self.plain else None
            if got is None:
                rest.append(k)
            else:
                out[k] = got
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            got = self.tokenizer.encode_batch_fast([pieces[k].decode("utf-8", "replace") for k in some], add_special_tokens=False)
            for k, x in zip(some, got):
                out[k] = x.ids
        return out

    def _letters(self, piece: bytes) -> list[int] | None:
        """Ids of a piece of letters below U+0130 with at most one stop or comma after them, straight from the model."""
        try:
            text = piece.decode()
        except UnicodeDecodeError:
            return None
        tail = text[-1] if text[-1] in ".," and len(text) > 1 else ""
        word = text[: len(text) - len(tail)]
        if not word.isalpha() or max(word) >= "\u0130":
            return None
        model = self.tokenizer.model
        ids = [t.id for t in model.tokenize(word.lower().encode().decode("latin-1").translate(_VISIBLE))]
        return ids + [t.id for t in model.tokenize(tail)] if tail else ids


def _splits_at_blanks(spec: dict) -> bool:
    """Whether the file says that white space is dropped and letters are lower-cased."""
    kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer") or {"type": ""}])]
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"[^\s\p{L}\p{N}]+" in pattern and r"[\p{L}]+" in pattern
    return bool(drops and "Lowercase" in kinds and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") or set(x["content"]) & {" ", "\n"} for x in spec.get("added_tokens", [])))


def _plain_model(spec: dict) -> bool:
    """Whether a run of letters of ASCII goes to the model as it is."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return _splits_at_blanks(spec) and [x["type"] for x in parts] == ["Split", "ByteLevel"] and not parts[1].get("add_prefix_space")
