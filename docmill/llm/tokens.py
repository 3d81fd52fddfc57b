"""Encoding with a public tokenizer file, equal to the tokenizers library's but faster.

* Byte-level files (use_regex) whose ids follow the order of their merges: merging by rank is what tiktoken does, with
  the same pattern for pre-tokens; it is given the file's vocabulary. Texts that hold the name of a special token, or a
  run of LONG_RUN characters other than white space, go to the library.
* Word-end files, whose white space is dropped: the ids of a text are those of its words, one after the other. Each
  distinct word is encoded once a worker, and kept in two tables of at most MEMO words; when the newer is full the older
  one is dropped. Words of Latin letters alone are merged by rank as well, with a blank for the end of a word, if merging
  by pairs, as the library does, makes each token of the file out of its own text: then no two neighbours but the pair of
  a token's own merge can ever make that token, and both ways are the same. All other words go to the library.
* Any other text or file is encoded by the library as it stands.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

import numpy as np

from docmill.llm import common

MEMO, LONG_RUN = 1 << 19, 5000
_long_run = re.compile(r"\S{%d}" % LONG_RUN).search
_marks_meet = re.compile(r"[.,](?:(?<=[^\w\s].)|(?<=_.)|(?=[^\w\s]|_))").search
_odd_space = re.compile("[\x1c-\x1f]").search  # white space to Python, not to the library
_latin = re.compile("[\x00-\u017f]*").fullmatch
# letters that are composed and lower-cased one by one; longer words are rare and take merging by rank too long
_letters = re.compile("[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]{1,200}").fullmatch


def path_of(file: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(file)


class Pieces:
    """encode(text) -> ids as bytes (unsigned, of the width given, little-endian), equal to the library's."""

    def __init__(self, path: str, width: int = 2, memo: int = MEMO):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads here
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        state = json.loads(self.library.to_str())
        kinds = [x["type"] for x in (state.get("pre_tokenizer") or {}).get("pretokenizers", [state.get("pre_tokenizer") or {"type": ""}])]
        if kinds == ["ByteLevel"] and state["pre_tokenizer"]["use_regex"] and not state["pre_tokenizer"]["add_prefix_space"] and not state.get("normalizer"):
            self.blank = " "
        elif kinds[:1] == ["Split"] and state["model"].get("end_of_word_suffix"):
            self.blank = ""
        else:
            self.blank = None
        self.specials = [x["content"] for x in state.get("added_tokens", [])]
        self.special_ids = {x["id"] for x in state.get("added_tokens", [])}
        self.kind, self.memo_size = np.dtype(f"<u{width}"), memo
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        suffix = len(state["model"].get("end_of_word_suffix") or "")
        self.n_bytes = np.zeros(self.library.get_vocab_size() + 1, np.int64)  # a byte is one character of a token's name
        for name, i in self.library.get_vocab().items():
            self.n_bytes[i] = len(name) - (suffix if suffix and name.endswith("</w>") else 0)
        self.by_rank = self._ranked(state["model"]) if self.blank == " " else None
        self.by_word = self._word_ranked(state["model"]) if self.blank == "" else None

    def _ranked(self, model: dict):
        """A tiktoken encoding with this file's vocabulary; None if ids don't follow the order of merges."""
        import public_tokenizers
        import tiktoken

        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][name] for name in merged]
        if ids != sorted(set(ids)) or min(ids) < 256:
            return None
        ranks = {x: i for i, x in enumerate(self.bytes_of) if i not in self.special_ids}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_to_numpy

    def _word_ranked(self, model: dict):
        """A tiktoken encoding of words that each have a blank behind them; None if it isn't sure to equal the library's."""
        import tiktoken
        from tokenizers import models

        suffix, of = model["end_of_word_suffix"], self._byte_of
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ranks = {name: i for name, i in model["vocab"].items() if i not in self.special_ids}
        inner = [name for name in ranks if not name.endswith(suffix)]
        stems = [name[: -len(suffix)] for name in ranks if name.endswith(suffix)]
        by_bytes = {bytes(map(of.get, name)): ranks[name] for name in inner if all(c in of for c in name)}
        by_bytes |= {bytes(map(of.get, stem)) + b" ": ranks[stem + suffix] for stem in stems if all(c in of for c in stem)}
        ids = [ranks.get(a + b.removesuffix(suffix) + suffix if b.endswith(suffix) else a + b, -1) for a, b in merges]
        if len(by_bytes) != len(ranks) or len(ranks) != len(ids) + 512 or ids != sorted(set(ids)) or min(ids) < 512:
            return None
        if not set(of) <= set(inner) or not set(of) <= set(stems) or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges")):
            return None
        for names, end in ((inner, ""), (stems, suffix)):
            by_pairs = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **({"end_of_word_suffix": end} if end else {}))
            if any([t.id for t in by_pairs.tokenize(x)] != [ranks[x + end]] for x in names):
                return None
        self.ends_word = np.zeros(self.library.get_vocab_size() + 1, bool)
        self.ends_word[[ranks[stem + suffix] for stem in stems]] = True
        return tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=by_bytes, special_tokens={}).encode_to_numpy

    @functools.cached_property
    def _byte_of(self) -> dict[str, int]:
        """The byte that each character of a byte-level token's name stands for."""
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [i for i in range(256) if i not in visible]
        return {chr(i): i for i in visible} | {chr(256 + k): i for k, i in enumerate(rest)}

    @functools.cached_property
    def bytes_of(self) -> list[bytes]:
        """The bytes of each id of a byte-level file; a special token has those of its name."""
        of, out = self._byte_of, [b""] * self.library.get_vocab_size()
        for name, i in self.library.get_vocab().items():
            out[i] = name.encode() if name in self.specials else bytes(of[c] for c in name)
        return out

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.memo) > self.memo_size:
            self.older, self.memo = self.memo, {}
        unmet = words.difference(self.memo)
        again = unmet.intersection(self.older)
        self.memo.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = unmet.difference(again)
        new = list(new.difference(self._learn_letters(new)))
        plain = [w for w in new if w and _latin(w)]
        if not self._learn_joined(plain):
            plain = []
        rest = new if not plain else [w for w in new if w not in self.memo]
        for w, e in zip(rest, self.library.encode_batch_fast([self.blank + w for w in rest], add_special_tokens=False), strict=True):
            self.memo[w] = np.asarray(e.ids, self.kind).tobytes()

    def _learn_letters(self, words: set[str]) -> list[str]:
        """Encodes those that are letters alone by rank; which these are."""
        found = list(filter(_letters, words)) if self.by_word else []
        if found:
            ids = self.by_word(" ".join([*found, ""]).lower(), disallowed_special=())
            data, at = ids.astype(self.kind).tobytes(), ((np.flatnonzero(self.ends_word[ids]) + 1) * self.kind.itemsize).tolist()
            self.memo.update(zip(found, (data[i:j] for i, j in zip([0, *at], at)), strict=True))
        return found

    def _learn_joined(self, words: list[str]) -> bool:
        """Encodes many pieces as one text, and cuts its ids where the bytes of the pieces end; False if they don't all end with an id."""
        if not words or any(s in w for w in words for s in self.specials if "<" in w):
            return False
        as_read = words if self.blank else [unicodedata.normalize("NFC", w).lower() for w in words]
        ends = np.cumsum([len(w.encode()) + len(self.blank) for w in as_read])
        ids = np.asarray(self.library.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0].ids, np.int64)
        reach = np.cumsum(self.n_bytes[ids])
        at = np.searchsorted(reach, ends)
        if not len(reach) or reach[-1] != ends[-1] or not np.array_equal(reach[at], ends):
            return False
        data, at = ids.astype(self.kind).tobytes(), ((at + 1) * self.kind.itemsize).tolist()
        self.memo.update(zip(words, (data[i:j] for i, j in zip([0, *at], at)), strict=False))
        return True

    def _words(self, text: str) -> list[str] | None:
        """The pieces of a text for a word-end file; None if it must be encoded whole."""
        if self.blank != "" or _odd_space(text) or any(s in text for s in self.specials):
            return None
        if text.isascii() or _latin(text):  # composed already, and lower-cased one by one
            text = text.lower()
            if not _marks_meet(text):  # a lone mark is a pre-token of its own
                text = text.replace(".", " .").replace(",", " ,")
        return text.split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Many texts; what is new in them is learned at once."""
        if self.by_rank:
            return [self.encode(t) for t in texts]
        parts = [self._words(t) for t in texts]
        self._learn(set().union(*filter(None, parts)))
        get = self.memo.__getitem__
        return [self.whole(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts, strict=True)]

    def encode(self, text: str) -> bytes:
        if self.by_rank:
            if any(s in text for s in self.specials) or _long_run(text):
                return self.whole(text)
            return self.by_rank(text, disallowed_special=()).astype(self.kind).tobytes()
        return self.encode_all([text])[0]


@functools.lru_cache(8)
def width_of(path: str) -> int:
    """Bytes that an id of the file takes: 2, or 4 for vocabularies beyond that."""
    return 2 if Pieces(path).library.get_vocab_size() <= 1 << 16 else 4


@functools.lru_cache(2)
def pieces(path: str, width: int = 2) -> Pieces:
    """One for each worker, kept between tasks."""
    return Pieces(path, width)


common.MODELS["tokens"] = pieces.cache_clear
