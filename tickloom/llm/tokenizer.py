"""Token ids of public vocabulary files, cached once per Python worker.

A byte-level BPE ``.json`` is encoded by the rank-merge engine built from that
file's own vocabulary, which gives the ids of the file's own library several
times faster; files of any other shape go to their own library.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """``ids(text)`` as the file's library gives them, special strings in a text becoming their special id."""

    #: The split pattern that byte-level files of this family apply before merging.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        self.specials: dict[str, int] = {}
        self.lengths = None  # bytes of each id; None where ids do not map to byte runs
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._plain = lambda text: model.encode(text, num_threads=1)
        elif (spec := json.load(open(path, encoding="utf-8"))) and self._rank_ordered(spec):
            import tiktoken

            alphabet = _byte_alphabet()
            self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
            vocab = {bytes(alphabet[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in self.specials}
            engine = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=vocab, special_tokens={})
            self._plain = engine.encode_ordinary
            every = [(i, len(b)) for b, i in vocab.items()] + [(i, len(s.encode())) for s, i in self.specials.items()]
            self.lengths = np.zeros(max(i for i, _ in every) + 1, dtype=np.int64)
            for i, n in every:
                self.lengths[i] = n
        else:
            import tokenizers

            own = tokenizers.Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            self._plain = lambda text: own.encode(text, add_special_tokens=False).ids
        found = sorted(self.specials, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, found)) + ")") if found else None

    @staticmethod
    def _rank_ordered(spec: dict) -> bool:
        """Whether the file is plain byte-level BPE whose ids are its merge order."""
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
        if spec.get("normalizer") or model.get("type") != "BPE" or pre.get("type") != "ByteLevel":
            return False
        if pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return False
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added):
            return False
        vocab = model["vocab"]
        made = [vocab.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        return made == list(range(256, 256 + len(made)))

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def ids(self, text: str) -> list[int]:
        if not self.has_special(text):
            return self._plain(text)
        out: list[int] = []
        for part in self._split.split(text):
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                out += self._plain(part)
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Tokens:
    return Tokens(path)
