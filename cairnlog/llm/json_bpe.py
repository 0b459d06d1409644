"""Byte-level BPE of a tokenizers JSON file, by pieces with a bounded memo.

The memo encodes unseen pieces with tiktoken's merge loop over ranks that are read from the JSON itself, which
gives the ids of the tokenizers library wherever merges are listed in id order; other files go to that library.
A text that holds the content of an added token, such as a special one, goes to the library as a whole: so the ids
are those of the library's plain call, which gives such a string the token's id.
"""

from __future__ import annotations

import json
import re
from struct import pack

from cairnlog.llm import pieces

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OPEN: dict[str, "JsonEncoder"] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class JsonEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        pre = spec.get("pre_tokenizer") or {}
        self.plain = (
            made == sorted(made)
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and spec.get("normalizer") is None
            and model.get("dropout") is None
        )
        self.size = max(model["vocab"].values()) + 1
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.path, self.library = path, None
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        if self.plain:
            ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
            core = tiktoken.Encoding("json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            single = core._encode_single_piece
            self.memo = pieces.Memo(lambda piece: single(piece))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.plain and not (self.added and self.added.search(text)):
            return self.memo.ids(pieces.split(text, PATTERN))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        ids = self.library.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)


def encoder(path: str) -> JsonEncoder:
    """One encoder per worker process and file."""
    if path not in _OPEN:
        _OPEN[path] = JsonEncoder(path)
    return _OPEN[path]
