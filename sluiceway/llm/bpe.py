"""Exact token ids of whole texts through a cache of encoded chunks.

A byte-pair tokenizer cuts a text into pretokens before it merges, and no pretoken of the two kinds of
vocabulary known here spans the chunk borders used. A chunk is therefore encoded once by the tokenizers library
and its ids are reused; the ids of a text are those of its chunks in order. Other vocabularies are recognised by
their settings and encode every text as a whole. Control strings of a vocabulary that occur in a text are
ordinary text, as the vocabularies' own description encodes them (`encode_special_tokens`).
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import unicodedata
from array import array

#: White space as Unicode defines it; the vocabularies' own patterns use the same set.
SPACE = r"\t-\r \x85\xa0  -     　"

#: White space is dropped before merging: chunks are what lies between blanks and line ends.
DROPS_SPACE = re.compile(r"[^ \n]+")

#: A single blank or line end joins the word it precedes; longer runs leave their last character to that word.
KEEPS_SPACE = re.compile(rf"[ \n]?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")

#: Texts of characters below U+0300 only (but for one whose lower case is longer) are cut into pretokens right here:
#: normalisation leaves them as they are, and the classes of their characters are known.
_HARD = re.compile("[\u0130\u0300-\U0010ffff]")


def _class(kind: str) -> str:
    return "".join(re.escape(chr(k)) for k in range(0x300) if unicodedata.category(chr(k))[0] == kind)


_L, _N = _class("L"), _class("N")
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
_DROPS = re.compile(rf"[{_L}]+|{_ENDINGS}|[{_N}]|[^{SPACE}{_L}{_N}]+")
_KEEPS = re.compile(rf" ?[{_L}]+|{_ENDINGS}| ?[{_N}]+| ?[^{SPACE}{_L}{_N}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: The vocabularies write bytes as characters: printable ones as themselves, the others from U+0100 on, in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: b for b in _PLAIN} | {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in _PLAIN)}

#: Bytes of encoded chunks that a worker keeps, and what an entry takes beside its own; once full, the older half goes.
CACHED, ENTRY = 160 << 20, 200

#: What decides on pretokens, of the two kinds known here.
_DROPPING = ({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_KEEPING = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def kind_of(path: str) -> str | None:
    """Whether a vocabulary "drops" white space before merging or "keeps" it; None for any other kind."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    normal, before, model = made.get("normalizer"), made.get("pre_tokenizer") or {}, made.get("model", {})
    if made.get("truncation") or made.get("padding") or model.get("type") != "BPE" or model.get("dropout") or any(t["normalized"] or not t["special"] for t in made.get("added_tokens", [])):
        return None
    if normal is None and _KEEPING.items() <= before.items():
        return "keeps"
    first, *rest = before.get("pretokenizers") or [{}]
    cuts = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and first.get("pattern") == {"Regex": _DROPPING[1]}
    last = len(rest) == 1 and rest[0].get("type") == "ByteLevel" and not rest[0].get("use_regex", True) and not rest[0].get("add_prefix_space", True)
    return "drops" if normal == _DROPPING[0] and cuts and last else None


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.held = 0
        self.tokenizer, self.kind = Tokenizer.from_file(path), kind_of(path)
        self.tokenizer.encode_special_tokens = True

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, found: dict[str, bytes]) -> None:
        size = lambda xs: sum(ENTRY + len(c) + len(ids) for c, ids in xs.items())
        self.known.update(found)
        self.held += size(found)
        if self.held > CACHED:  # by count, then by size where single entries are huge
            self.known = dict(itertools.islice(self.known.items(), len(self.known) // 2, None))
            self.held = size(self.known)
            if self.held > CACHED:
                self.known, self.held = {}, 0

    def _fresh(self, todo: list[str], whole: bool) -> dict[str, bytes]:
        out = {}
        if whole:  # pretokens: only merging is left to do
            merge = self.tokenizer.model.tokenize
            for word in todo:
                out[word] = array("I", [t.id for t in merge(word.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        for k in range(0, 0 if whole else len(todo), 8192):
            part = todo[k : k + 8192]
            out.update(zip(part, self._whole(part), strict=True))
        self._keep(out)
        return out

    def encode_many(self, texts: list[str], end: int) -> list[bytes]:
        """The ids of each text and the end id. Unknown chunks of all texts are encoded together."""
        tail, out = int(end).to_bytes(4, "little"), [b""] * len(texts)
        if self.kind is None:
            return [ids + tail for ids in self._whole(texts)]
        hard = [_HARD.search(t) is not None for t in texts]
        for whole in (False, True):
            at = [k for k, h in enumerate(hard) if h != whole]
            if self.kind == "drops":
                found = [(_DROPS.findall(texts[k].lower()) if whole else DROPS_SPACE.findall(texts[k])) for k in at]
            else:
                found = [(_KEEPS if whole else KEEPS_SPACE).findall(texts[k]) for k in at]
            got = [list(map(self.known.get, f)) for f in found]
            new = {c for f, g in zip(found, got, strict=True) if None in g for c, ids in zip(f, g, strict=True) if ids is None}
            if new:
                fresh = self._fresh(list(new), whole)
                got = [[ids if ids is not None else fresh[c] for c, ids in zip(f, g, strict=True)] if None in g else g for f, g in zip(found, got, strict=True)]
            for k, g in zip(at, got, strict=True):
                out[k] = b"".join(g) + tail
        return out


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker process."""
    return Encoder(path)
