"""Public tokenizers inside tasks.

Whole texts are encoded, but put together from stretches that encode alone: a tokenizer whose pieces never
cross a gap between two words gives the same ids for the text as for its words one by one. So a
task encodes each distinct stretch once and keeps a bounded memory of them.
"""

from __future__ import annotations

import contextlib
import gc
import json
import os
import re
from collections.abc import Callable, Iterable

#: Stretches of a generation; a worker keeps the results of two. Fewer only cost time.
HELD = 150_000
#: Longer stretches are encoded each time, so that the memory stays small.
LONG = 200

#: First code point after the Latin blocks, whose letters all tokenizers class alike.
LATIN_END = "\u0250"
#: Anything but printable letters of the Latin blocks.
BEYOND_LATIN = re.compile("[^ -~\xa1-\xac\xae-\u024f]")

#: A single space between two other characters: where byte-level and sentence-piece tokenizers both cut.
GAP = re.compile(r"(?<=\S) (?=\S)")


def path(name: str) -> str:
    """Where a public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """Results of stretches, each computed with others of its batch.

    Two generations are kept: what is not asked for again while a new one fills up is forgotten.
    """

    def __init__(self, compute: Callable[[list], Iterable], most: int | None = None):
        self.compute, self.held, self.older, self.most = compute, {}, {}, most

    def of(self, wanted: list) -> list:
        """Results of the stretches in order."""
        found = list(map(self.held.get, wanted))
        if None not in found:
            return found
        names = list(dict.fromkeys([w for w, r in zip(wanted, found, strict=True) if r is None]))
        again = list(map(self.older.get, names))
        fresh = [w for w, r in zip(names, again, strict=True) if r is None]
        computed = iter(self.compute(fresh))
        new = dict(zip(names, [next(computed) if r is None else r for r in again], strict=True))
        found = [new[w] if r is None else r for w, r in zip(wanted, found, strict=True)]
        if len(self.held) + len(new) > (HELD if self.most is None else self.most):
            self.held, self.older = {}, self.held
        self.held.update(new if max(map(len, names)) <= LONG else {w: r for w, r in new.items() if len(w) <= LONG})
        return found


@contextlib.contextmanager
def no_cycle_search():
    """Hold the search for reference cycles, which would walk through the kept results again and again; none are made here."""
    held = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if held:
            gc.enable()


_LOADED: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, made once per worker."""
    if key not in _LOADED:
        _LOADED[key] = make()
    return _LOADED[key]


def tokenizer(place: str, plain_specials: bool):
    """A tokenizer file; with ``plain_specials`` the names of special tokens inside texts are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(place)
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = plain_specials
    return out


def sentence_pieces(place: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=place)


def byte_level() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_encoding(place: str):
    """A byte-level tokenizer file as ranks, or None if its merges and ids do not come in one order.

    The ids of merged tokens have to follow the 256 single bytes in the order of the merges; then the
    least rank is the first merge, and both ways cut words alike.
    """
    import public_tokenizers
    import tiktoken

    with open(place, encoding="utf-8") as f:
        stated = json.load(f)
    model, step = stated["model"], stated.get("pre_tokenizer") or {}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    plain = step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step["add_prefix_space"] and not stated.get("normalizer")
    if not plain or any(model["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    letters = byte_level()
    ranks = {bytes(letters[c] for c in name): i for name, i in model["vocab"].items() if i < 256 + len(merges)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
