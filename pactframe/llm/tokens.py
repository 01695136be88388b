"""Token ids of whole texts, cached by word, for executors without a network."""

from __future__ import annotations

import re

from .common import worker_cache

TOKENIZER = "word_bpe_49k.json"
_ASCII = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: White space to ``str.split`` but ordinary characters to the tokenizer.
_SEPARATORS = re.compile("[\x1c-\x1f]")
#: Entries after which a worker's caches start anew: about 80 MB each.
CACHED_RUNS, CACHED_WORDS = 300_000, 400_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Ids of a text as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and merges inside a pre-token only, so the
    ids of a text are those of its white-space separated runs, one after the
    other, and a run's are those of its pre-tokens. Both levels are cached.
    Runs outside the range where lower-casing is a plain per-character map go
    to the tokenizer as they are; so do whole texts with special strings.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.unicode = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        # Byte-level alphabet: printable bytes stand for themselves, the others
        # follow from U+0100 in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: 256 + i for i, b in enumerate(rest)}
        outer = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                text = word if word.isascii() else word.encode().decode("latin-1").translate(outer.letters)
                ids = b"".join([t.id.to_bytes(4, "little") for t in outer.model.tokenize(text)])
                if len(self) >= CACHED_WORDS:
                    self.clear()
                self[word] = ids
                return ids

        class Runs(dict):
            def __missing__(self, run: str) -> bytes:
                if run.isascii():
                    ids = b"".join([outer.words[w] for w in _ASCII.findall(run.lower())]) if run.isprintable() else outer.encode(run)
                elif max(run) < "ɐ" and run.isprintable():
                    ids = b"".join([outer.words[w] for w in outer.unicode.findall(run.lower())])
                else:
                    ids = outer.encode(run)
                if len(self) >= CACHED_RUNS:
                    self.clear()
                self[run] = ids
                return ids

        self.words, self.runs = Words(), Runs()

    def forget(self) -> None:
        """Lets go of the cached ids; the tokenizer stays."""
        self.words.clear()
        self.runs.clear()

    def encode(self, text: str) -> bytes:
        """What the tokenizer itself gives."""
        return b"".join([i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids])

    def __call__(self, text: str) -> bytes:
        if "<|" in text or _SEPARATORS.search(text):
            return self.encode(text)
        runs = self.runs
        return b"".join([runs[r] for r in text.split()])


def word_ids(path: str) -> WordIds:
    """The tokenizer of this worker, with what its caches still hold."""
    return worker_cache(("ids", path), lambda: WordIds(path))

