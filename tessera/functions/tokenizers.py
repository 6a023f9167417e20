"""A byte-pair tokenizer over a vocabulary file, and windows over its tokens that stay valid text.

Tokens of byte-pair encodings may end inside a code point, and a slice of tokens may be encoded differently when it stands
alone. Windows therefore start and end between code points, and hold a text that is encoded to just their tokens.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import cached_property

#: Fixed value: how text is split before merging (the pattern of the vocabulary family).
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class BytePairTokenizer:
    """path: a file of lines 'base64 of the token, rank'. Needs the tiktoken library where it encodes."""

    path: str
    split: str = SPLIT

    @cached_property
    def encoding(self):
        import tiktoken

        ranks = {}
        with open(self.path, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        return tiktoken.Encoding("tessera", pat_str=self.split, mergeable_ranks=ranks, special_tokens={})

    def __getstate__(self):
        return {"path": self.path, "split": self.split}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def token_bytes(self, token: int) -> bytes:
        return self.encoding.decode_single_token_bytes(token)

    def decode_strict(self, tokens: list[int]) -> str:
        """Raises UnicodeDecodeError where the tokens are not whole code points."""
        return b"".join(map(self.token_bytes, tokens)).decode("utf-8", "strict")

    def count(self, text: str) -> int:
        return len(self.encode(text))

    def is_boundary(self, tokens: list[int], at: int) -> bool:
        """Whether a code point starts (or the text ends) at this token."""
        if not 0 <= at <= len(tokens):
            raise IndexError(at)
        return at in (0, len(tokens)) or self.token_bytes(tokens[at])[0] & 0xC0 != 0x80

    def retreat(self, tokens: list[int], at: int) -> int:
        """The last boundary that is not behind this token."""
        while not self.is_boundary(tokens, at):
            at -= 1
        return at

    def is_stable(self, tokens: list[int]) -> bool:
        return self.encode(self.decode_strict(tokens)) == tokens


class NoProgressError(ValueError):
    """The window is too small for a code point, or the overlap leaves no token to go on with."""


def window_end(tokenizer: BytePairTokenizer, tokens: list[int], start: int, size: int, overlap: int) -> int | None:
    """The last stable end within size, or None: what reaches the text's end may not be shortened, and other windows must
    hold more than the overlap."""
    end = tokenizer.retreat(tokens, min(start + size, len(tokens)))
    while end > start:
        if tokenizer.is_stable(tokens[start:end]):
            return end if end == len(tokens) or end - start > overlap else None
        if end == len(tokens):
            return None
        end = tokenizer.retreat(tokens, end - 1)
    return None


def stable_windows(tokenizer: BytePairTokenizer, tokens: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of at most size tokens; each starts `overlap` tokens before the end of the one before, or at the next token
    (up to that end) from which a stable window exists. The last one ends with the text."""
    out: list[tuple[int, int]] = []
    at = 0
    while not out or out[-1][1] < len(tokens):
        if at >= len(tokens):
            break
        low = tokenizer.retreat(tokens, at)
        if out and low <= out[-1][0]:
            raise NoProgressError(f"no token is left behind the overlap at {at}")
        ends = ((s, window_end(tokenizer, tokens, s, size, overlap)) for s in range(low, (out[-1][1] if out else low) + 1) if tokenizer.is_boundary(tokens, s))
        found = next(((s, e) for s, e in ends if e is not None), None)
        if found is None:
            raise NoProgressError(f"no stable window of {size} tokens at {at}")
        out.append(found)
        at = max(0, found[1] - overlap)
    return out
