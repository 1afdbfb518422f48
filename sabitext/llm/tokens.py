"""Public byte-level BPE vocabularies, by path, loaded once in each worker."""

from __future__ import annotations

import base64
import functools
import re

import tiktoken

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER) -> tiktoken.Encoding:
    """Without special tokens: their strings in a text are ordinary text."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: White space as the pattern means it, which isn't quite Python's.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def ids_of(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of the whole text. The library gives up on very long runs of white space, which its pattern backtracks over;
    what the pattern makes of a run is plain, so such runs are cut out here and the ids are the same: all of a run but its last
    character is one piece, which is merged as any piece is, and the last one goes with what follows."""
    if len(text) < 10_000:
        return enc.encode_ordinary(text)
    out, last = [], 0
    for m in _SPACE.finditer(text):
        cut = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[last : m.start()]) + enc._encode_single_piece(text[m.start() : cut])
        last = cut
    return out + enc.encode_ordinary(text[last:])


def free_id(path: str = TOKENIZER) -> int:
    """The first id that the vocabulary doesn't use."""
    return encoder(path).n_vocab
