"""Subword tokenizers: public vocabularies by path, encoded in Arrow batches. Nothing is trained here."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ragged

#: Alias: language.
LANGUAGES = {alias: name for name, aliases in {"yoruba": "yoruba yor yo", "igbo": "igbo ibo ig", "hausa": "hausa hau ha", "pidgin": "pidgin pcm naija-pidgin", "naija": "naija unified all"}.items() for alias in aliases.split()}
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_BYTES = 1 << 19


def get_supported_languages() -> list[str]:
    """K11."""
    return list(dict.fromkeys(LANGUAGES.values()))


@functools.lru_cache(maxsize=16)
def _loaded(path: str):  # noqa: ANN202
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer as Rust

    t = Rust.from_file(path)
    t.encode_special_tokens = True
    return t


def _encoded(path: str, texts: pa.Array, of: Callable, kind: pa.DataType) -> pa.Array:
    """of() each text's encoding; NULL of NULL."""
    out = []
    for a, b in ragged.batches_of(texts, PIECE_BYTES):
        part = texts.slice(a, b - a).to_pylist()
        got = _loaded(path).encode_batch([t or "" for t in part], add_special_tokens=False)
        out.append(pa.array([None if t is None else of(e) for t, e in zip(part, got)], kind))
    return pa.concat_arrays(out) if out else pa.array([], kind)


class Tokenizer:
    """K1 to K8. A vocabulary for a language: paths maps languages to files in the JSON format of the tokenizers library."""

    def __init__(self, language: str = "naija", paths: dict[str, str] | None = None) -> None:
        name = language.lower().strip()
        if name not in LANGUAGES:
            raise ValueError(f"unknown language {language!r}; known: {', '.join(sorted(LANGUAGES))}")
        self.language = LANGUAGES[name]
        self.path = (paths or {}).get(self.language, DEFAULT_PATH)

    def __repr__(self) -> str:
        return f"Tokenizer({self.language!r}, vocab_size={self.vocab_size})"

    @property
    def vocab_size(self) -> int:
        return _loaded(self.path).get_vocab_size()

    def encode(self, text: Column) -> Column:
        """K3, K6: array of ids. One call encodes PIECE_BYTES of an Arrow batch: what the library keeps of a text is many times its size."""
        path = self.path

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            return _encoded(path, texts, lambda e: e.ids, pa.list_(pa.int32()))

        return run(text)

    def tokens(self, text: Column) -> Column:
        """K5: array of token strings."""
        path = self.path

        @F.arrow_udf("array<string>")
        def run(texts: pa.Array) -> pa.Array:
            return _encoded(path, texts, lambda e: e.tokens, pa.list_(pa.string()))

        return run(text)

    def decode(self, ids: Column) -> Column:
        """K4, K7."""
        path = self.path

        @F.arrow_udf("string")
        def run(lists: pa.Array) -> pa.Array:
            values = lists.to_pylist()
            got = _loaded(path).decode_batch([v or [] for v in values], skip_special_tokens=False)
            return pa.array([None if v is None else t for v, t in zip(values, got)], pa.string())

        return run(ids)

    def count(self, text: Column) -> Column:
        """K10, without moving the ids out of the worker."""
        path = self.path

        @F.arrow_udf("int")
        def run(texts: pa.Array) -> pa.Array:
            return _encoded(path, texts, len, pa.int32())

        return run(text)


def tokenize(text: Column, lang: str = "naija") -> Column:
    """K9."""
    return Tokenizer(lang).tokens(text)


def count_tokens(text: Column, lang: str = "naija") -> Column:
    return Tokenizer(lang).count(text)
