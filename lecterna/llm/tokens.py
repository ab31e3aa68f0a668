"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Where vocabulary files of public tokenizers lie; a parameter of every operator that counts tokens.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"

_loaded: dict[str, object] = {}


def encoder(path: str):  # noqa: ANN201
    """The tokenizer of a vocabulary file, once a process."""
    if path not in _loaded:
        import tiktoken

        root = Path(path).parent
        found = importlib.util.spec_from_file_location("_vocabularies", root / "__init__.py")
        module = importlib.util.module_from_spec(found)
        found.loader.exec_module(module)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        _loaded[path] = tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


#: A long text goes to the tokenizer in pieces of at least so many characters.
PIECE = 20_000
_BLANK = re.compile(r"(?<=\S)\s")


def count(text: str | None, path: str) -> int:
    """Tokens of a whole text. A long text is counted in pieces, cut only before
    a blank that follows another character, where the tokenizer's pattern always
    parts; a run without blanks stays whole."""
    if not text:
        return 0
    enc = encoder(path)
    n, at = 0, 0
    while len(text) - at > PIECE and (m := _BLANK.search(text, at + PIECE)):
        n += len(enc.encode_ordinary(text[at : m.start()]))
        at = m.start()
    return n + len(enc.encode_ordinary(text[at:]))


def sized(df: DataFrame, text_col: str, *, tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` without ``text_col`` and with ``tokens`` (0 for null or empty) and
    ``digest``, a 64-bit hash of the text (null for null)."""
    from pyspark.sql.types import LongType, StructField, StructType

    path = f"{tokenizers}/{vocabulary}"
    rest = df.drop("tokens", "digest")
    at = rest.columns.index(text_col)
    kept = [f for f in rest.schema.fields if f.name != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            texts = b.column(at).to_pylist()
            n = pa.array([count(t, path) for t in texts], pa.int64())
            h = pa.array([None if t is None else xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(b.num_columns) if i != at] + [n, h], names=[f.name for f in kept] + ["tokens", "digest"])

    return rest.mapInArrow(run, StructType([*kept, StructField("tokens", LongType()), StructField("digest", LongType())]))
