"""Surface text of raw byte-level tokens.

Tokenizers show the bytes of a token as printable characters. ``decode`` turns them back where the bytes are valid
UTF-8 and leaves the token otherwise; then the marks of newline and space are replaced. Columns of token arrays are
decoded in Arrow batches, some rows at a time, with a memory of tokens, since a vocabulary is small against a corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_BOX = 0x2500  # a second block in which byte b is shown as U+2500 + b


def byte_of_character() -> dict[int, int]:
    """The byte that each code point shows: printable Latin-1 as itself, the others from U+0100 in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in printable)
    return {b: b for b in printable} | {0x100 + k: b for k, b in enumerate(hidden)} | {_BOX + b: b for b in range(256)}


_BYTES = byte_of_character()
#: Marks of newline and space in raw tokens.
_MARKS = str.maketrans({"Ċ": "\n", "Ġ": " ", "▁": " "})


def repair(token: str) -> str:
    """The text that the token's bytes spell, or the token itself if they spell none."""
    if not any(ord(c) in _BYTES for c in token):
        return token
    raw = b"".join(bytes((_BYTES[ord(c)],)) if ord(c) in _BYTES else c.encode("utf-8", "surrogatepass") for c in token)
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return token


def decode(token: str | None) -> str | None:
    return repair(token).translate(_MARKS) if token else token


class _Memory(dict):
    """What tokens were decoded to; forgotten at a size of some ten megabytes, since a worker has a memory for each batch."""

    def __missing__(self, token):
        if len(self) >= 1 << 16:
            self.clear()
        out = self[token] = decode(token)
        return out


def sliced(f: Callable[..., pa.Array], *arrays: pa.Array, rows: int = 256) -> pa.Array:
    """What ``f`` makes of some rows at a time: a batch may have thousands of rows, whose values as Python objects are many
    times as large as in Arrow."""
    return pa.concat_arrays([f(*(a.slice(at, rows) for a in arrays)) for at in range(0, max(1, len(arrays[0])), rows)])


def decoded(a: pa.Array, known: _Memory) -> pa.Array:
    """Arrays of tokens decoded, each distinct token once."""
    coded = a.flatten().dictionary_encode()
    texts = pa.array([known[t] for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    ends = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).cumsum()
    return pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), texts, mask=a.is_null())


def decode_tokens(tokens: Column | str, checked: bool = False) -> Column:
    """Of an array of raw tokens, the array of their surface texts; ``checked`` gives a struct of that (``value``) and the
    ``error`` of a row that can't be decoded, which stops nothing."""
    kind = pa.struct([("value", pa.list_(pa.string())), ("error", pa.string())])

    def shown(x, known):
        return None if x is None else [known[t] for t in x]

    @F.arrow_udf("struct<value:array<string>,error:string>" if checked else "array<string>")
    def run(a: pa.Array) -> pa.Array:
        known = _Memory()

        def some(a: pa.Array) -> pa.Array:
            if not checked:
                return decoded(a, known)
            try:
                return pa.StructArray.from_arrays([decoded(a, known), pa.nulls(len(a), pa.string())], fields=list(kind))
            except Exception:  # some row of these fails; which one is told row by row
                return pa.array([guarded(shown, x, known) for x in a.to_pylist()], kind)

        return sliced(some, a)

    return run.asNondeterministic()(F.col(tokens) if isinstance(tokens, str) else tokens)  # run once a row, whatever filters on it


def guarded(f, *args) -> dict:
    """The value of a function, or its error's class and message."""
    try:
        return {"value": f(*args), "error": None}
    except Exception as e:  # any row may fail; what it says goes with the row
        return {"value": None, "error": f"{type(e).__name__}: {e}"[:200]}


def decode_token(token: Column | str) -> Column:
    return F.get(decode_tokens(F.array(F.col(token) if isinstance(token, str) else token)), F.lit(0))
