"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut at the tokenizer's added tokens, then into pre-tokens. The bytes of a pre-token form a linked
list; a heap repeatedly gives the lowest-rank adjacent pair, which is merged. Its count is its bytes less
its merges; no identifiers are emitted. Counts of pre-tokens and of words with the space before them are
remembered in tables of bounded size.

Null texts count as empty: 0 bytes and 0 tokens. Repeated rows are counted each; null ids pass through. A very long text
is counted whole, pre-token by pre-token, and a pre-token of n bytes in n log n steps. Of equal ranks the first pair is
merged. An empty table gives an empty result; only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

import json
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Fixed value: the pre-token pattern of byte-level tokenizers that carry use_regex. \s there is the property White_Space.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = [""] * 256, 0x100
    for b in range(256):
        if b in set(shown):
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class _Counts(dict):
    """Pre-token -> tokens; forgets everything once it holds ``most`` entries."""

    def __init__(self, count, most: int) -> None:
        super().__init__()
        self.count, self.most = count, most

    def __missing__(self, piece: str) -> int:
        n = self.count(piece)
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


class BpeCounter:
    """Counts tokens as the ``tokenizers`` library does for a byte-level BPE file."""

    def __init__(self, path: str, remembered: int = 600_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE files without a normaliser or prefix space are supported")
        if model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("ignore_merges and dropout are not supported")
        named = {c: b for b, c in enumerate(byte_symbols())}  # inside, a symbol is a byte or 256 and the rank of its first merge
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for k, m in enumerate(model["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            self.made.append(named.setdefault(left + right, 256 + k))
            self.rank[named[left] << 24 | named[right]] = k
        added = [x for x in spec.get("added_tokens", ())]
        if any(x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip or need word ends are not supported")
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.pieces = regex.compile(PRE_TOKEN)
        self.counts = _Counts(self.count_piece, remembered)
        self.words = _Counts(lambda w: self.count_plain(" " + w), remembered)
        self.wide = regex.compile(r"\p{White_Space}\p{White_Space}")

    def count_piece(self, piece: str) -> int:
        """Bytes less merges of one pre-token."""
        raw = piece.encode("utf-8", "surrogatepass")
        n = len(raw)
        if n < 2:
            return n
        symbol, rank, made = [*raw, -1], self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n))
        now = [rank(symbol[k] << 24 | symbol[k + 1], -1) for k in range(n - 1)] + [-1, -1]  # each pair's rank, by its left symbol's place
        heap = [r << 32 | k for k, r in enumerate(now) if r >= 0]
        heapify(heap)
        left = n
        while heap:
            k = heappop(heap)
            r, k = k >> 32, k & 0xFFFFFFFF
            if now[k] != r:
                continue  # an older entry: one of its symbols has been merged since
            m = after[k]
            symbol[k], now[m] = made[r], -1
            left -= 1
            after[k] = m = after[m]
            before[m] = k
            if m < n:
                now[k] = r = rank(symbol[k] << 24 | symbol[m], -1)
                if r >= 0:
                    heappush(heap, r << 32 | k)
            else:
                now[k] = -1
            if (p := before[k]) >= 0:
                now[p] = r = rank(symbol[p] << 24 | symbol[k], -1)
                if r >= 0:
                    heappush(heap, r << 32 | p)
        return left

    def count_plain(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.pieces.findall(text)))

    def count_part(self, text: str) -> int:
        """Of a part without added tokens. Where no white space follows white space, each newline is a
        pre-token and each space begins one, so lines and words count on their own."""
        if self.wide.search(text):
            return self.count_plain(text)
        lines = text.split("\n")
        n = (len(lines) - 1) * self.counts["\n"]
        for line in lines:
            first, *rest = line.split(" ")
            n += self.count_plain(first) + sum(map(self.words.__getitem__, rest))
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.added is None:
            return self.count_part(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self.count_part, parts))


def count_tokens(df: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Per row: id, n_bytes, n_tokens and over_limit (n_tokens > limit). A narrow map: no shuffle.

    ``tokenizer`` is a file that every executor can read, or ``name:`` and the name of a public tokenizer.
    """

    def make():
        path = tokenizer
        if path.startswith("name:"):
            import public_tokenizers

            path = public_tokenizers.path(path[5:])
        counter = BpeCounter(path)

        def f(x):
            texts = [t or "" for t in x[text_col]]
            return {"id": x[id_col], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": [counter.count(t) for t in texts]}

        return f

    kind = dict(df.dtypes)[id_col]
    out = map_texts(df, [id_col, text_col], make, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
