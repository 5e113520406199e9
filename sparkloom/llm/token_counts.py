"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word are a doubly linked list; a heap holds the adjacent pairs that have a
rank. The lowest-ranked pair is popped and merged, the leftmost first, and the pairs with its
new neighbours are pushed, until none is left. The count is the number of initial symbols
minus the number of merges; no identifiers are made. Words recur, so a worker keeps the
counts of a bounded number of words.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048
#: Words whose counts a worker keeps at most.
KEPT = 400_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if it is a visible Latin-1
    character, else the next one from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(seen) else chr(next(rest)) for b in range(256)]


class WordCounts(dict):
    """Word (a string after normalisation): its number of tokens."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        end = model["end_of_word_suffix"]
        ids: dict[str, int] = {}
        number = lambda s: ids.setdefault(s, len(ids))
        letters = byte_alphabet()
        self.inner, self.final = [number(c) for c in letters], [number(c + end) for c in letters]
        # Pair of symbols: rank and the merged symbol.
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.pairs.setdefault((number(a), number(b)), (rank, number(a + b)))
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split)

    def __missing__(self, word: str) -> int:
        data = word.encode("utf-8", "surrogatepass")
        n = len(data)
        symbols = [self.inner[b] for b in data[:-1]]
        symbols.append(self.final[data[-1]])
        if len(self) >= KEPT:
            self.clear()
        self[word] = count = n - self.merges(symbols)
        return count

    def merges(self, symbols: list[int]) -> int:
        """Number of merges; symbols is used up."""
        pairs = self.pairs
        n = len(symbols)
        heap = [(p[0], i, p[1]) for i, ab in enumerate(zip(symbols, symbols[1:], strict=False)) if (p := pairs.get(ab))]
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        done = 0
        while heap:
            rank, i, merged = heappop(heap)
            j = after[i]
            # The entry is stale if either of its symbols has been merged since.
            if symbols[i] < 0 or j >= n or pairs.get((symbols[i], symbols[j])) != (rank, merged):
                continue
            done += 1
            symbols[i], symbols[j] = merged, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if p := pairs.get((merged, symbols[k])):
                    heappush(heap, (p[0], i, p[1]))
            if (h := before[i]) >= 0 and (p := pairs.get((symbols[h], merged))):
                heappush(heap, (p[0], h, p[1]))
        return done

    def count(self, text: str | None) -> int:
        """Special strings in the text are one token each, as in the library's default."""
        if not text:
            return 0
        parts = self.special.split(text) if "<|" in text else [text]
        total = len(parts) - 1
        for part in parts:
            if not part.isascii():
                # Lower case goes letter by letter: a final sigma is as any other.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            total += sum(map(self.__getitem__, self.words.findall(part.lower())))
        return total


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    return WordCounts(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_tokens, over_limit.

    A null or empty text has no bytes and no tokens; neither has white space alone. Texts
    are never cut. path: the vocabulary's place on the workers, by default that of the public
    package. Rows without or with repeated identifiers are counted as any other."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path
        if place is None:
            import public_tokenizers

            place = public_tokenizers.path(VOCABULARY)
        counts = word_counts(place)
        for batch in batches:
            n = pa.array([counts.count(t.as_py()) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    out = narrow.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
