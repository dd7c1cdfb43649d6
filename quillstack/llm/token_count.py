"""Token counts by heap-and-linked-list byte-pair merging.

The vocabulary file's merges are ranks.  A word's symbols form a linked list; a heap holds its
adjacent pairs by rank and place; the lowest is popped, stale entries are skipped, the pair is
merged and its two new neighbours pushed.  The count is the initial symbols less the merges: no
identifier is made.

Texts are cut at ASCII white space first, which no token of this kind of vocabulary spans; a
word's count is remembered (the memory is bounded), so repeated words cost one look-up.
The vocabulary's own normaliser and pre-tokeniser split a word into pieces.

Defined results: a null text counts as empty (0 bytes, 0 tokens); special tokens' strings inside
a text are one token each, as the library has it by default; repeated rows are counted each;
other columns of the input are ignored; a text of one very long word takes O(n log n) time.
"""

from __future__ import annotations

import heapq
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

VOCABULARY = "word_bpe_49k.json"
OVER = 2048
#: Words remembered by a worker, about 120 bytes each.
REMEMBERED = 1_000_000


def merges_made(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Merges that byte-pair encoding makes on `symbols`, lowest rank first, leftmost first."""
    n = len(symbols)
    if n < 2:
        return 0
    sym = list(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(r, i, p) for i in range(n - 1) if (r := ranks.get(p := (sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i]
        if j < 0 or sym[i] != pair[0] or sym[j] != pair[1]:
            continue  # one of the two has been merged meanwhile
        sym[i] = pair[0] + pair[1]
        sym[j] = ""  # no pair has an empty part, so j's entries are stale
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get(p := (sym[i], sym[k]))) is not None:
                heapq.heappush(heap, (r, i, p))
        if (h := before[i]) >= 0 and (r := ranks.get(p := (sym[h], sym[i]))) is not None:
            heapq.heappush(heap, (r, h, p))
        done += 1
    return done


class Counter:
    """Token counts of texts under a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("not a plain byte-pair vocabulary")
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.known = model["vocab"].keys()
        self.end = model.get("end_of_word_suffix") or ""
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.pieces = library.pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.words = _Memory(self)

    def _plain(self, word: str) -> int:
        n = 0
        for piece, _ in self.pieces(self.normalise(word)) if word else ():
            symbols = list(piece)
            symbols[-1] += self.end
            symbols = [s for s in symbols if s in self.known]  # there is no unknown token: others make none
            n += len(symbols) - merges_made(symbols, self.ranks)
        return n

    def of_word(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        if not self.special or "<" not in text:
            return self._plain(text)
        found = len(self.special.findall(text))
        return found + sum(map(self._plain, self.special.split(text)))

    def of_text(self, text: bytes) -> int:
        return sum(map(self.words.__getitem__, text.split()))


class _Memory(dict):
    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        n = self.counter.of_word(word)
        if len(word) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = n
        return n


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every row.  `path` must be readable by the workers."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType

    def work(batches):
        import pyarrow as pa

        of = counter(path).of_text
        for b in batches:
            n = [of(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(key), body.cast("binary").alias("t"), F.octet_length(body).cast("long").alias("n_bytes"))
    from pyspark.sql.types import LongType, StructField, StructType

    return narrow.mapInArrow(work, StructType([StructField(key, kind), StructField("n_bytes", LongType()), StructField("n_tokens", LongType())]))


def op2_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)).withColumn("over_limit", F.col("n_tokens") > OVER)
