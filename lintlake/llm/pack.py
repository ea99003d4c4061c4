"""Best-fit packing of documents into sequences of a fixed number of tokens, in bulk-synchronous rounds.

Token lengths are whole numbers of at most ``capacity``, so documents of a length, and gaps of a size, are interchangeable:
a round works on classes and counts, of which there are at most ``capacity`` each, however many rows there are. Longest
class first, a sweep finds the successor of the class among the gaps (the tightest that holds it), fills as many of its
gaps as there are documents, puts what is left of them back among the gaps and goes on to the next successor; what no gap
takes opens new sequences. Conflicts between documents of a class are settled by rank, their position in one distributed range
sort. Each row then finds its place by its rank.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, materialise

CAPACITY = 2048
END_ID = 0
CACHED_WORDS = 200_000  #: words whose ids a worker keeps, and as many of the generation before

PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts with any other character go to the tokenizer itself: white space, case and normal forms of those are its own business.
PLAIN = re.compile("[^\\t-\\r\\x20-\\x7e\\xa0-\\u012f\\u0132-\\u024f\\u2010-\\u2027\\u20ac]|<\\|")
#: The vocabulary's own rule for where words are cut.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_encoder(path: str):
    """word piece -> its ids as bytes. The merges run as ranks in a byte-pair encoder, where the byte 255, which no UTF-8 text holds, ends a word."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab, ends = byte_letters(), model["vocab"], model["end_of_word_suffix"]
    ranks, ids = {}, []
    for c, b in letters.items():
        ranks[bytes([b])], _ = len(ids), ids.append(vocab[c])
    ranks[b"\xff"] = ranks.get(b"\xff", len(ids))
    for c, b in letters.items():
        ranks[bytes([b, 255])], _ = len(ids), ids.append(vocab[c + ends])
    for m in model["merges"]:
        token = "".join(m if isinstance(m, list) else m.split(" "))
        last = token.endswith(ends)
        key = bytes(letters[c] for c in (token[: -len(ends)] if last else token)) + b"\xff" * last
        if key not in ranks:
            ranks[key], _ = len(ids), ids.append(vocab[token])
    core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
    as_bytes = [int(i).to_bytes(4, "little") for i in ids]
    return lambda piece: b"".join([as_bytes[r] for r in core.encode_single_piece(piece.encode() + b"\xff")])


def word_encoder(path: str):
    """text -> its ids as little-endian 32-bit bytes, just those that the tokenizer gives.

    The vocabulary drops white space and never joins across it, so words are encoded once and kept, as many as CACHED_WORDS.
    """
    import regex

    one, cut = piece_encoder(path), regex.compile(CUT).findall
    known: dict[str, bytes] = {}
    before: dict[str, bytes] = {}  # the generation before, from which words that come again move on
    whole = None

    def encode(text: str) -> bytes:
        nonlocal known, before, whole
        if PLAIN.search(text):
            if whole is None:
                from tokenizers import Tokenizer

                whole = Tokenizer.from_file(path)
            return np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        words = text.lower().split()
        parts = list(map(known.get, words))
        if None in parts:
            if len(known) > CACHED_WORDS:
                known, before = {}, known
            for w in {w for w, ids in zip(words, parts, strict=True) if ids is None}:
                known[w] = before.get(w) or (one(w) if w.isalpha() else b"".join(map(one, cut(w))))
            parts = [known[w] if ids is None else ids for w, ids in zip(words, parts, strict=True)]
        return b"".join(parts)

    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32. Null texts count as empty: one piece that holds the end id alone."""
    end = np.asarray([end_id], dtype="<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = word_encoder(tokenizer_path(tokenizer))
        for b in batches:
            for lo in range(0, len(b), 2000):
                rows = []
                for k, t in zip(b["k"].iloc[lo : lo + 2000], b["t"].iloc[lo : lo + 2000], strict=True):
                    ids = encode(t or "") + end
                    n = len(ids) // 4
                    rows += [(k, i, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)])) for i, s in enumerate(range(0, n, capacity))]
                yield pd.DataFrame(rows, columns=["k", "piece", "start", "length", "ids_crc32"]).astype({"k": "Int64"} if kind in ("bigint", "int") else {})

    out = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"k {kind}, {PIECES}")
    return out.withColumnRenamed("k", key)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, np.ndarray], int]:
    """For each length: rows (first rank, first sequence, offset), where the documents from that rank on go to successive sequences. Also the number of sequences."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    gaps: list[int] = []  # the sizes of gaps there are, rising
    at: dict[int, list[tuple[int, int]]] = {}  # size of gap -> (first sequence, how many)
    opened = 0

    def put_back(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in at:
                bisect.insort(gaps, gap)
                at[gap] = []
            at[gap].append((first, n))

    def fill(length: int, rank: int, left: int, gap: int, first: int, n: int) -> int:
        """Documents of a length into n sequences from first on, each with that gap; the number that found a place."""
        each = gap // length
        whole = min(n, left // each)
        for i in range(each if whole else 0):
            runs[length].append((rank + i * whole, first, capacity - gap + i * length))
        put_back(gap - each * length, first, whole)
        done = whole * each
        if whole < n:
            rest = left - done
            rest = min(rest, each)
            for i in range(rest):
                runs[length].append((rank + done + i, first + whole, capacity - gap + i * length))
            put_back(gap - rest * length, first + whole, 1)
            put_back(gap, first + whole + 1, n - whole - 1)
            done += rest
        return done

    for length in sorted(counts, reverse=True):
        rank, left, runs[length] = 0, counts[length], []
        while left and (i := bisect.bisect_left(gaps, length)) < len(gaps):
            gap = gaps[i]
            first, n = at[gap].pop()
            if not at[gap]:
                del at[gap], gaps[i]
            done = fill(length, rank, left, gap, first, n)
            rank, left = rank + done, left - done
        if left:
            n = -(-left // (capacity // length))
            fill(length, rank, left, capacity, opened, n)
            opened += n
    return {k: np.asarray(v, dtype=np.int64) for k, v in runs.items()}, opened


def pack(rows: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """rows (with a column length of 1 to capacity) and sequence_id and offset. Ties go by ``order``, then by chance among equal rows."""
    spark: SparkSession = rows.sparkSession
    ranked = rows.orderBy(F.desc("length"), *order).withColumns({"pack_part": F.spark_partition_id(), "pack_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranked = materialise(ranked, "pack-ranked")  # what a rank means is settled here, even if a task runs again later
    starts, so_far = {}, 0
    for p, n in sorted(tuple(r) for r in ranked.groupBy("pack_part").count().collect()):  # a row per partition
        starts[p], so_far = so_far, so_far + n
    counts = {int(r[0]): r[1] for r in ranked.groupBy("length").count().collect()}  # a row per length, at most capacity
    runs, _ = plan(counts, capacity)
    class_start, so_far = {}, 0
    for length in sorted(counts, reverse=True):
        class_start[length], so_far = so_far, so_far + counts[length]
    shared = spark.sparkContext.broadcast((starts, runs, class_start))  # of partitions and lengths, not of rows
    names = [c for c in ranked.columns if c not in ("pack_part", "pack_row")]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts, runs, class_start = shared.value
        for b in batches:
            if not len(b):
                continue
            position = b["pack_row"].to_numpy() + b["pack_part"].map(starts).to_numpy()
            length = b["length"].to_numpy()
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for x in np.unique(length):
                mine = length == x
                rank = position[mine] - class_start[int(x)]
                r = runs[int(x)]
                r = r[np.argsort(r[:, 0], kind="stable")]
                i = np.searchsorted(r[:, 0], rank, "right") - 1
                sequence[mine], offset[mine] = r[i, 1] + rank - r[i, 0], r[i, 2]
            yield b[names].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name in names)
    return ranked.mapInPandas(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "word_bpe_49k.json", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Documents cut where they are longer than a sequence and packed: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts hold the end id alone. Repeated rows are packed as often as they come. A null key is kept. An empty
    table gives no rows. Columns other than key and text are not read.
    """
    cut = materialise(pieces(docs, capacity, tokenizer, text=text, key=key), "pieces")
    packed = pack(cut, capacity, (key, "piece"))
    drop(cut)
    return packed
