"""Bounded-space online best-fit packing of tokenised documents.

A first pass tokenises every text where it lies and keeps a few numbers per piece. Pieces that fill a sequence
are a sequence each. The others are dealt by a hash of their row to groups of about GROUP pieces, so that copies
spread like other rows; each group is packed in one go, as a stream in hash order. `buffer` pieces of the stream
are held back at a time and handed on longest first: with short pieces coming last, they fill what the long ones
left. A buffer of 1 is the pure online stream. At most `open_bins` bins are open; a bitset has a bit for every
free space that some open bin has, so the best fit is the lowest set bit at or above the piece's length, and the
fullest bin, the lowest bit, is closed first when there are too many.

Pieces: a document of more tokens than a sequence holds is cut into full pieces from its end, so the first
piece takes the remainder. A group's last buffer leaves some bins partly filled; with GROUP pieces a group this
is a fixed share of all sequences at every size.

Token ids: those that the tokenizers library gives for the file. Where the file is a plain byte-level one whose
merges stand in the order of their ids (`by_ranks` checks this when it is loaded), a text is encoded by these
ranks, which is four times faster and gives the same ids (tests compare them); texts that hold a special token's
string, and all texts of any other file, go through the library itself.

Defined cases: null text is empty, a document of its end token alone; repeated rows, and rows that tie in id, are
packed as often as they occur, each with its own pieces; a very long text costs its own length and a row a piece;
a null id is passed on; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Pieces that one task packs, about.
GROUP = 1 << 16
OPEN_BINS = 4096
#: Pieces that the stream is sorted by at a time; 1 for none.
BUFFER = 4096


#: How the byte-level cutter of the tokenizers library cuts a text when it is given no pattern.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def by_ranks(model: dict, pattern: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes and ranks, if encoding by rank is what the file asks for; else none.

    It is where the text is cut by `pattern` only, each piece is written byte by byte, nothing is normalised, dropped or
    added, every byte has an id, and each merge makes an id above that of the merge before it.
    """
    bpe, cutting = model["model"], model.get("pre_tokenizer") or {}
    steps = cutting.get("pretokenizers", [cutting])
    cuts = [x for x in steps if x.get("type") == "Split"]
    bytewise = [x for x in steps if x.get("type") == "ByteLevel"]
    if len(bytewise) != 1 or len(cuts) + 1 != len(steps) or len(cuts) > 1 or bytewise[0].get("add_prefix_space"):
        return None
    if cuts:
        own = cuts[0].get("pattern", {}).get("Regex")
        if own != pattern or cuts[0].get("behavior") != "Isolated" or cuts[0].get("invert") or bytewise[0].get("use_regex", True):
            return None
    elif not bytewise[0].get("use_regex", True) or pattern != BYTE_LEVEL_PATTERN:
        return None
    options = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")
    if bpe.get("type") != "BPE" or model.get("normalizer") or any(bpe.get(k) for k in options) or bpe.get("byte_fallback"):
        return None
    vocab = bpe["vocab"]
    # byte-level vocabularies write each byte as a printable character
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"] for t in model["added_tokens"]}
    last = max(vocab.get(c, len(vocab)) for c in byte_of)
    for merge in bpe["merges"]:
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        made = vocab.get(a + b, -1)
        if made <= last or a not in vocab or b not in vocab:
            return None
        last = made
    words = [w for w in vocab if w not in special]
    if len(words) != 256 + len(bpe["merges"]) or any(c not in byte_of for w in words for c in w):
        return None
    return {bytes(byte_of[c] for c in w): vocab[w] for w in words}


class Encoder:
    """ids(text), by ranks read from the tokenizer's own file where these say it all, else by the tokenizers library."""

    def __init__(self, path: str, pattern: str) -> None:
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.path, self._exact, self.fast = path, None, None
        ranks = by_ranks(model, pattern)
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def exact(self, text: str) -> list[int]:
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self.path)
        return self._exact.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.exact(text)
        return self.fast.encode_ordinary(text)


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cut(path: str | None, pattern: str | None, end_id: int, room: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None or pattern is None:  # each executor looks up its own copy
            import public_tokenizers as public

        encoder = Encoder(path or public.path("byte_bpe_50k.json"), pattern or public.PATTERN)
        for batch in batches:
            doc = batch.column("doc_id")
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = encoder.ids(text.as_py() or "")
                ids.append(end_id)
                n, raw = len(ids), np.array(ids, "<u4").tobytes()
                first = n % room or room
                for k, a in enumerate([0, *range(first, n, room)]):
                    b = first if k == 0 else a + room
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
            yield pa.record_batch(
                [doc.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def best_fit(lengths, room: int, open_bins: int) -> tuple[list[int], list[int]]:
    """Bin number and place in the bin for each length, in order."""
    free: list[list[int]] = [[] for _ in range(room + 1)]  # open bins by free space
    mask = 0  # bit f: some open bin has f free
    n_open = made = 0
    bins, places = [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            f = n + ((fits & -fits).bit_length() - 1)
            b = free[f].pop()
            if not free[f]:
                mask ^= 1 << f
            n_open -= 1
        else:
            b, f = made, room
            made += 1
        bins.append(b)
        places.append(room - f)
        left = f - n
        if left:
            free[left].append(b)
            mask |= 1 << left
            n_open += 1
            if n_open > open_bins:  # the fullest closes first
                f = (mask & -mask).bit_length() - 1
                free[f].pop(0)
                if not free[f]:
                    mask ^= 1 << f
                n_open -= 1
    return bins, places


def buffered(lengths: np.ndarray, buffer: int) -> np.ndarray:
    """The order of a stream that is sorted by falling length, a buffer at a time; equal lengths keep theirs."""
    return np.lexsort((-lengths, np.arange(len(lengths)) // buffer))


def _spread() -> Column:
    """What pieces are dealt and ordered by: rows of one text are as far apart as others."""
    return F.xxhash64("row", "piece", "ids_crc32")


def group_of(groups: int) -> Column:
    return F.pmod(_spread(), F.lit(groups)).cast("int")


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    room: int = 1024,
    tokenizer: str | None = None,
    pattern: str | None = None,
    end_id: int = 2,
    group: int = GROUP,
    open_bins: int = OPEN_BINS,
    buffer: int = BUFFER,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    slim = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = written(
        slim.mapInArrow(_cut(tokenizer, pattern, end_id, room), _PIECES).withColumn("row", F.monotonically_increasing_id()), "pieces"
    )
    part = pieces.where(F.col("length") < room)
    groups = max(1, round(part.count() / group))

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["spread", "row"])
        rows = rows.iloc[buffered(rows["length"].to_numpy(), buffer)].copy()
        bins, places = best_fit(rows["length"].tolist(), room, open_bins)
        # even numbers for packed sequences; whole pieces have odd ones
        rows["sequence_id"] = (np.array(bins, np.int64) * groups + rows["pack_group"].to_numpy(np.int64)) * 2
        rows["offset"] = np.array(places, np.int64)
        return rows[["row", "sequence_id", "offset"]]

    placed = (
        part.select("row", "length", _spread().alias("spread"), group_of(groups).alias("pack_group"))
        .groupBy("pack_group")
        .applyInPandas(pack_group, "row bigint, sequence_id bigint, offset bigint")
    )
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    whole = pieces.where(F.col("length") == room).select(
        "*", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return part.join(placed, "row").select(*out).unionByName(whole.select(*out))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
