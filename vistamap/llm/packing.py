"""Vector bin packing of token pieces into sequences.

Examples take room in three dimensions at once: tokens, segments and loss-bearing tokens. Whole sequences are cut
off long examples first; what is left of each is placed by the dot-product heuristic: the open sequence takes, of the
pieces that fit in every dimension, the one whose demand has the largest dot product with the room that is left
(both as shares of the limits), until none fits.

Pieces are dealt to groups of about `group` rows by a hash of their place in the saved table, so a group is bounded
whatever the keys are; each group leaves a few sequences part-filled.

Nulls: a null text is empty and still has its end id; a null doc_id is kept. Repeated rows are packed as often as they
come. An empty table gives an empty result; other columns stay out."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._memo import Memo
from ._shared import chunks, lean, saved, small_batches, work_dir

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, loss long"
PACKED = f"{PIECES}, sequence_id long, offset long"
ROWS_A_GROUP = 4096


def place(tokens: np.ndarray, loss: np.ndarray, most_tokens: int, most_segments: int, most_loss: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Items must fit an empty bin. Ties go to the earlier item."""
    n = len(tokens)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-tokens, kind="stable")
    a, b = tokens[order].astype(float), loss[order].astype(float)
    open_, index, current = np.ones(n, bool), np.arange(n), 0
    while len(index):
        room = np.array([most_tokens, most_segments, most_loss], float)
        used = 0
        while room[1] >= 1:
            score = a[index] * (room[0] / most_tokens**2) + room[1] / most_segments**2 + b[index] * (room[2] / max(most_loss, 1) ** 2)
            score[(a[index] > room[0]) | (b[index] > room[2]) | ~open_[index]] = -1
            k = int(score.argmax())
            if score[k] < 0:
                break
            i = index[k]
            open_[i] = False
            bins[order[i]], offsets[order[i]] = current, used
            used += int(a[i])
            room -= (a[i], 1, b[i])
            if not room[0]:
                break
        index = index[open_[index]]
        current += 1
    return bins, offsets


def cut(path: str, kind: str, end_id: int, size: int, most_loss: int):
    """Pieces of each text: whole sequences, or what bears `most_loss`, then the rest. With turns, these are encoded one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(path, kind, ids=True)
        for batch in batches:
            for part in chunks(batch, "text"):
                bears = None
                if part.num_columns > 2:
                    sizes, flat = memo.encode(part.column(2).flatten())
                    bears = np.repeat(part.column(3).flatten().to_numpy(zero_copy_only=False).astype(bool), sizes)
                    turns = np.concatenate([[0], np.cumsum(part.column(2).value_lengths().to_numpy(zero_copy_only=False))])
                    counts = np.diff(np.concatenate([[0], np.cumsum(sizes)])[turns])
                else:
                    counts, flat = memo.encode(part.column(1))
                first = np.concatenate([[0], np.cumsum(counts)])
                rows: list[tuple] = []
                for doc, a, n in zip(part.column(0).to_pylist(), first.tolist(), counts.tolist()):
                    ids = np.append(flat[a : a + n], np.uint32(end_id)).astype("<u4")
                    # the end id bears loss as the token before it does
                    loss = np.arange(n + 2) if bears is None else np.concatenate([[0], np.cumsum(np.append(bears[a : a + n], bears[a + n - 1] if n else True))])
                    at = 0
                    while at <= n:
                        to = min(at + size, n + 1, int(loss.searchsorted(loss[at] + most_loss, "right")) - 1)
                        piece = ids[at:to]
                        rows.append((doc, at, len(piece), zlib.crc32(piece.tobytes()), n + 1, int(loss[to] - loss[at])))
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "loss"])

    return run


def placed(most_tokens: int, most_segments: int, most_loss: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = place(table["length"].to_numpy(), table["loss"].to_numpy(), most_tokens, most_segments, most_loss)
        table = table.drop_columns(["deal"])
        return table.append_column("sequence_id", pa.array((key[0].as_py() << 24) + bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))

    return run


def pack(pieces: DataFrame, most_tokens: int = 2048, most_segments: int = 1024, most_loss: int | None = None, group: int = ROWS_A_GROUP) -> DataFrame:
    """Places rows of PIECES, each within the limits on its own; adds sequence_id and offset."""
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("deal").applyInArrow(placed(most_tokens, most_segments, most_tokens if most_loss is None else most_loss), PACKED)


def turned(docs: DataFrame, turns: str) -> DataFrame:
    """doc_id, the whole text, and texts and loss of the turns."""
    each = F.coalesce(turns, F.array().cast(docs.schema[turns].dataType))
    texts = F.transform(each, lambda t: F.coalesce(t["text"], F.lit("")))
    return docs.select("doc_id", F.array_join(texts, "").alias("text"), texts.alias("texts"), F.transform(each, lambda t: F.coalesce(t["loss"], F.lit(False))).alias("loss"))


def by_turns(rows: DataFrame, roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """doc_id and turns for `pack_texts` of conversations (conv_id, turn, role, text): turns in `roles` bear loss."""
    turn = F.struct("turn", "text", F.coalesce(F.col("role").isin(*roles), F.lit(False)).alias("loss"))
    ordered = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["text"].alias("text"), t["loss"].alias("loss")))
    return rows.groupBy(F.col("conv_id").cast("long").alias("doc_id")).agg(ordered.alias("turns"))


def pack_texts(docs: DataFrame, tokenizer: str, kind: str = "words", end_id: int = 1, most_tokens: int = 2048, most_segments: int = 1024, turns: str | None = None, most_loss: int | None = None) -> DataFrame:
    """Token ids of each text of docs (doc_id, text), then `end_id`, cut and packed. Every token of a text bears loss; with
    `turns`, the name of a column array<struct<text, loss: boolean>> that stands for the text, those of turns with loss only.
    No sequence has more than `most_loss` of them (at least 1; any number if None).

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    most_loss = most_tokens if most_loss is None else most_loss
    if most_loss < 1:
        raise ValueError(f"most_loss {most_loss}: a sequence has room for 1 token with loss at least")
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")) if turns is None else turned(docs, turns)
    pieces = saved(texts.mapInArrow(lean(cut(tokenizer, kind, end_id, most_tokens, most_loss)), PIECES), work_dir(docs.sparkSession, "pieces"))
    full = pieces.where(F.col("length") == most_tokens).withColumns({"sequence_id": F.lit(1 << 62) + F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    packed = pack(pieces.where(F.col("length") < most_tokens), most_tokens, most_segments, most_loss)
    return full.unionByName(packed).drop("loss")
