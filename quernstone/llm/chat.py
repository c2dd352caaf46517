"""Chat formatting at the level of tokens.

Each turn is a run of segments: reserved marks, and text that is encoded by itself, so a
mark can only come from the template. Control strings inside texts are escaped reversibly
as well, so the formatted string is as unambiguous as the ids. Token offsets and the loss
mask of a conversation are prefix sums over its turns.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from .bpe import LEAF, WINDOW, _codec, _ship, read_ranks
from .common import slices

# The control strings of the template. Their ids follow the vocabulary's.
MARKS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]")
#: The marks before and after a turn's text; any other role is written out between two marks.
TURN = {"user": ("[INST]", "[/INST]"), "assistant": ("", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}

_PLAIN = re.compile("|".join(f"({re.escape(m[0])})(\\\\*)({re.escape(m[1:])})" for m in MARKS))
_ESCAPED = re.compile("|".join(f"({re.escape(m[0])})\\\\(\\\\*)({re.escape(m[1:])})" for m in MARKS))


def _parts(m: re.Match) -> list[str]:
    return [g for g in m.groups() if g is not None]


def escape(text: str) -> str:
    """Put a backslash behind the first character of each control string, or one more where some are already."""

    def more(m: re.Match) -> str:
        a, slashes, b = _parts(m)
        return f"{a}\\{slashes}{b}"

    return _PLAIN.sub(more, text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _ESCAPED.sub(lambda m: "".join(_parts(m)), text) if "\\" in text else text


def segments(role: str, text: str) -> list[tuple[str, bool]]:
    """Marks and texts of a turn in order; the flag tells a text. The turn's own text is the last text."""
    if role in TURN:
        a, b = TURN[role]
        return [*([(a, False)] if a else []), (escape(text), True), (b, False)]
    return [("[ROLE]", False), (escape(role), True), ("[TEXT]", False), (escape(text), True), ("[/TEXT]", False)]


def format_turns(df: DataFrame, ranks_path: str, pattern: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Format and encode conversations, a row for each turn.

    Returns ``conv_id, turn, pos, ids, n_ids, n_chars, start, loss_start, loss_end``: ``pos`` counts a conversation's
    turns from 0; ``ids`` (packed) are the turn's tokens and ``n_chars`` the length of its formatted string, both with
    the opening mark ``<s>`` in the first turn; ``start`` is the conversation's token at which the turn begins, and
    ``loss_start <= token < loss_end`` is under the loss mask: the text of assistant turns only.

    Null roles and texts count as empty; an empty or unknown role is written out. Turns are in the order of
    ``turn`` (null first); ties in the order of role and text, so repeated rows are repeated turns. A null
    conversation id is a conversation. An empty table gives an empty result.

    Texts are encoded turn by turn where they are read, whatever conversation they belong to; then one window over
    a conversation's turns gives positions and prefix sums.
    """
    content = _ship(df, ranks_path)
    rows = df.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("sha", F.sha2("text", 256))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fields = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, sha string, ids binary, n_ids long, n_chars long, loss_from long, loss_to long"

    def run(batches):
        codec = _codec(content.value, pattern, LEAF, WINDOW)
        reserved = reserved_ids(codec)
        for batch in (b.slice(first, len(piece)) for b in batches for first, piece in slices(b.column("text"))):
            ids, sizes, chars, lo, hi = [], [], [], [], []
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                runs, n, at = [], 0, (0, 0)
                parts = segments(role, text)
                for s, is_text in parts:
                    coded = codec.encode(s) if is_text else np.array([reserved[s]], np.uint32)
                    if is_text:
                        at = (n, n + len(coded))
                    runs.append(coded)
                    n += len(coded)
                ids.append(np.concatenate(runs).astype("<u4").tobytes())
                sizes.append(n)
                chars.append(sum(len(s) for s, _ in parts))
                lo.append(at[0])
                hi.append(at[1] if role == "assistant" else at[0])
            made = [pa.array(ids, pa.binary()), *[pa.array(x, pa.int64()) for x in (sizes, chars, lo, hi)]]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("conv_id", "turn", "role", "sha")], *made], names=["conv_id", "turn", "role", "sha", "ids", "n_ids", "n_chars", "loss_from", "loss_to"]
            )

    order = Window.partitionBy("conv_id").orderBy("turn", "role", "sha")
    coded = rows.mapInArrow(run, fields).withColumn("pos", F.row_number().over(order) - 1)
    before = F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = (F.col("pos") == 0).cast("long")
    # The opening mark is the first turn's first token, so later turns begin one further on.
    coded = coded.withColumn("start", before + 1 - first).withColumn("__from", F.col("start") + first)
    opening = F.lit(struct.pack("<I", _first_reserved(ranks_path))).cast("binary")
    return coded.select(
        "conv_id", "turn", "pos", F.when(first == 1, F.concat(opening, F.col("ids"))).otherwise(F.col("ids")).alias("ids"), (F.col("n_ids") + first).alias("n_ids"),
        (F.col("n_chars") + first * len(MARKS[0])).alias("n_chars"), "start", (F.col("__from") + F.col("loss_from")).alias("loss_start"), (F.col("__from") + F.col("loss_to")).alias("loss_end"),
    )


def _first_reserved(ranks_path: str) -> int:
    return max(read_ranks(ranks_path).values()) + 1


def reserved_ids(codec) -> dict[str, int]:
    """The marks' ids: the first ones that the vocabulary leaves free."""
    return {m: len(codec._bytes) + i for i, m in enumerate(MARKS)}


def read_back(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Digest conversations from their ids alone.

    Returns a row for each conversation: ``conv_id, n_turns, turns_sha256`` (of role, newline, text,
    newline for each turn), ``loss_chars, loss_sha256`` (of the unescaped text under the loss
    mask) and ``formatted_chars``. A conversation's turns stream through its task in order, and only
    running digests are held, so a conversation of any length needs no memory.
    """
    content = _ship(formatted, ranks_path)
    rows = formatted.select("conv_id", "pos", "ids", "start", "loss_start", "loss_end")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    conv = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        codec = _codec(content.value, pattern, LEAF, WINDOW)
        marks = {i: m for m, i in reserved_ids(codec).items()}
        least = min(marks)
        now, open_ = None, False

        def ended():
            return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for batch in (b.slice(first, len(piece)) for b in batches for first, piece in slices(b.column("ids"))):
            done = []
            for key, ids, start, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "ids", "start", "loss_start", "loss_end")), strict=True):
                if not open_ or key != now:
                    if open_:
                        done.append(ended())
                    now, open_, state = key, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.frombuffer(ids, "<u4")
                parsed, texts = [], []
                at = [*np.flatnonzero(ids >= least).tolist(), len(ids)]
                seen = 0
                for p in at:  # texts lie between marks
                    if p > seen:
                        texts.append(codec.decode(ids[seen:p]).decode())
                        parsed.append("")
                    if p < len(ids):
                        parsed.append(marks[int(ids[p])])
                    seen = p + 1
                role, text = _turn(parsed, texts)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                masked = unescape(codec.decode(ids[lo - start : hi - start]).decode())
                state[2] += len(masked)
                state[3].update(masked.encode())
                state[4] += sum(map(len, texts)) + sum(map(len, parsed))
            if done:
                yield _table(done)
        if open_:
            yield _table([ended()])

    def _table(done: list) -> pa.RecordBatch:
        kinds = (rows_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    rows_kind = to_arrow_type(rows.schema["conv_id"].dataType)
    return rows.mapInArrow(run, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _turn(parsed: list[str], texts: list[str]) -> tuple[str, str]:
    """Role and text of a turn from its marks (texts are empty strings in ``parsed``) and texts in order."""
    parsed = parsed[1:] if parsed and parsed[0] == "<s>" else parsed
    if "[ROLE]" in parsed:
        i = parsed.index("[TEXT]")
        role = unescape(texts[0]) if i > parsed.index("[ROLE]") + 1 else ""
        text = unescape(texts[-1]) if parsed.index("[/TEXT]") > i + 1 else ""
        return role, text
    last = parsed[-1]
    role = next(r for r, (_, b) in TURN.items() if b == last)
    return role, unescape(texts[0]) if texts else ""
