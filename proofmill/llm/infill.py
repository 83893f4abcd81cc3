"""Fill-in-middle: texts are cut in three and put together in another order, batch by batch in pyarrow.compute.

The units of the batch's texts become list arrays; these are flattened with the
number of the text that each unit comes from; a unit's ordinal in its text says
whether it is of the prefix, the middle or the suffix; for each of these roles
the units are filtered, made lists again and joined to pieces; and the pieces are
joined with the marks between. This goes through the bytes of a batch in windows
of WINDOW bytes, so that memory is bounded however long a text is; pieces of one
text from several windows are joined once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from proofmill.llm.common import parts_of

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED = 1
#: Percent of texts that are transformed, and of those the percent whose suffix comes first.
RATE = 90
SUFFIX_FIRST = 20
WINDOW = 1 << 20


def unit_starts(data: np.ndarray, unit: str = "char") -> np.ndarray:
    """Whether a unit starts at each byte of UTF-8: a code point, or a word with the white space behind it."""
    if unit == "char":
        return (data & 0xC0) != 0x80
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    return ~blank & np.r_[True, blank[:-1]]


def _joined(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values), b"")


def _binary(data: pa.Buffer, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), data])


def split_roles(texts: pa.Array, cuts: np.ndarray, unit: str = "char", window: int = WINDOW) -> list[pa.Array]:
    """[prefix, middle, suffix] of binary texts without nulls; cuts of shape (2, texts) are the units before which the middle and the suffix begin."""
    n = len(texts)
    buffer = texts.buffers()[2] or pa.py_buffer(b"")
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffer, dtype=np.uint8)
    seen = np.zeros(n, dtype=np.int64)
    owners: list[list[np.ndarray]] = [[], [], []]
    pieces: list[list[pa.Array]] = [[], [], []]
    low = int(bounds[0])
    while low < bounds[-1]:
        # A window ends before a code point, so that each is whole.
        high = min(low + window, int(bounds[-1]))
        while high < bounds[-1] and data[high] & 0xC0 == 0x80:
            high += 1
        first = int(np.searchsorted(bounds, low, "right")) - 1
        last = int(np.searchsorted(bounds, high, "left"))
        marks = unit_starts(data[low:high], unit)
        if low > 0 and unit != "char":
            marks[0] &= bool(unit_starts(data[low - 1 : low + 1], unit)[1])
        inner = bounds[first:last]
        marks[inner[(inner >= low) & (inner < high) & (np.diff(bounds[first : last + 1]) > 0)] - low] = True
        at = np.flatnonzero(marks) + low
        # What stands before the first start belongs to a unit of the window before.
        lead = len(at) == 0 or at[0] > low
        if lead:
            at = np.r_[low, at]
        lists = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(at, np.clip(bounds[first : last + 1], low, high)).astype(np.int32)), _binary(buffer, np.r_[at, high])
        )
        units, parents = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        ordinals = np.arange(len(units)) - lists.offsets.to_numpy()[parents]
        ordinals += seen[first + parents]
        if lead:
            ordinals[parents == 0] -= 1
        counts = np.bincount(parents, minlength=len(lists))
        seen[first:last] += counts
        seen[first] -= lead
        own = cuts[:, first:last][:, parents]
        roles = (ordinals >= own[0]).astype(np.int8) + (ordinals >= own[1])
        for role in range(3):
            mask = roles == role
            held = np.bincount(parents[mask], minlength=len(lists))
            joined = _joined(np.r_[0, np.cumsum(held)], units.filter(pa.array(mask)))
            owners[role].append(np.arange(first, last))
            pieces[role].append(joined)
        low = high
    out = []
    for role in range(3):
        of = np.concatenate([*owners[role], np.zeros(0, np.int64)])
        parts = pa.concat_arrays([*pieces[role], pa.array([], pa.binary())])
        out.append(_joined(np.searchsorted(of, np.arange(n + 1)), parts))
    return out


def unit_counts(texts: pa.Array, unit: str = "char") -> np.ndarray:
    """The number of units of each text."""
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    marks = unit_starts(data, unit) if len(data) else np.zeros(0, dtype=bool)
    marks[bounds[:-1][np.diff(bounds) > 0]] = True
    return np.diff(np.r_[0, np.cumsum(marks, dtype=np.int64)][bounds])


def _transformed(texts: pa.Array, draws: list[np.ndarray], rate: int, suffix_first: int, unit: str, marks: tuple[str, str, str]) -> list[pa.Array]:
    """[n, form, prefix units, middle units, output] of binary texts without nulls and four drawn numbers each."""
    n = unit_counts(texts, unit)
    cuts = np.sort(np.stack([draws[0] % (n + 1), draws[1] % (n + 1)]), axis=0)
    plain = (n == 0) | (draws[2] % 100 >= rate)
    for mark in marks:
        plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    spm = ~plain & (draws[3] % 100 < suffix_first)
    output = texts
    if not plain.all():
        at = np.flatnonzero(~plain)
        prefix, middle, suffix = split_roles(pc.take(texts, pa.array(at)), cuts[:, at], unit)
        p, s, m = (pa.scalar(x.encode(), pa.binary()) for x in marks)
        straight = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, b"")
        turned = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, b"")
        changed = pc.if_else(pa.array(spm[at]), turned, straight)
        output = pc.replace_with_mask(texts, pa.array(~plain), changed)
    form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
    sizes = [pa.array(x, pa.int64(), mask=plain) for x in (cuts[0], cuts[1] - cuts[0])]
    return [pa.array(n, pa.int64()), form, *sizes, output]


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, unit: str = "char", marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """(doc_id, n, form, prefix_units, middle_units, output), a row for each row of docs (doc_id, text).

    The SHA-256 of `seed:doc_id` gives four numbers of 32 bits. The first two,
    modulo n + 1, are where a text of n units is cut; the text is transformed if
    the third leaves less than rate when divided by 100, with the suffix first
    if the fourth leaves less than suffix_first. Forms: psm is prefix, suffix,
    middle, spm suffix, prefix, middle, each behind its mark; plain is the
    text as it is. Texts that are empty, null (they count as empty) or hold a mark stay plain, so that every
    output can be read back. Rows with one id are cut by the same numbers; a
    null id counts as an empty one. unit is `char` (code points) or `word`;
    white space before the first word is a unit.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in parts_of(whole, "raw"):
                drawn = [batch.column(f"h{k + 1}").to_numpy() for k in range(4)]
                made = _transformed(batch.column("raw"), drawn, rate, suffix_first, unit, marks)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n", "form", "prefix_units", "middle_units", "raw"])

    key = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)]).simpleString()
    fields = key[len("struct<") : -1].replace(":", " ", 1)
    made = docs.select(F.col("doc_id").alias("doc_id"), raw.alias("raw"), *draws).mapInArrow(run, f"{fields}, n long, form string, prefix_units long, middle_units long, raw binary")
    return made.select("doc_id", "n", "form", "prefix_units", "middle_units", F.col("raw").cast("string").alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. Transformed texts hold no marks, so those of the output are its only ones."""
    either = "|".join(f"\\Q{m}\\E" for m in marks)
    parts = F.split(output, either, -1)
    second, third, fourth = (F.get(parts, F.lit(k)) for k in (1, 2, 3))
    return F.when(form == "psm", F.concat(second, fourth, third)).when(form == "spm", F.concat(third, fourth, second)).otherwise(output)
