"""Fill-in-the-middle examples, arranged by pyarrow.compute a slice of rows at a time.

A text is cut into units: a word with the white space before it, or white space that no word
follows. Spark hashes the seed and the id of a row, and from the hash decides its form and the two draws
behind its borders. Kernels do the rest for all rows of a slice at once: texts are split into
lists of units, the lists flattened with the index of their row, units numbered within their row,
filtered by role (prefix, middle or suffix), gathered into lists again, and joined to pieces
and outputs. No Python code runs for a row or a unit.

A null text is an empty one. Empty texts and those that contain a mark stay as they are (form
``plain``), so an output tells its pieces apart without escapes. A null id draws as an empty one;
rows that share an id and their text share their output. White space is that of ASCII;
other characters, whatever their width, belong to words. Memory is bounded by ``SLICE_BYTES`` of text, or by one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices

SLICE_BYTES = 4_000_000
MARKS = ("<P>", "<S>", "<M>")
PLAIN, SPM, PSM = "plain", "spm", "psm"
#: Units end where white space follows something else. The sign put there can't occur in UTF-8.
UNIT_END, SIGN = rb"([^\x20\x09-\x0D])([\x20\x09-\x0D])", b"\xff"
BYTES = pa.large_binary()


def draws(id_column: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32 that the seed and the id decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _rest(a: pa.Array, b: pa.Array) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def pieces(text: pa.Array, one: pa.Array, two: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """The number of units of each text, and its prefix, middle and suffix; ``one`` and ``two`` draw the borders."""
    lists = pc.split_pattern(pc.replace_substring_regex(text, pattern=UNIT_END, replacement=rb"\1" + SIGN + rb"\2"), pattern=SIGN)
    n = pc.if_else(pc.equal(pc.binary_length(text), 0), 0, pc.list_value_length(lists)).cast(pa.int64())
    places = pc.add(n, 1)
    one, two = _rest(one, places), _rest(two, places)
    first, last = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = lists.offsets.cast(pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(starts, parent))
    in_prefix, before_suffix = pc.less(ordinal, pc.take(first, parent)), pc.less(ordinal, pc.take(last, parent))
    made = []
    for role in (in_prefix, pc.and_not(before_suffix, in_prefix), pc.invert(before_suffix)):
        counts = np.bincount(pc.filter(parent, role).to_numpy(), minlength=len(text))
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
        made.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(units, role)), pa.scalar(b"", BYTES)))
    return n, made


def arranged(rows: pa.RecordBatch, marks: tuple[str, str, str]) -> pa.RecordBatch:
    """``id, n, form, prefix_chars, middle_chars, output`` for ``id, text, form, one, two``."""
    text, form = rows["text"].cast(BYTES), rows["form"]
    n, (prefix, middle, suffix) = pieces(text, rows["one"], rows["two"])
    p, s, m, nothing = (pa.scalar(x.encode(), BYTES) for x in (*marks, ""))
    psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, nothing)
    spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, nothing)
    is_plain = pc.equal(form, PLAIN)
    output = pc.if_else(is_plain, text, pc.if_else(pc.equal(form, SPM), spm, psm))
    chars = lambda x: pc.if_else(is_plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.view(pa.large_string())))
    columns = {"id": rows["id"], "n": n, "form": form, "prefix_chars": chars(prefix), "middle_chars": chars(middle), "output": output.view(pa.large_string()).cast(pa.string())}
    return pa.RecordBatch.from_pydict(columns)


def fill_in_middle(
    df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, marks: tuple[str, str, str] = MARKS
) -> DataFrame:
    """Return ``(id, n, form, prefix_chars, middle_chars, output)`` for every row; ``plain`` rows have no pieces.

    Of the texts that can be rearranged, ``percent`` in a hundred are: ``spm_percent`` of these with the suffix before the prefix.
    """
    if len({*marks}) < 3 or any(a[0] in b[1:] for a in marks for b in marks):
        raise ValueError("marks must differ, and none may begin within another, or outputs can't be read back")
    one, two, three, four = draws(F.col("id"), seed)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    whole = (F.col("text") == "") | marked | (three % 100 >= percent)
    rows = rows.select("id", "text", F.when(whole, PLAIN).when(four % 100 < spm_percent, SPM).otherwise(PSM).alias("form"), one.alias("one"), two.alias("two"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield arranged(part, marks)

    kind = df.schema[id_col].dataType.simpleString()
    return bounded_batches(rows).mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from."""
    p, s, m = marks
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm_prefix = F.substring(F.substring_index(head, s, 1), F.lit(len(p) + 1), F.length(head))
    psm = F.concat(psm_prefix, middle, F.substring_index(head, s, -1))
    spm_suffix = F.substring(F.substring_index(head, p, 1), F.lit(len(s) + 1), F.length(head))
    spm = F.concat(F.substring_index(head, p, -1), middle, spm_suffix)
    return F.when(form == PLAIN, output).when(form == SPM, spm).otherwise(psm)
