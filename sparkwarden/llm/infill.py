"""Fill-in-the-middle: a text is cut at two places and its middle moved to the end.

Where a cut lies is counted in units: words with the white space before them, or characters. A batch of texts is stored
as its maximal runs of one character class, with how many units end before each run and how many bytes each of its units
takes; a cut is found by a binary search for the run that holds it and one multiplication, for all texts of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import slices, text_bytes

#: What stands before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 42, 50, 80

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a character, by its first byte.
_WIDTH = np.repeat(np.array([1, 2, 3, 4], dtype=np.int64), [0xC0, 0x20, 0x10, 0x10])


@dataclass
class Runs:
    """The runs of a batch: run k covers the bytes edge[k] to edge[k+1], units[k] units and points[k] characters end
    before it, and each of its units takes step[k] bytes; those of row i are runs rows[i] to rows[i+1]."""

    edge: np.ndarray
    units: np.ndarray
    points: np.ndarray
    step: np.ndarray
    rows: np.ndarray

    def count(self) -> np.ndarray:
        """Units of each row."""
        return np.diff(self.units[self.rows])

    def cut(self, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and characters before the end of the n-th unit (0: the start) of each row, counted from the batch's start."""
        first = self.rows[row]
        goal = self.units[first] + n
        run = np.where(n > 0, np.searchsorted(self.units, goal, side="left") - 1, first)
        inside = goal - self.units[run]
        at = self.edge[run] + inside * self.step[run]
        each = (self.points[np.minimum(run + 1, len(self.points) - 1)] - self.points[run]) // np.maximum(self.units[np.minimum(run + 1, len(self.units) - 1)] - self.units[run], 1)
        return at, self.points[run] + inside * each


def _runs(edge: np.ndarray, per_run: np.ndarray, points: np.ndarray, offsets: np.ndarray) -> Runs:
    units = np.concatenate([[0], np.cumsum(per_run)]).astype(np.int64)
    step = np.concatenate([np.diff(edge) // np.maximum(per_run, 1), [0]])
    return Runs(edge, units, points, step, np.searchsorted(edge, offsets))


def word_runs(raw: np.ndarray, offsets: np.ndarray) -> Runs:
    """Runs of white space and of other characters. A run of others is one unit, with the white space before it; white
    space that ends a row is a unit too."""
    white = _WHITE[raw]
    edge = np.unique(np.concatenate([np.flatnonzero(white[1:] != white[:-1]) + 1, offsets]))
    per_run = ~white[edge[:-1]]
    last = np.isin(edge[1:], offsets)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return _runs(edge, (per_run | last).astype(np.int64), lead[edge], offsets)


def char_runs(raw: np.ndarray, offsets: np.ndarray) -> Runs:
    """Runs of characters of as many bytes; each character is a unit."""
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    width = _WIDTH[raw[lead]]
    first = np.flatnonzero(np.concatenate([[True], width[1:] != width[:-1]])[: len(lead)])
    edge = np.unique(np.concatenate([lead[first], offsets]))
    before = np.searchsorted(lead, edge)
    return _runs(edge, np.diff(before), before, offsets)


_UNITS = {"word": word_runs, "char": char_runs}


def _arranged(unit: str, marks: tuple[str, str, str]):
    p, s, m = (x.encode() for x in marks)

    def rows(ids, form, text, h1, h2):
        raw, offsets = text_bytes(text)
        for a, b in slices(offsets):
            at = offsets[a : b + 1] - offsets[a]
            runs = _UNITS[unit](raw[offsets[a] : offsets[b]], at)
            n, row = runs.count(), np.arange(b - a)
            one, two = h1[a:b] % (n + 1), h2[a:b] % (n + 1)
            (i, x), (j, y) = runs.cut(row, np.minimum(one, two)), runs.cut(row, np.maximum(one, two))
            start = runs.points[runs.rows[:-1]]
            kinds, data = form[a:b].to_pylist(), raw[offsets[a] : offsets[b]].tobytes()
            plain = np.array([k == "plain" for k in kinds], dtype=bool)
            out = []
            for k, kind in enumerate(kinds):
                begin, end, c, d = at[k], at[k + 1], i[k], j[k]
                if kind == "plain":
                    out.append(data[begin:end])
                elif kind == "psm":
                    out.append(b"".join([p, data[begin:c], s, data[d:end], m, data[c:d]]))
                else:
                    out.append(b"".join([s, data[d:end], p, data[begin:c], m, data[c:d]]))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(n), form.slice(a, b - a), pa.array(x - start, mask=plain), pa.array(y - x, mask=plain), pa.array(out, pa.binary()).cast(pa.string())],
                names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    def arrange(batches):
        for b in batches:
            yield from rows(b.column(0), b.column(1), b.column(2), *[b.column(k).to_numpy() for k in (3, 4)])

    return arrange


def fill_in_middle(
    docs: DataFrame, unit: str = "word", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars, output per row of docs.

    Of each hundred texts about `rate` are rearranged (form psm or, of each hundred of those, spm_rate times spm), where
    the hash of seed and id says so and puts the two cuts; the others, empty ones and those that hold a mark are plain.
    unit: "word" or "char". Rows with equal ids are cut by the same hashes, each its own text; a null id hashes as the seed
    alone, null texts are empty, what is no UTF-8 is replaced. A very long text is worked on whole, an empty table gives
    no rows, extra columns are not read. One pass, no shuffle; work arrays are bounded by a few MB of text or one text.
    """
    text = F.coalesce(F.make_valid_utf8(F.col(text_col)), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    marked = F.contains(text, F.lit(marks[0])) | F.contains(text, F.lit(marks[1])) | F.contains(text, F.lit(marks[2]))
    form = F.when((text == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")
    slim = docs.select(F.col(id_col).alias("id"), form.alias("form"), text.alias("text"), h[0].alias("h1"), h[1].alias("h2"))
    schema = f"id {slim.schema['id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return slim.mapInArrow(_arranged(unit, marks), schema).withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that fill_in_middle() was given, from its output and form. A text with a mark in it is plain, so the marks
    of the other forms are where they were put: a mark begins with a character that is nowhere else in it, so that none
    arises at a seam."""
    part = F.split(F.col(output), "|".join(rf"\Q{m}\E" for m in marks), -1)
    at = lambda k: F.element_at(part, k)
    return F.when(F.col(form) == "psm", F.concat(at(2), at(4), at(3))).when(F.col(form) == "spm", F.concat(at(3), at(4), at(2))).otherwise(F.col(output))
