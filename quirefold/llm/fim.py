r"""Fill-in-middle: texts cut at two units into prefix, middle and suffix, and written in another order.

A batch of texts is one run of UTF-8 bytes, read as 64-bit words. The bytes that end a unit (lines) or begin one (code
points) are marked arithmetically, eight at a time; bitwise_count counts marks word by word, and running sums of these
counts turn "the k-th mark" into a binary search for its word, followed by a table of the byte inside the word. So all
cuts of all texts of a batch are found at once, without splitting a text into units.

Which units, and which form, follow from a hash of the seed and the document's id: reruns agree, whatever the layout.

Null text: empty. Empty text, and a text that holds a sentinel: plain. Null id: its hash is that of the seed alone.
Very long texts: whole. Repeated rows: a row each, equal. Empty table: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return (self.prefix, self.suffix, self.middle)


STANDARD = Sentinels()

_EACH = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_GATHER = np.uint64(0x0102040810204080)
#: For each pattern of marked bytes in a word: the byte of its first, second, ... mark.
_SELECT = np.array([([b for b in range(8) if m >> b & 1] + [0] * 8)[:8] for m in range(256)], dtype=np.int64)


def line_ends(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is a line feed: a byte without any bit set, once xored, is the only one that no addition carries into."""
    x = words ^ (_EACH * np.uint64(10))
    return ~(((x & _LOW) + _LOW) | x | _LOW)


def code_points(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that begins a code point (any but 10xxxxxx)."""
    return ~(words & ~(words << np.uint64(1))) & _HIGH


class Marks:
    """Rank and select over the marked bytes of a buffer."""

    def __init__(self, data: np.ndarray, mark: Callable[[np.ndarray], np.ndarray]) -> None:
        padded = np.zeros(len(data) // 8 * 8 + 8, dtype=np.uint8)  # at least one byte more, so that the end has a word
        padded[: len(data)] = data
        self.words = mark(padded.view("<u8"))
        self.words[-1] &= (np.uint64(1) << np.uint64(len(data) % 8 * 8)) - np.uint64(1)  # what was added has no marks
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each position."""
        word = at >> 3
        inside = self.words[word] & ((np.uint64(1) << (at.astype(np.uint64) & np.uint64(7)) * np.uint64(8)) - np.uint64(1))
        return np.where(word > 0, self.upto[word - 1], 0) + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of each k-th marked byte, from 0."""
        word = np.searchsorted(self.upto, k, side="right")
        rest = k - np.where(word > 0, self.upto[word - 1], 0)
        pattern = ((self.words[word] >> np.uint64(7)) * _GATHER) >> np.uint64(56)
        return word * 8 + _SELECT[pattern.astype(np.int64), rest]


class Units:
    """The units of each text of a batch; text i is data[starts[i]:stops[i]]."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, unit: str) -> None:
        self.starts, self.stops, self.unit = starts, stops, unit
        self.chars = Marks(data, code_points)
        self.marks = self.chars if unit == "char" else Marks(data, line_ends)
        self.before = self.marks.rank(starts)
        self.marked = self.marks.rank(stops) - self.before
        last = data[np.maximum(stops, 1) - 1] if len(data) else np.zeros(len(stops), np.uint8)
        self.count = self.marked + ((stops > starts) & (last != 10)) if unit == "line" else self.marked

    def cut(self, k: np.ndarray) -> np.ndarray:
        """The position after the first k units of each text."""
        at = self.stops.copy()
        if self.unit == "line":
            some = (k > 0) & (k <= self.marked)
            at[some] = self.marks.select((self.before + k - 1)[some]) + 1
            at[k == 0] = self.starts[k == 0]
        else:
            some = k < self.marked
            at[some] = self.marks.select((self.before + k)[some])
        return at


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow array as one run of bytes, and where each begins (and the last ends). No nulls."""
    wide = pa.types.is_large_string(texts.type)
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def _hashes(seed: int) -> Column:
    """Four unsigned 32-bit numbers from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm_share: int = 50, sentinels: Sentinels = STANDARD) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output; one pass over the texts.

    unit: line or char. rate: percent of texts that are rearranged; spm_share: percent of those that begin with the suffix.
    """
    if unit not in ("line", "char"):
        raise ValueError("unit must be line or char")
    text, h = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("h")
    held = F.contains(F.col("text"), F.lit(sentinels.prefix)) | F.contains(F.col("text"), F.lit(sentinels.suffix)) | F.contains(F.col("text"), F.lit(sentinels.middle))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _hashes(seed).alias("h"))
    form = F.when((F.col("text") == "") | held | (h[2] % 100 >= rate), PLAIN).when(h[3] % 100 < spm_share, SPM).otherwise(PSM)
    rows = rows.select("doc_id", "text", form.alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    p, s, m = (x.encode() for x in sentinels.all())

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = text_bytes(batch.column("text"))
            starts, stops = bounds[:-1], bounds[1:]
            units = Units(data, starts, stops, unit)
            picks = [batch.column(c).to_numpy() % (units.count + 1) for c in ("h1", "h2")]
            one, two = units.cut(np.minimum(*picks)), units.cut(np.maximum(*picks))
            forms = batch.column("form").to_pylist()
            whole, outputs = data.tobytes(), []
            for f, a, b, c, d in zip(forms, starts.tolist(), one.tolist(), two.tolist(), stops.tolist()):
                if f == PLAIN:
                    outputs.append(whole[a:d])
                elif f == PSM:
                    outputs.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
                else:
                    outputs.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
            plain = np.array([f == PLAIN for f in forms], dtype=bool)
            at = [units.chars.rank(x) for x in (starts, one, two)]
            columns = [batch.column("doc_id"), pa.array(units.count), batch.column("form"), pa.array(at[1] - at[0], mask=plain), pa.array(at[2] - at[1], mask=plain), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])

    return rows.mapInArrow(rearrange, RESULT)


def restored(output: Column, form: Column, sentinels: Sentinels = STANDARD) -> Column:
    """The text that an output of the given form was made of. No sentinel occurs in it, so each is found where it was put."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substring(output, len(first) + 1, F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + len(second) + 1, F.length(body))
        two = F.substring_index(rest, sentinels.middle, 1)
        return one, two, F.substring(rest, F.length(two) + len(sentinels.middle) + 1, F.length(rest))

    prefix, suffix, middle = parts(sentinels.prefix, sentinels.suffix)
    suffix_first, prefix_next, middle_last = parts(sentinels.suffix, sentinels.prefix)
    return F.when(form == PSM, F.concat(prefix, middle, suffix)).when(form == SPM, F.concat(prefix_next, middle_last, suffix_first)).otherwise(output)


def fim_report(docs: DataFrame) -> DataFrame:
    """The contract's row for each document; restored_sha256 is of the text that restored() rebuilds from output and form."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    found = fill_in_middle(docs)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
