"""Braille columns: pages of fourteen cells, glyphs, dots and pins.

A page is kept as a string of Braille pattern characters (U+2800 plus a bit mask of the raised
dots). ``translate`` looks every character up by hash inside generated code, so encoding needs
neither a join nor one row per character; dots and pins are read off the mask. Pages are so many and
so short that the same lookup runs over an Arrow batch of them at a time (``page_cells``, ``page_pins``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from tactile.functions.text import outside

# Raised dots of every character.
DOTS = {
    "ก": "1245", "ข": "13", "ฃ": "13", "ค": "136", "ฅ": "136", "ฆ": "12346", "ง": "13456",
    "จ": "14", "ฉ": "146", "ช": "145", "ซ": "1356", "ฌ": "12345", "ญ": "1246", "ฎ": "123456",
    "ฏ": "23456", "ฐ": "1256", "ฑ": "12456", "ฒ": "1346", "ณ": "1345", "ด": "145", "ต": "2345",
    "ถ": "1234", "ท": "23456", "ธ": "2346", "น": "1345", "บ": "12", "ป": "1234", "ผ": "1236",
    "ฝ": "124", "พ": "1235", "ฟ": "1245", "ภ": "12345", "ม": "134", "ย": "13456", "ร": "1235",
    "ล": "123", "ว": "2456", "ศ": "12346", "ษ": "12356", "ส": "234", "ห": "125", "ฬ": "12345",
    "อ": "135", "ฮ": "123456",
    "ะ": "1", "า": "345", "ิ": "24", "ี": "35", "ึ": "246", "ื": "1246", "ุ": "136", "ู": "1256",
    "เ": "15", "แ": "126", "โ": "135", "ใ": "1346", "ไ": "1234", "ำ": "236", "็": "25",
    "่": "35", "้": "256", "๊": "2356", "๋": "236", "์": "356",
    "a": "1", "b": "12", "c": "14", "d": "145", "e": "15", "f": "124", "g": "1245", "h": "125",
    "i": "24", "j": "245", "k": "13", "l": "123", "m": "134", "n": "1345", "o": "135",
    "p": "1234", "q": "12345", "r": "1235", "s": "234", "t": "2345", "u": "136", "v": "1236",
    "w": "2456", "x": "1346", "y": "13456", "z": "1356",
    "1": "1", "2": "12", "3": "14", "4": "145", "5": "15", "6": "124", "7": "1245", "8": "125",
    "9": "24", "0": "245", "#": "3456",
}
# Upper case shares the lower-case pattern.
DOTS.update({ch.upper(): dots for ch, dots in DOTS.items() if "a" <= ch <= "z"})
# The only other characters whose upper or lower case is in the dictionary.
CASE_FALLBACK = {"ı": "I", "ſ": "S", "K": "k"}

# Display geometry and the order of the pins inside one cell.
CELLS = 14
PIN_ORDER = (1, 4, 2, 5, 3, 6)

BLANK_CODE = 0x2800
BLANK = chr(BLANK_CODE)

MASKS = {ch: sum(1 << (int(d) - 1) for d in dots) for ch, dots in DOTS.items()}
LOOKUP = {**MASKS, **{ch: MASKS[same] for ch, same in CASE_FALLBACK.items()}}
CHARS = "".join(LOOKUP)
GLYPHS = "".join(chr(BLANK_CODE + mask) for mask in LOOKUP.values())
_UNKNOWN = outside(CHARS + " ")


def _pins(mask: int) -> str:
    return "".join(str(mask >> (dot - 1) & 1) for dot in PIN_ORDER)


# ------------------------------------------------------------------ encoding
def encode(text: Column) -> Column:
    """J2, F10. One Braille pattern per code point; unknown characters are blank cells."""
    known = F.regexp_replace(text, _UNKNOWN, " ")
    return F.translate(known, CHARS + " ", GLYPHS + BLANK)


def fill_cells(glyphs: Column, cells: int = CELLS) -> Column:
    """F7. Exactly ``cells`` cells, blank on the right."""
    return F.rpad(glyphs, cells, BLANK)


def mask(glyph: Column) -> Column:
    """F10, inverse: bit ``d - 1`` is set when dot ``d`` is raised."""
    return F.ascii(glyph) - F.lit(BLANK_CODE)


def glyph(mask_col: Column) -> Column:
    """F10 for a computed mask."""
    return F.element_at(_by_mask(lambda m: F.lit(chr(BLANK_CODE + m))), mask_col + 1)


def characters(text: Column) -> Column:
    """F5. Code points; empty text gives one empty string."""
    return F.split(text, "")


def _by_mask(value) -> Column:
    """Constant table of all 64 patterns, to be looked up by mask."""
    return F.array(*[value(m) for m in range(64)])


def dots_bool(mask_col: Column) -> Column:
    """F8. Six booleans, dots 1 to 6."""
    table = _by_mask(lambda m: F.array(*[F.lit(bool(m >> d & 1)) for d in range(6)]))
    return F.element_at(table, mask_col + 1)


def dots(mask_col: Column) -> Column:
    """Raised dots in ascending order."""
    none = F.array().cast("array<int>")
    table = _by_mask(
        lambda m: F.array(*[F.lit(d + 1) for d in range(6) if m >> d & 1]) if m else none
    )
    return F.element_at(table, mask_col + 1)


def raised_pins(glyphs: Column) -> Column:
    """A16. Raised pins of a page, from non-empty glyphs."""
    return F.aggregate(
        F.split(glyphs, ""), F.lit(0), lambda total, g: total + F.bit_count(mask(g))
    )


def pin_string(glyphs: Column) -> Column:
    """F9. One '0' or '1' per pin, six per cell in the order of ``PIN_ORDER``."""
    table = _by_mask(lambda m: F.lit(_pins(m)))
    return F.array_join(
        F.transform(F.split(glyphs, ""), lambda g: F.element_at(table, mask(g) + 1)), ""
    )


# ---------------------------------------------------- pages, an Arrow batch at a time
_MASK_OF = np.zeros(0x110000, np.uint8)
_MASK_OF[[ord(ch) for ch in LOOKUP]] = list(LOOKUP.values())
_RAISED_OF = np.array([mask.bit_count() for mask in range(64)], np.int32)
_GLYPH_BYTES = np.array([list(chr(BLANK_CODE + mask).encode()) for mask in range(64)], np.uint8)
_PIN_BYTES = np.array([list(_pins(mask).encode()) for mask in range(64)], np.uint8)


def _cells(chunks: pa.Array) -> np.ndarray:
    """Masks of the fourteen cells of each page."""
    texts = pc.fill_null(chunks, "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    page = np.repeat(np.arange(len(lengths)), lengths)
    cell = np.arange(len(points)) - (np.cumsum(lengths) - lengths)[page]
    shown = cell < CELLS
    cells = np.zeros((len(lengths), CELLS), np.uint8)
    cells[page[shown], cell[shown]] = _MASK_OF[points[shown]]
    return cells


def _strings(chunks: pa.Array, data: np.ndarray) -> pa.Array:
    """Bytes of as many equally long strings as there are pages; null where the page is."""
    ends = np.arange(len(chunks) + 1, dtype=np.int32) * data[:1].size
    strings = pa.StringArray.from_buffers(len(chunks), pa.py_buffer(ends), pa.py_buffer(data.tobytes()))
    return pc.if_else(chunks.is_valid(), strings, pa.scalar(None, pa.string()))


@F.arrow_udf(T.StructType().add("glyphs", "string").add("raised", "integer"))
def page_cells(chunks: pa.Array) -> pa.Array:
    """F7, F10, A16. ``fill_cells(encode(chunk))`` and its ``raised_pins``."""
    cells = _cells(chunks)
    raised = pa.array(_RAISED_OF[cells].sum(axis=1, dtype=np.int32), pa.int32())
    raised = pc.if_else(chunks.is_valid(), raised, pa.scalar(None, pa.int32()))
    return pa.StructArray.from_arrays([_strings(chunks, _GLYPH_BYTES[cells]), raised], ["glyphs", "raised"])


@F.arrow_udf(T.StringType())
def page_pins(chunks: pa.Array) -> pa.Array:
    """F9. ``pin_string(fill_cells(encode(chunk)))``."""
    return _strings(chunks, _PIN_BYTES[_cells(chunks)])


def pin_vector(glyphs: Column) -> Column:
    """F9 as an array of booleans."""
    return F.transform(F.split(pin_string(glyphs), ""), lambda p: p == "1")


# ---------------------------------------------------------------- pagination
def page_count(n_chars: Column, cells: int = CELLS) -> Column:
    """A17. At least one page."""
    return F.greatest(F.lit(1), F.ceil(n_chars / F.lit(cells)).cast("int"))


def chunks(text: Column, cells: int = CELLS) -> Column:
    """F6. Pages of ``cells`` code points; empty text is one empty page."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{cells}}}"), 0)
    )


def chunk_at(text: Column, page_idx: Column, cells: int = CELLS) -> Column:
    """The page at an index, cut out without building the other pages."""
    return F.substring(text, page_idx * cells + 1, F.lit(cells))


def start_char(page_idx: Column, n_chars: Column, cells: int = CELLS) -> Column:
    return F.when(n_chars == 0, 0).otherwise(page_idx * cells + 1)


def end_char(page_idx: Column, n_chars: Column, cells: int = CELLS) -> Column:
    return F.when(n_chars == 0, 0).otherwise(F.least((page_idx + 1) * cells, n_chars))


def has_previous(page_idx: Column) -> Column:
    return page_idx > 0


def has_next(page_idx: Column, n_pages: Column) -> Column:
    return page_idx < n_pages - 1


def page_label(page_idx: Column, n_pages: Column) -> Column:
    """F11."""
    return F.concat(F.lit("PAGE "), page_idx + 1, F.lit("/"), n_pages)


def range_label(start: Column, end: Column) -> Column:
    """F11, range form."""
    return F.concat(F.lit("["), start, F.lit("-"), end, F.lit("]"))


def cell_label(cell_idx: Column, chunk: Column, start: Column, n_chars: Column) -> Column:
    """F12. The position is shown for cells that hold a character of the page."""
    name = F.concat(F.lit("CELL #"), cell_idx + 1)
    return F.when(
        (n_chars > 0) & (cell_idx < F.length(chunk)),
        F.concat(name, F.lit(" ["), start + cell_idx, F.lit("]")),
    ).otherwise(name)


# ---------------------------------------------------------------- navigation
def clamp_page(page_idx: Column, n_pages: Column) -> Column:
    """O4. Nearest existing page."""
    return F.greatest(F.lit(0), F.least(page_idx, n_pages - 1))


def kept_page(page_idx: Column, n_pages: Column) -> Column:
    """O4 after the text was replaced: the index stays if it exists, else the first page."""
    return clamp_page(F.when(page_idx >= n_pages, 0).otherwise(page_idx), n_pages)


def step_bounded(page_idx: Column, delta: Column, n_pages: Column) -> Column:
    """O5, main display."""
    return clamp_page(page_idx + delta, n_pages)


def step_wrapping(page_idx: Column, delta: Column, n_pages: Column) -> Column:
    """O5, demo page."""
    return F.pmod(page_idx + delta, n_pages)
