"""Problem 8: text that looks the same, brought to one form."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from touchline.session import materialise

#: Letters of other scripts that have the shape of a Latin letter.
LOOK_ALIKES = {
    "Cyrillic": ("аеорсухіјѕһԁԛԝѵАВЕКМНОРСТУХІЈЅԌԚԜӀҮѴ", "aeopcyxijshdqwvABEKMHOPCTYXIJSGQWIYV"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϳϲϹϺ", "ABEZHIKMNOPTYXovpjcCM"),
    "Armenian": ("օոսհցզյՍՕԼ", "onuhgqjUOL"),
    "Cherokee": ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZWVSLCPKB"),
    "Coptic": ("ⲟⲣⲥⲞⲢⲤⲦⲘⲚⲎⲔⲒⲈⲂⲀⲬ", "opcOPCTMNHKIEBAX"),
}
#: Code points without width that aren't of category Cf.
_WIDTHLESS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}
#: Code points of category Cf that can be seen.
_VISIBLE = {0x0600, 0x0601, 0x0602, 0x0603, 0x0604, 0x0605, 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
#: Scripts whose letters join, by the beginning of their names.
_JOINED_SCRIPTS = ("ARABIC LETTER", "SYRIAC LETTER", "MANDAIC LETTER", "NKO LETTER", "MONGOLIAN LETTER", "PHAGS-PA LETTER", "MANICHAEAN LETTER", "ADLAM ")
_NON_JOINER, _JOINER, _FLAG = 0x200C, 0x200D, 0x1F3F4
#: What stands beside a joiner: a letter that joins, a sign that kills a vowel, a picture.
_LETTER, _VIRAMA, _PICTURE = 1, 2, 3
#: Bytes of text that are worked on at a time, so that tables of code points stay small; one longer text is taken whole.
CHUNK_BYTES = 4 << 20
_SIZE = 0x110000
_DROP = 0xFFFFFFFF
_EXPAND = 0x80000000


@dataclass
class Tables:
    """Lookup tables over all code points, and the pairs that compose."""

    to: np.ndarray  # a code point, _DROP, or _EXPAND + place in ``start``
    start: np.ndarray
    length: np.ndarray
    pool: np.ndarray
    order: np.ndarray  # canonical combining class
    second: np.ndarray  # whether a code point can join what stands before it, or has a combining class
    look: np.ndarray  # look-alike letters, applied once marks are apart
    beside: np.ndarray  # what a joiner may stand beside
    pairs: np.ndarray  # base << 21 | mark, sorted
    composed: np.ndarray


_TABLES: Tables | None = None


def _replacement(cp: int) -> str | None:
    """What a code point is replaced by: '' for one without width, None for one that stays."""
    ch, kind, rule = chr(cp), unicodedata.category(chr(cp)), unicodedata.decomposition(chr(cp))
    if kind == "Zs":
        return " "
    if kind == "Cf" or cp in _WIDTHLESS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
        return ""
    if 0xAC00 <= cp < 0xD7A4 or (rule and not rule.startswith("<")):
        return unicodedata.normalize("NFD", ch)
    parts = [int(x, 16) for x in rule.split()[1:]]
    letters = all(unicodedata.category(chr(x))[0] == "L" for x in parts)
    # widths, letters in mathematical style, joined letters, Roman numerals, the sign for micro
    if rule.startswith(("<wide>", "<narrow>", "<font>")) or (rule.startswith("<compat>") and letters and (len(parts) > 1 or kind == "Nl" or cp == 0xB5)):
        return unicodedata.normalize("NFD", "".join(map(chr, parts)))
    return None


def _composing() -> dict[tuple[int, int], int]:
    """The pairs of code points that one stands for, by Unicode's own rules; syllables of Hangul by their arithmetic."""
    pairs = {}
    for cp in range(0xC0, 0x2FA1E):
        if 0xAC00 <= cp < 0xD7A4 or 0x3400 <= cp < 0xA000 or 0xD800 <= cp < 0xF900:
            continue
        rule = unicodedata.decomposition(chr(cp))
        parts = rule.split()
        if len(parts) == 2 and not rule.startswith("<") and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            pairs[int(parts[0], 16), int(parts[1], 16)] = cp
    for syllable in range(0xAC00, 0xD7A4, 28):
        lead, vowel = divmod((syllable - 0xAC00) // 28, 21)
        pairs[0x1100 + lead, 0x1161 + vowel] = syllable
        pairs.update({(syllable, 0x11A7 + tail): syllable + tail for tail in range(1, 28)})
    return pairs


def tables() -> Tables:
    """Built once for each process from the Unicode data of Python."""
    global _TABLES
    if _TABLES is not None:
        return _TABLES
    to = np.arange(_SIZE, dtype=np.uint32)
    order, beside = np.zeros(_SIZE, np.uint8), np.zeros(_SIZE, np.uint8)
    start, length, pool = [], [], []
    for cp in range(_SIZE):
        if 0xD800 <= cp < 0xF900 or 0x3400 <= cp < 0x4DC0 or 0x4E00 <= cp < 0xA000 or 0x20000 <= cp < 0x2F800 or 0x30000 <= cp < 0xE0000 or cp >= 0xF0000:
            continue  # surrogates, private use and ideographs stay
        kind = unicodedata.category(chr(cp))
        if kind == "Cn" or cp in _VISIBLE:
            continue
        order[cp] = unicodedata.combining(chr(cp))
        if unicodedata.name(chr(cp), "").startswith(_JOINED_SCRIPTS):
            beside[cp] = _LETTER
        elif order[cp] == 9:
            beside[cp] = _VIRAMA
        elif (kind == "So" and (0x2600 <= cp < 0x2800 or cp >= 0x1F000)) or 0x1F3FB <= cp <= 0x1F3FF:
            beside[cp] = _PICTURE
        into = _replacement(cp)
        if into == "":
            to[cp] = _DROP
        elif into is not None and len(into) == 1:
            to[cp] = ord(into)
        elif into is not None:
            to[cp] = _EXPAND + len(start)
            start.append(len(pool))
            length.append(len(into))
            pool.extend(map(ord, into))
    look = np.arange(_SIZE, dtype=np.uint32)
    for letters, latin in LOOK_ALIKES.values():
        look[[ord(x) for x in letters]] = [ord(x) for x in latin]
    pairs = {a << 21 | b: c for (a, b), c in _composing().items()}
    keys = np.array(sorted(pairs), np.int64)
    second = order > 0
    second[keys & 0x1FFFFF] = True
    composed = np.array([pairs[int(k)] for k in keys], np.uint32)
    _TABLES = Tables(to, np.array(start, np.int64), np.array(length, np.int64), np.array(pool, np.uint32), order, second, look, beside, keys, composed)
    return _TABLES


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of an Arrow string array, and where each row begins (n + 1 places)."""
    text = text.cast(pa.large_string())
    if text.null_count:
        text = text.fill_null("")
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1] if n else np.zeros(1, np.int64)
    data = text.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    leads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return points, leads[offsets - offsets[0]]


def to_strings(points: np.ndarray, rows: np.ndarray, valid: np.ndarray | None) -> pa.Array:
    """The Arrow string array of code points and row places."""
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate(([0], np.cumsum(width)))[rows]
    data = pa.py_buffer(points.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"))
    mask = None if valid is None else pa.array(valid).buffers()[1]
    return pa.Array.from_buffers(pa.large_string(), len(rows) - 1, [mask, pa.py_buffer(at.astype(np.int64).tobytes()), data])


def _keep(points: np.ndarray, rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return points[keep], np.concatenate(([0], np.cumsum(keep)))[rows]


def _sorted_marks(points: np.ndarray, rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Marks after a base in canonical order; only stretches out of order are sorted."""
    cls = order[points]
    begins = np.zeros(points.size + 1, bool)
    begins[rows] = True
    wrong = (cls[1:] != 0) & (cls[:-1] > cls[1:]) & ~begins[1:-1]
    if not wrong.any():
        return points
    stretch = np.cumsum((cls == 0) | begins[:-1])
    touched = np.isin(stretch, np.unique(stretch[1:][wrong]))
    where = np.flatnonzero(touched)
    ranked = np.lexsort((where, cls[where], stretch[where]))
    points = points.copy()
    points[where] = points[where[ranked]]
    return points


def _compose(points: np.ndarray, rows: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Join marks, second vowels and Hangul letters to what stands before them where one code point stands for both."""
    while points.size > 1:
        cls = t.order[points]
        begins = np.zeros(points.size + 1, bool)
        begins[rows] = True
        marks = np.flatnonzero(t.second[points] & ~begins[:-1])
        if not marks.size:
            break
        # a mark's base is the nearest starter before it, itself excepted where it is one
        starter = np.maximum.accumulate(np.where((cls == 0) | begins[:-1], np.arange(points.size), 0))
        base = starter[marks - 1]
        free = (marks - base == 1) | ((cls[marks] > 0) & (cls[marks - 1] != 0) & (cls[marks - 1] < cls[marks]))
        key = points[base].astype(np.int64) << 21 | points[marks]
        place = np.minimum(np.searchsorted(t.pairs, key), t.pairs.size - 1)
        fits = free & (cls[base] == 0) & (t.pairs[place] == key)
        if not fits.any():
            break
        _, first = np.unique(base[fits], return_index=True)  # one mark of each base in a pass
        chosen = np.flatnonzero(fits)[first]
        # what is joined away can't be another's base in the same pass
        apart = ~np.isin(base[chosen], marks[chosen])
        chosen = chosen[apart]
        points = points.copy()
        points[base[chosen]] = t.composed[place[chosen]]
        keep = np.ones(points.size, bool)
        keep[marks[chosen]] = False
        points, rows = _keep(points, rows, keep)
    return points, rows


def _seen_joiners(points: np.ndarray, rows: np.ndarray, mapped: np.ndarray, t: Tables) -> np.ndarray:
    """Places of signs without width that change what stands beside them, and so can be seen.

    A non-joiner between two letters that join keeps them apart, and after a vowel killer it keeps
    that visible; a joiner makes a letter join where none stands beside it, forms half letters after
    a vowel killer and one picture of two; a selector after a picture, and tags after a flag, choose
    another picture.
    """
    where = np.flatnonzero((points == _NON_JOINER) | (points == _JOINER) | ((points >= 0xFE0E) & (points <= 0xFE0F)) | ((points >= 0xE0020) & (points <= 0xE007F)))
    if not where.size:
        return where
    solid = np.flatnonzero(mapped != _DROP)
    at = np.searchsorted(solid, where)
    padded = np.concatenate(([-1], solid, [points.size]))
    before, after = padded[at], padded[at + 1]
    row = np.searchsorted(rows, where, side="right") - 1
    has_before, has_after = before >= rows[row], after < rows[row + 1]
    left = np.where(has_before, t.beside[points[np.maximum(before, 0)]], 0)
    right = np.where(has_after, t.beside[points[np.minimum(after, points.size - 1)]], 0)
    code = points[where]
    apart = (code == _NON_JOINER) & (((left == _LETTER) & (right == _LETTER)) | (left == _VIRAMA))
    lone = (left == _LETTER) != (right == _LETTER)
    joins = (code == _JOINER) & (lone | (left == _VIRAMA) | ((left == _PICTURE) & (right == _PICTURE)))
    chosen = (code >= 0xFE0E) & (code <= 0xFE0F) & (left == _PICTURE)
    tags = (code >= 0xE0020) & has_before & (points[np.maximum(before, 0)] == _FLAG)
    return where[apart | joins | chosen | tags]


def one_form(text: pa.Array) -> pa.Array:
    """The canonical form of each string; whole arrays at a time, null stays null."""
    t = tables()
    valid = np.asarray(text.is_valid()) if text.null_count else None
    points, rows = code_points(text)
    if points.size:
        if (points == 13).any():  # a carriage return before a line feed has no width
            keep = np.ones(points.size, bool)
            keep[:-1] = ~((points[:-1] == 13) & (points[1:] == 10))
            points, rows = _keep(points, rows, keep)
        mapped = t.to[points]
        if (mapped >= _EXPAND).any():
            stay = _seen_joiners(points, rows, mapped, t)
            mapped[stay] = points[stay]
            wide = (mapped >= _EXPAND) & (mapped != _DROP)
            size = np.ones(points.size, np.int64)
            size[mapped == _DROP] = 0
            entry = (mapped[wide] - np.uint32(_EXPAND)).astype(np.int64)
            size[wide] = t.length[entry]
            ends = np.cumsum(size)
            begin = ends - size
            out = np.repeat(mapped, size)
            if entry.size:
                n = t.length[entry]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out[np.repeat(begin[wide], n) + inner] = t.pool[np.repeat(t.start[entry], n) + inner]
            mapped, rows = out, np.concatenate(([0], ends))[rows]
        points = t.look[mapped]
        if points.size and t.second[points].any():
            points = _sorted_marks(points, rows, t.order)
            points, rows = _compose(points, rows, t)
    return to_strings(points, rows, valid).cast(pa.string())


def in_pieces(text: pa.Array, chunk_bytes: int = CHUNK_BYTES) -> pa.Array:
    """``one_form`` of pieces of whole rows of about ``chunk_bytes``, so that memory doesn't grow with the batch."""
    size = np.asarray(pc.fill_null(pc.binary_length(text), 0)).astype(np.int64)
    part = (np.cumsum(size) - size) // chunk_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(text)]
    return pa.concat_arrays([one_form(text.slice(a, b - a)) for a, b in zip(cuts, cuts[1:])]) if len(text) else one_form(text)


def visual_form(text: Column | str) -> Column:
    """A column with the one form of a text column: equal for texts that look the same.

    Full- and half-width forms and mathematical styles become ordinary ones, kinds of blank become a
    space, signs without width (and the carriage return of a line end) go, joined letters are split,
    letters of another script with the shape of a Latin letter become that letter, and accents,
    second vowels and letters of Hangul are joined in canonical order. Signs without width stay where
    they show: between letters that would join, after vowel killers, within and after pictures. Case,
    punctuation, accents as such, digits and broken encodings stay. Null stays null, an empty text
    stays empty; texts of any length are taken whole.
    """

    def convert(column: pa.Array) -> pa.Array:
        return in_pieces(column)

    convert.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(convert, T.StringType())(F.col(text) if isinstance(text, str) else text)


def with_visual_form(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the one form of ``text`` as ``out`` (which replaces a column of that name)."""
    return df.withColumn(out, visual_form(text))


def fingerprints(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, stored, form): 256-bit hashes of the stored text and of its one form, null texts left out."""
    known = df.filter(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    return known.select("id", F.unhex(F.sha2("t", 256)).alias("stored"), F.unhex(F.sha2(visual_form("t"), 256)).alias("form"))


def _texts(prints: DataFrame) -> DataFrame:
    """(form, stored, rep): each stored text of a form with the least id that has it."""
    return prints.groupBy("form", "stored").agg(F.min("id").alias("rep"))


def look_alike_classes(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row per document: ``id_col``, class_id (least id of its class), copy_of, n_links long.

    A class holds the documents whose texts look the same; copy_of is the least id with the very
    same stored text, n_links counts the other stored texts of the class. Null texts look like
    nothing, and their documents have a class of their own.
    """
    prints = materialise(fingerprints(df, id_col, text), "forms")
    texts = _texts(prints)
    classes = texts.groupBy("form").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("n"))
    # both tables are one row per form or text; a form that most documents share is split by AQE
    known = prints.join(texts, ["form", "stored"]).join(classes, "form")
    known = known.select(F.col("id").alias(id_col), "class_id", F.col("rep").alias("copy_of"), (F.col("n") - 1).alias("n_links"))
    alone = df.filter(F.col(text).isNull()).select(id_col, F.col(id_col).alias("class_id"), F.col(id_col).alias("copy_of"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(alone)


def look_alike_links(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id_a, doc_id_b): the representative of each class linked to that of each other stored text in it.

    Linear: a class of k stored texts has k - 1 links, however many copies each has. Together with
    ``copy_of`` of ``look_alike_classes`` no link between different texts is lost.
    """
    texts = _texts(materialise(fingerprints(df, id_col, text), "forms"))
    heads = texts.groupBy("form").agg(F.min("rep").alias("doc_id_a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return texts.join(heads, "form").filter("rep != doc_id_a").select("doc_id_a", F.col("rep").alias("doc_id_b"))


def look_alike_pairs(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: all documents whose stored texts differ but look the same.

    The classes of ``look_alike_links`` written out in full, for results that are defined as all
    pairs: as many rows as there are such pairs, at any size of a class. Copies of one text make no
    pair with one another. Classes are found by hash equality, and only documents of classes with
    two texts or more take part; a class that most documents share is joined in parts by AQE. Forms
    and texts are compared by 256-bit hashes. Null texts are in no pair; a repeated document id
    pairs like one document.
    """
    prints = materialise(fingerprints(df, id_col, text), "forms")
    shared = _texts(prints).groupBy("form").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("form")
    members = prints.join(shared, "form", "left_semi").distinct()
    later = members.select("form", F.col("stored").alias("other"), F.col("id").alias("b"))
    pairs = members.join(later, "form").filter((F.col("stored") != F.col("other")) & (F.col("id") < F.col("b")))
    # only where an id is repeated can a pair come twice
    return pairs.select(F.col("id").alias("doc_id_a"), F.col("b").alias("doc_id_b")).distinct()
