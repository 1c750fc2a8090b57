import random
import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from touchline.llm.visual import LOOK_ALIKES, code_points, in_pieces, look_alike_classes, look_alike_links, look_alike_pairs, one_form, to_strings, visual_form

SAME = [
    ("café", "café"),
    ("ＡＢＣ１！", "ABC1!"),
    ("a​b﻿c­‍⁠‎", "abc"),
    ("a b c　d e ", "a b c d e "),
    ("ﬁn ﬂow oﬀ ﬃ", "fin flow off ffi"),
    ("Сосо рах", "Coco pax"),
    ("Ἀ", "Ἀ"),
    ("ё", "ë"),
    ("q̣̇", "q̣̇"),
    ("ﾊﾞ", "バ"),
    ("각", "각"),
    ("a\r\nb", "a\nb"),
    ("ế", "ế"),
]
OTHER = [("a", "A"), ("cafe", "café"), ("rn", "m"), ("0", "O"), ("1", "l"), ("I", "l"), ("Ã©", "é"), ("a.", "a!"), ("’", "'"), ("…", "..."), ("a b", "a  b"), ("й", "и"), ("²", "2"), ("a\rb", "ab"), ("a\x81", "a"), ("æ", "ae")]
OTHER += [("می\u200cخواهم", "میخواهم"), ("👩\u200d👧", "👩👧"), ("☺\ufe0f", "☺"), ("क\u094d\u200dष", "क\u094dष")]


def _form(*texts):
    return one_form(pa.array(texts, pa.string())).to_pylist()


def test_same_and_different():
    for a, b in SAME:
        assert _form(a) == _form(b), (a, b)
    for a, b in OTHER:
        assert _form(a) != _form(b), (a, b)


def _brute(text):
    """The same rules on one string at a time, by Python's own normalisation."""
    out = []
    text = text.replace("\r\n", "\n")
    for ch in text:
        rule, kind = unicodedata.decomposition(ch), unicodedata.category(ch)
        if kind == "Zs":
            ch = " "
        elif kind == "Cf":
            continue
        elif rule.startswith(("<wide>", "<narrow>")) or ch in "ﬀﬁﬂﬃﬄﬅﬆ":
            ch = "".join(chr(int(x, 16)) for x in rule.split()[1:])
        out.append(ch)
    look = {a: b for xs, ys in LOOK_ALIKES.values() for a, b in zip(xs, ys)}
    return unicodedata.normalize("NFC", "".join(look.get(x, x) for x in unicodedata.normalize("NFD", "".join(out))))


ALPHABET = "aeoAEIl01 .!\n\r ​̧̣́̈̆éñçüżёйаеорсхАВЕО" + "ΑΒοόώＡｂ１ﬁﬂß日本😀æ²…"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=ALPHABET, max_size=30)), max_size=12))
def test_whole_arrays_match_single_strings(texts):
    assert _form(*texts) == [None if t is None else _brute(t) for t in texts]
    sliced = one_form(pa.array([*texts, "x"], pa.string()).slice(1))
    assert sliced.to_pylist() == _form(*texts, "x")[1:]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=20), max_size=6))
def test_round_trip_and_idempotence(texts):
    array = pa.array(texts, pa.string())
    points, rows = code_points(array)
    assert to_strings(points, rows, None).to_pylist() == texts
    once = one_form(array)
    assert one_form(once).to_pylist() == once.to_pylist()


DDL = "id bigint, t string, form string, stored string, class_id int, rep string"


def test_pairs_and_classes_match_brute_force(spark):
    rnd = random.Random(9)
    texts = ["café au lait", "café au lait", "ｃａｆé au lait", "cafe au lait", "", None, "Сосо", "Coco", "coco", "x" * 200_000, "x" * 199_999 + "​x"]
    rows = [(i, rnd.choice(texts), "f", "s", 0, "r") for i in range(120)]
    df = spark.createDataFrame(rows, DDL)
    form = {i: _form(t)[0] for i, t, *_ in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and b[1] is not None and a[1] != b[1] and form[a[0]] == form[b[0]]}
    got = look_alike_pairs(df, "id", "t").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    # links are linear, and with the membership of copies they give all pairs again
    links = {tuple(r) for r in look_alike_links(df, "id", "t").collect()}
    rows_of = look_alike_classes(df, "id", "t").collect()
    assert len(links) == len({r.copy_of for r in rows_of}) - len({r.class_id for r in rows_of}) and links <= want
    member = {r.id: (r.class_id, r.copy_of) for r in rows_of}
    assert want == {(a, b) for a in member for b in member if a < b and member[a][0] == member[b][0] and member[a][1] != member[b][1]}
    classes = {r.id: (r.class_id, r.n_links) for r in rows_of}
    assert len(classes) == len(rows)
    for i, t, *_ in rows:
        mates = [r for r in rows if t is not None and r[1] is not None and form[r[0]] == form[i]]
        assert classes[i] == ((min(r[0] for r in mates), len({r[1] for r in mates}) - 1) if t is not None else (i, 0))


def test_empty(spark):
    df = spark.createDataFrame([], DDL)
    assert look_alike_pairs(df, "id", "t").count() == 0
    assert look_alike_classes(df, "id", "t").count() == 0
    assert df.select(visual_form("t")).count() == 0


def test_many_copies_are_all_paired(spark):
    rows = [(i, "Coco" if i % 2 else "Сосо", "f", "s", 0, "r") for i in range(80)] + [(80, "alone", "f", "s", 0, "r")]
    got = look_alike_pairs(spark.createDataFrame(rows, DDL), "id", "t").collect()
    assert len(got) == 40 * 40
    assert {tuple(r) for r in got} == {(a, b) for a in range(80) for b in range(a + 1, 80) if (b - a) % 2}


def test_many_variants_give_few_links(spark):
    rows = [(i, "ab" + "\u200b" * i, "f", "s", 0, "r") for i in range(2000)]
    df = spark.createDataFrame(rows, DDL)
    assert look_alike_links(df, "id", "t").count() == 1999
    assert {(r.class_id, r.n_links) for r in look_alike_classes(df, "id", "t").collect()} == {(0, 1999)}


def test_pieces_give_the_same():
    texts = ["é" * 50, None, "", "x" * 5000, "Сосо", *["a\u0301"] * 30, None]
    array = pa.array(texts, pa.string())
    for size in (1, 64, 1000, 1 << 20):
        assert in_pieces(array, size).equals(one_form(array))
        assert in_pieces(array.slice(3, 7), size).equals(one_form(array).slice(3, 7))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[chr(c) for c in (*range(0xC0, 0xD8), *range(0x300, 0x30A), 0x328, *range(0x9BE, 0x9D0), *range(0xAC00, 0xAC20), 0x1100, 0x1103, 0x1161, 0x1165, 0x11A8, 0x11AB)], max_size=12))
def test_composition_is_that_of_unicode(text):
    assert _form(text) == [unicodedata.normalize("NFC", text)]
